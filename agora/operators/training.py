"""Training and evaluation of several logistic models at once: folds, growing fractions, strategies.

Models differ in which rows they learn from and how much each counts, so one table with an array of
shares serves all: every round of descent is one pass that sums the slopes of all models.  A row's
share is 0 where a model does not learn from it, its number of repeats where it is oversampled, and
its class weight where classes are weighted.  Numbers are scaled by each model's own training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions.hashing import bucket
from agora.functions.numbers import number, round6, sigmoid
from agora.operators import metrics, modeling

STRATEGIES = ("baseline", "class_weighted", "undersample", "oversample", "smote")


class Model(NamedTuple):
    """Weights over unscaled features, with the means and deviations that the model learnt with."""

    weights: list[float]
    bias: float
    loss: list[float]


def features(rows: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``features``: numbers unscaled, then one place for each value of each category; and how many."""
    values = rows.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in categorical)).first() if categorical else {}
    parts = [number(F.col(c)) for c in numeric] + [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c in categorical for v in values[c]]
    return rows.withColumn("features", F.array(*parts)), len(parts)


def scales(rows: DataFrame, width: int, numeric: int, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 where 0) of the numbers over each model's rows (``learns``); 0 and 1 for categories."""
    mine = lambda k, j: F.when(F.col("learns")[k], F.col("features")[j])
    found = rows.agg(*(F.struct(F.avg(mine(k, j)), F.stddev_pop(mine(k, j))).alias(f"{k}_{j}") for k in range(models) for j in range(numeric))).first()
    center, scale = np.zeros((models, width)), np.ones((models, width))
    for k in range(models):
        for j in range(numeric):
            center[k, j], scale[k, j] = found[f"{k}_{j}"][0] or 0.0, found[f"{k}_{j}"][1] or 1.0
    return center, scale


def fit(rows: DataFrame, center: np.ndarray, scale: np.ndarray, iterations: int = 500, rate: float = 0.08, l2: float = 5e-4) -> list[Model]:
    """Full-batch gradient descent from zero of all models over rows (features, binary_label, shares).

    The sum of a model's shares is its number of rows, as repeats count and class weights average 1.
    Each task returns one row of sums a round, and there are as many tasks as cores at most.
    """
    models, width = center.shape

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.ascontiguousarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).tobytes() for c in ("features", "shares")]
            label = batch.column("binary_label").to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (parts[0], label, parts[1])], ["x", "y", "s"])

    held = rows.select("features", "binary_label", "shares").mapInArrow(blocks, "x binary, y binary, s binary").coalesce(rows.sparkSession.sparkContext.defaultParallelism).persist()
    weights, bias, losses = np.zeros((models, width)), np.zeros(models), []
    for _ in range(iterations):
        plain, shift = weights / scale, bias - (weights * center / scale).sum(axis=1)

        def step(batches: Iterator[pa.RecordBatch], w: np.ndarray = plain, b: np.ndarray = shift) -> Iterator[pa.RecordBatch]:
            total = np.zeros((models, width + 3))
            for batch in batches:
                for x, y, s in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "s"))):
                    x, y, s = np.frombuffer(x).reshape(-1, width), np.frombuffer(y)[:, None], np.frombuffer(s).reshape(-1, models)
                    p = 1 / (1 + np.exp(-np.clip(x @ w.T + b, -35, 35)))
                    error = s * (p - y)
                    total[:, :width] += error.T @ x
                    total[:, width] += error.sum(axis=0)
                    total[:, width + 1] += s.sum(axis=0)
                    total[:, width + 2] -= (s * np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

        sums = np.sum([np.frombuffer(r[0]).reshape(models, width + 3) for r in held.mapInArrow(step, "t binary").collect()], axis=0)
        n = np.maximum(sums[:, width + 1], 1e-12)[:, None]
        slope = (sums[:, :width] - center * sums[:, width : width + 1]) / scale
        weights, bias = weights - rate * (slope / n + l2 * weights), bias - rate * (sums[:, width] / n[:, 0])
        losses.append(sums[:, width + 2] / n[:, 0])
    held.unpersist()
    plain, shift = weights / scale, bias - (weights * center / scale).sum(axis=1)
    return [Model(plain[k].tolist(), float(shift[k]), [float(x[k]) for x in losses]) for k in range(models)]


def fit_balanced(rows: DataFrame, width: int, iterations: int = 500) -> Model:
    """One model over scaled rows (features, binary_label), both classes of equal weight."""
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in metrics.labeled(rows).groupBy("binary_label").count().collect()}
    each = [sum(counts.values()) / (2 * counts[k]) if trainable(counts) else 1.0 for k in (0, 1)]
    shares = F.array(F.when(F.col("binary_label") == 1, each[1]).otherwise(each[0]).cast("double"))
    return fit(metrics.labeled(rows).withColumn("shares", shares), np.zeros((1, width)), np.ones((1, width)), iterations)[0]


def scored(rows: DataFrame, models: list[Model], where: str = "tests") -> DataFrame:
    """A row (model, ..., probability) for each row and each model for which its array ``where`` is true."""
    p = [F.when(F.col(where)[k], sigmoid(modeling.dot(F.col("features"), m.weights) + m.bias)) for k, m in enumerate(models)]
    return rows.select("*", F.posexplode(F.array(*p)).alias("model", "probability")).where("probability IS NOT NULL").drop("features", "shares", "learns", "tests")


def evaluated(rows: DataFrame, tie: str) -> DataFrame:
    """By model: rows and positives, confusion and rates at 0.5, both areas, the best F1, and how items rank their rows."""
    by = ["model"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("binary_label").alias("n_positive"))
    out = counts.join(metrics.confusion(rows, by=by), by)
    for part in (metrics.roc_auc(rows, tie, by), metrics.pr_auc(rows, tie, by), metrics.best_threshold(metrics.threshold_curve(rows, by=by), by).withColumnsRenamed({"f1": "best_f1", "threshold": "best_threshold"}), metrics.ranking(rows, tie, by)):
        out = out.join(part, by, "left")
    return out


def trainable(counts: dict[int, int]) -> bool:
    return counts.get(0, 0) > 0 and counts.get(1, 0) > 0


def cross_validated(rows: DataFrame, host: Column, row_id: str, numeric: list[str], categorical: list[str], folds: int = 5, iterations: int = 500) -> DataFrame:
    """(fold, train_rows, ...evaluated): each fold by host held out once; folds that lack a class on either side are left out."""
    held = metrics.labeled(rows).withColumn("_fold", bucket(host, folds))
    held, width = features(held, numeric, categorical)
    tests = F.array(*(F.col("_fold") == k for k in range(folds)))
    held = held.withColumn("tests", tests).withColumn("learns", F.transform("tests", lambda t: ~t)).withColumn("shares", F.transform("learns", lambda x: x.cast("double")))
    sizes = {(r[0], r[1]): r[2] for r in held.groupBy("_fold", "binary_label").count().collect()}  # two rows a fold
    within = [{c: sizes.get((k, c), 0) for c in (0, 1)} for k in range(folds)]
    without = [{c: sum(w[c] for w in within) - within[k][c] for c in (0, 1)} for k in range(folds)]
    models = fit(held, *scales(held, width, len(numeric), folds), iterations)
    good = [k for k in range(folds) if trainable(within[k]) and trainable(without[k])]
    found = evaluated(scored(held, models).where(F.col("model").isin(good)), row_id)
    train = F.element_at(F.array(*(F.lit(sum(w.values())).cast("long") for w in without)), F.col("model") + 1)
    return found.withColumn("train_rows", train).withColumnRenamed("model", "fold")


def held_out(rows: DataFrame, host: Column, row_id: str, modulo: int = 5) -> DataFrame:
    """Labelled rows with ``held_out`` by host or, where that leaves a class out of training, by row."""
    held = modeling.split(metrics.labeled(rows), host, modulo)
    counts = {r[0]: r[1] for r in held.where("NOT held_out").groupBy("binary_label").count().collect()}
    return held if trainable(counts) else modeling.split(metrics.labeled(rows), F.col(row_id).cast("string"), modulo)


def learning_curve(rows: DataFrame, host: Column, row_id: str, numeric: list[str], categorical: list[str], fractions: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), iterations: int = 500) -> DataFrame:
    """(fraction, part, ...evaluated): models of the first part of each class, on their own rows and on those held out."""
    held, width = features(held_out(rows, host, row_id), numeric, categorical)
    train = modeling.hash_rank(held.where("NOT held_out"), row_id, ["binary_label"])
    most = [F.greatest(F.lit(1), F.floor(F.col("n_ranked") * f + 0.5)) for f in fractions]
    train = train.withColumn("learns", F.array(*(F.col("hash_rank") <= m for m in most))).withColumn("shares", F.transform("learns", lambda x: x.cast("double"))).drop("hash_rank", "n_ranked")
    models = fit(train, *scales(train, width, len(numeric), len(fractions)), iterations)
    test = held.where("held_out").withColumn("tests", F.array_repeat(F.lit(True), len(fractions)))
    both = scored(train, models, "learns").withColumn("part", F.lit("train")).unionByName(scored(test, models).withColumn("part", F.lit("test")), allowMissingColumns=True)
    keyed = both.withColumn("model", F.col("model") * 2 + (F.col("part") == "test").cast("int"))
    fraction = F.element_at(F.array(*map(F.lit, fractions)), F.floor(F.col("model") / 2).cast("int") + 1)
    return evaluated(keyed, row_id).withColumns({"fraction": fraction, "part": F.when(F.col("model") % 2 == 1, "test").otherwise("train")}).drop("model")


def prepared(train: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Training rows with ``shares`` for each of ``STRATEGIES``, synthetic ones among them, and the counts before and after.

    Undersampling keeps as many of the larger class as the smaller has; oversampling and synthetic
    rows bring the smaller one up to the larger: class sizes are exact.  With fewer than two rows in
    the smaller class synthetic rows are repeats.
    """
    counts = {c: 0 for c in (0, 1)} | {r[0]: r[1] for r in train.groupBy("binary_label").count().collect()}
    minor = min(counts, key=lambda k: (counts[k], 1 - k))
    small, large = counts[minor], counts[1 - minor]
    whole, rest = divmod(large, small) if small else (1, 0)
    ranked = modeling.hash_rank(train, row_id, ["binary_label"])
    in_minor = F.col("binary_label") == minor
    repeats = F.when(in_minor, whole + (F.col("hash_rank") <= rest).cast("int")).otherwise(1).cast("double")
    weight = F.when(F.col("binary_label") == 1, (small + large) / max(1, 2 * counts[1])).otherwise((small + large) / max(1, 2 * counts[0]))
    synthetic = small >= 2 and large > small
    shares = [F.lit(1.0), weight.cast("double"), F.when(in_minor | (F.col("hash_rank") <= small), 1.0).otherwise(0.0), repeats, F.lit(1.0) if synthetic else repeats]
    out = ranked.withColumn("shares", F.array(*shares)).withColumn("learns", F.array_repeat(F.lit(True), len(STRATEGIES))).drop("hash_rank", "n_ranked")
    if synthetic:
        base = train.where(in_minor).select(F.col(row_id).alias("id"), "features")
        made = modeling.smote(base, extra=large - small).select(F.lit(minor).alias("binary_label"), "features", F.array(*map(F.lit, (0.0, 0.0, 0.0, 0.0, 1.0))).alias("shares"), F.array_repeat(F.lit(False), len(STRATEGIES)).alias("learns"))
        out = out.unionByName(made, allowMissingColumns=True)
    after = out.select("binary_label", F.posexplode("shares").alias("at", "share")).groupBy("at").agg(F.sum(F.when(F.col("binary_label") == 1, F.col("share")).otherwise(0.0)).alias("positive"), F.sum(F.when(F.col("binary_label") == 0, F.col("share")).otherwise(0.0)).alias("negative"))
    return out, after.select(F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("at") + 1).alias("strategy"), F.lit(counts[1]).cast("long").alias("positive_before"), F.lit(counts[0]).cast("long").alias("negative_before"), round6(F.col("positive")).alias("positive_after"), round6(F.col("negative")).alias("negative_after"))


def compared(rows: DataFrame, host: Column, row_id: str, numeric: list[str], categorical: list[str], iterations: int = 500) -> DataFrame:
    """(strategy, ...evaluated): a model for each way to treat the imbalance of classes, on the rows held out."""
    held, width = features(held_out(rows, host, row_id), numeric, categorical)
    train = held.where("NOT held_out").withColumn("learns", F.array_repeat(F.lit(True), len(STRATEGIES)))
    center, scale = scales(train, width, len(numeric), len(STRATEGIES))
    # neighbours are sought among scaled rows, as distances between unscaled ones mean nothing
    scaled = lambda c: F.zip_with(c, F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(center[0], scale[0]))), lambda x, y: (x - y["m"]) / y["s"])
    shared, _ = prepared(train.withColumn("features", scaled(F.col("features"))), row_id)
    models = fit(shared, np.zeros_like(center), np.ones_like(scale), iterations)
    test = held.where("held_out").withColumn("features", scaled(F.col("features"))).withColumn("tests", F.array_repeat(F.lit(True), len(STRATEGIES)))
    found = evaluated(scored(test, models), row_id)
    return found.withColumn("strategy", F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("model") + 1)).drop("model")


def leaderboard(compared_: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1", "pr_auc", "roc_auc", "top_1_accuracy")) -> DataFrame:
    """(metric, strategy, value): the best strategy by each metric, of equals the one listed first."""
    place = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    long = compared_.withColumn("_place", place).unpivot(["strategy", "_place"], list(names), "metric", "value").where("value IS NOT NULL")
    return long.groupBy("metric").agg(F.max_by("strategy", F.struct("value", (-F.col("_place")).alias("p"))).alias("strategy"), F.max("value").alias("value"))
