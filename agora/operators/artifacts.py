"""Models from labelled candidates to scores: one call trains, evaluates and makes a portable artifact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators import metrics, modeling, sampling, splits, training
from agora.session import written

ALGORITHMS = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting")
STRATEGIES = ("baseline", "class_weighted", "undersample", "oversample")
LEAST_ROWS = 4


def _counts(rows: DataFrame) -> dict[int, int]:
    return {0: 0, 1: 0} | {r[0]: r[1] for r in rows.groupBy("binary_label").count().collect()}


def vectors(rows: DataFrame, artifact: dict) -> DataFrame:
    """Rows with ``features`` as the artifact's vectorizer makes them."""
    return rows.withColumn("features", modeling.vector(artifact["vectorizer"]))


def train(rows: DataFrame, host: Column, row_id: str, numeric: list[str], categorical: list[str], algorithm: str = "logistic_regression", strategy: str = "baseline", **options) -> dict:
    """An artifact from ``rows`` (binary_label, features by name): algorithm, model, vectorizer, counts, metrics of both sides.

    Hosts are on one side of the split alone, or rows where that leaves a class out of training; the
    vectorizer sees training rows only.  Fewer than four labelled rows, or one class alone, are an
    error, as are unknown names.  Classes are weighted in regression and drawn by weight for trees.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    labelled = metrics.labeled(rows)
    if labelled.count() < LEAST_ROWS:
        raise ValueError(f"training needs at least {LEAST_ROWS} labelled rows")
    held = written(training.held_out(labelled, host, row_id), "split")
    learn = held.where("NOT held_out")
    before = _counts(learn)
    if not training.trainable(before):
        raise ValueError("training needs both classes")
    artifact = {"schema_version": 1, "algorithm": algorithm, "strategy": strategy, "threshold": 0.5, "numeric": numeric, "categorical": categorical, "vectorizer": modeling.fit_vectorizer(learn, numeric, categorical)}
    width = len(numeric) + sum(len(v) for v in artifact["vectorizer"]["categorical"].values())
    base = vectors(learn, artifact).select(F.col(row_id).alias("row_id"), "binary_label", "features")
    if strategy == "class_weighted" and algorithm != "logistic_regression":
        base = written(base, "train-rows")
        drawn = sampling.class_weighted(base).join(base, "row_id")
        base = drawn.select(F.concat_ws("#", "row_id", "draw").alias("row_id"), "binary_label", "features")
    elif strategy in ("undersample", "oversample"):
        base = modeling.resampled(base, strategy, "row_id").select("row_id", "binary_label", "features")
    base = written(base, "prepared")
    if algorithm == "logistic_regression" and strategy != "class_weighted":
        shares = base.withColumn("shares", F.array(F.lit(1.0)))
        model = {"algorithm": algorithm} | training.fit(shares, np.zeros((1, width)), np.ones((1, width)), **options)[0]._asdict()
    else:
        model = splits.fit(algorithm, base, width, **options)
    artifact |= {"model": model, "counts_before": before, "counts_after": _counts(base)}
    found = scored(held, artifact).select(F.col(row_id), "item_id", "binary_label", "probability", F.col("held_out").cast("int").alias("model"))
    rates = {r["model"]: r.asDict() for r in training.evaluated(written(found, "evaluation"), row_id).collect()}  # two rows
    artifact["metrics"] = {name: {k: v for k, v in rates.get(side, {}).items() if k != "model"} for name, side in (("train", 0), ("test", 1))}
    return artifact


def with_threshold(artifact: dict, threshold: float) -> dict:
    """The artifact with another threshold, between 0 and 1."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    return artifact | {"threshold": float(threshold)}


def scored(rows: DataFrame, artifact: dict) -> DataFrame:
    """``rows`` with probability, predicted_label, base and contributions by an artifact and its threshold."""
    return splits.predicted(vectors(rows, artifact), artifact["model"], artifact["threshold"]).drop("features")


def summed(found: DataFrame, by: str, row_id: str) -> DataFrame:
    """(by, candidates, positives, mean_probability, best_probability, best_row) of scored rows of a job's items or of hosts."""
    best = F.max_by(F.col(row_id), F.struct("probability", (-F.xxhash64(row_id)).alias("h")))
    return found.groupBy(by).agg(F.count("*").alias("candidates"), F.sum("predicted_label").alias("positives"), F.avg("probability").alias("mean_probability"), F.max("probability").alias("best_probability"), best.alias("best_row"))


def runtime(artifact: dict) -> dict:
    """What a client needs to score by itself: descriptors by place, numbers' means and deviations, and the model."""
    fitted, places = artifact["vectorizer"], []
    for name in fitted["numeric"]:
        places.append({"type": "number", "feature_key": name, "index": len(places)})
    for name, values in fitted["categorical"].items():
        for value in values:
            places.append({"type": "category", "feature_key": name, "category": value, "index": len(places)})
    stats = {name: {"mean": m, "std": s} for name, (m, s) in fitted["numeric"].items()}
    return {"algorithm": artifact["algorithm"], "threshold": artifact["threshold"], "model": artifact["model"], "vectorizer": {"dimension": len(places), "descriptors": places, "numeric_stats": stats}}
