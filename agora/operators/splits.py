"""Decision trees with exact splits, forests and boosting, level by level for all nodes and trees at once.

A level is one aggregate: rows of a node count by distinct value of each feature, prefix sums within
ranges of values (and over the ranges before) give every split's gain, and the best of each node
comes back to the driver.  Between two neighbouring values the threshold is their middle; of equal
gains the first feature wins, then the least threshold; a split has to gain more than ``LEAST_GAIN``.
Targets of regression count in steps of ``UNIT``, so that sums are exact and trees do not depend on
how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.sampling import bootstrap
from agora.session import written

LEAST_GAIN = 1e-8
#: A step of a regression's targets.
UNIT = 2.0**-30
#: Values of a feature whose prefix sums one task may make; more are cut into ranges.
RANGE_ROWS = 1 << 20


@dataclass
class Tree:
    """Flat arrays, the root first: feature -1 is a leaf; rows up to the threshold go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, n: int) -> int:
        for name, x in zip(("feature", "threshold", "left", "right", "value", "n", "gain"), (-1, 0.0, -1, -1, value, n, 0.0)):
            getattr(self, name).append(x)
        return len(self.n) - 1

    def split(self, node: int, feature: int, threshold: float, gain: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.gain[node], self.left[node], self.right[node] = feature, threshold, gain, left, right

    def walked(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, nodes, next nodes) of a matrix's rows, a step down the tree at a time."""
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            then = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            yield rows, node, then
            at[rows] = then

    def predicted(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for rows, _, then in self.walked(x):
            at[rows] = then
        return np.array(self.value)[at]

    def explained(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to a row's value on its way down; with the root's value they sum to the leaf's."""
        value, out = np.array(self.value), np.zeros(x.shape)
        feature = np.array(self.feature)
        for rows, node, then in self.walked(x):
            np.add.at(out, (rows, feature[node]), value[then] - value[node])
        return out

    def node_of(self, features: Column, leaf: str = "node", node: int = 0) -> Column:
        """The place (``node``) or the value of the leaf that a row comes to, as one native expression."""
        if self.feature[node] < 0:
            return F.lit(node) if leaf == "node" else F.lit(self.value[node])
        return F.when(F.get(features, F.lit(self.feature[node])) <= self.threshold[node], self.node_of(features, leaf, self.left[node])).otherwise(self.node_of(features, leaf, self.right[node]))


def plain_features(column: str = "features") -> Column:
    """What is no number counts as 0."""
    return F.transform(column, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def _gini(n: Column, s: Column) -> Column:
    p = s / n
    return F.lit(1.0) - p * p - (F.lit(1.0) - p) * (F.lit(1.0) - p)


def _gain(kind: str) -> Column:
    """Of a split with nl rows and the sum sl to the left, of a node with n rows and the sum s."""
    n, s, nl, sl = (F.col(c).cast("double") for c in ("n", "s", "nl", "sl"))
    nr, sr = n - nl, s - sl
    if kind == "classes":
        return _gini(n, s) - (nl / n) * _gini(nl, sl) - (nr / n) * _gini(nr, sr)
    return (sl * sl / nl + sr * sr / nr - s * s / n) * F.lit(UNIT * UNIT)


def _cuts(rows: DataFrame, width: int, n: int, range_rows: int) -> list[list[float]]:
    """For each feature the values that part it into ranges; none where all of it fits into one."""
    parts = -(-n // range_rows)
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(*(F.percentile_approx(F.get("features", F.lit(k)), shares, 10_000).alias(f"q{k}") for k in range(width))).first()
    return [sorted(set(found[f"q{k}"])) for k in range(width)]


def best_splits(rows: DataFrame, kind: str, cuts: list[list[float]], least_rows: int = 2) -> DataFrame:
    """(tree, node, gain, feature, threshold, nl, sl) of the best split of each node of ``rows`` (tree, node, times, target, feature, value) with enough rows."""
    each = ["tree", "node", "feature"]
    counts = rows.groupBy(*each, "value").agg(F.sum("times").alias("m"), F.sum(F.col("times") * F.col("target")).alias("t"))
    totals = Window.partitionBy(*each)
    if cuts:
        ends = F.get(F.array(*(F.array(*map(F.lit, c)).cast("array<double>") for c in cuts)), F.col("feature"))
        counts = counts.withColumn("part", F.size(F.filter(ends, lambda c: c < F.col("value"))))
        within = Window.partitionBy(*each, "part").orderBy("value")
        sums = counts.groupBy(*each, "part").agg(F.sum("m").alias("pm"), F.sum("t").alias("pt"), F.min("value").alias("first"))
        ahead = Window.partitionBy(*each).orderBy("part")  # as many rows as there are ranges
        before = ahead.rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*each, "part", F.coalesce(F.sum("pm").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("pt").over(before), F.lit(0)).alias("t0"), F.lead("first").over(ahead).alias("after"), F.sum("pm").over(totals).alias("n"), F.sum("pt").over(totals).alias("s"))
        counts = counts.join(sums, [*each, "part"])
    else:
        within = Window.partitionBy(*each).orderBy("value")
        counts = counts.withColumns({"m0": F.lit(0), "t0": F.lit(0), "after": F.lit(None).cast("double"), "n": F.sum("m").over(totals), "s": F.sum("t").over(totals)})
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    splits = counts.withColumns({"nl": F.col("m0") + F.sum("m").over(upto), "sl": F.col("t0") + F.sum("t").over(upto), "next": F.coalesce(F.lead("value").over(within), "after")}).where(F.col("next").isNotNull() & (F.col("n") >= least_rows))
    splits = splits.withColumns({"gain": _gain(kind), "threshold": (F.col("value") + F.col("next")) / 2})
    best = F.max_by(F.struct("gain", "feature", "threshold", "nl", "sl"), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("t")))
    return splits.groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*").where(F.col("gain") > LEAST_GAIN)


def grow(rows: DataFrame, width: int, kind: str = "classes", depth: int = 6, least_rows: int = 4, trees: int = 1, features: int | None = None, seed: int = 0, range_rows: int = RANGE_ROWS) -> list[Tree]:
    """Trees over ``rows`` (tree: int, times: long, features: array<double>, target: long).

    ``kind`` is classes (targets 0 and 1) or numbers (targets in steps of ``UNIT``); each of
    ``trees`` learns from its rows, as many times as they say.  With ``features`` only so many of a
    node's features are looked at, those of the least hash of seed, tree, node and feature.
    """
    of = (lambda s, n: s / n) if kind == "classes" else (lambda s, n: s * UNIT / n)
    made = [Tree() for _ in range(trees)]
    open_: list[dict[int, tuple[int, int]]] = [{} for _ in made]
    for r in rows.groupBy("tree").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("target")).alias("s")).collect():
        open_[r.tree][made[r.tree].add(of(r.s, r.n), r.n)] = (r.n, r.s)
    cuts = _cuts(rows, width, max((n for o in open_ for n, _ in o.values()), default=0), range_rows)
    live = rows.select("tree", "times", "target", "features", F.lit(0).alias("node"))
    for _ in range(depth):
        wide = live.select("tree", "node", "times", "target", F.posexplode("features").alias("feature", "value"))
        if features is not None and features < width:
            keys = F.array(*(F.struct(F.xxhash64(F.lit(seed), "tree", "node", F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(width)))
            pairs = F.transform(F.slice(F.array_sort(keys), 1, features), lambda x: F.struct(x["k"].alias("feature"), F.get("features", x["k"]).alias("value")))
            wide = live.select("tree", "node", "times", "target", F.explode(pairs).alias("x")).select("tree", "node", "times", "target", "x.*")
        splits = []
        for r in sorted(best_splits(wide, kind, cuts, least_rows).collect(), key=lambda r: (r.tree, r.node)):
            tree, (n, s) = made[r.tree], open_[r.tree][r.node]
            sides = [(r.nl, r.sl), (n - r.nl, s - r.sl)]
            left, right = (tree.add(of(b, a), a) for a, b in sides)
            tree.split(r.node, r.feature, r.threshold, r.gain, left, right)
            open_[r.tree] |= dict(zip((left, right), sides))
            splits.append((r.tree, r.node, r.feature, r.threshold, left, right))
        if not splits:
            break
        # at most two to the depth for each tree; rows that came to a leaf drop out
        down = F.broadcast(rows.sparkSession.createDataFrame(splits, "tree int, node int, feature int, threshold double, left int, right int"))
        after = F.when(F.get("features", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        live = live.join(down, ["tree", "node"]).select("tree", "times", "target", "features", after.alias("node"))
    return made


def importances(trees: list[Tree], width: int) -> list[float]:
    """Each feature's share of all gains, each times the rows of its node."""
    total = np.zeros(width)
    for tree in trees:
        for f, g, n in zip(tree.feature, tree.gain, tree.n):
            if f >= 0:
                total[f] += g * n
    return [float(math.floor(x / (total.sum() or 1.0) * 1e6 + 0.5) / 1e6) for x in total]


def _base(rows: DataFrame) -> DataFrame:
    return written(rows.select("row_id", plain_features().alias("features"), F.col("binary_label").cast("long").alias("target")), "tree-rows")


def fit_decision_tree(rows: DataFrame, width: int, depth: int = 6, least_rows: int = 4) -> dict:
    """Of ``rows`` (features, binary_label; row_id only for a forest)."""
    base = rows.select(plain_features().alias("features"), F.col("binary_label").cast("long").alias("target"), F.lit(0).alias("tree"), F.lit(1).cast("long").alias("times"))
    trees = grow(written(base, "tree-rows"), width, depth=depth, least_rows=least_rows)
    return {"algorithm": "decision_tree", "trees": [asdict(t) for t in trees], "feature_importances": importances(trees, width)}


def fit_random_forest(rows: DataFrame, width: int, trees: int = 25, depth: int = 6, least_rows: int = 4, seed: int = 1) -> dict:
    """Trees of bootstrap samples as large as the table, each node looking at the root of ``width`` features.  ``rows``: row_id, features, binary_label."""
    base = _base(rows)
    drawn = bootstrap(base.select("row_id", F.lit(1.0).alias("weight")), samples=trees, seed=seed).groupBy("sample", "row_id").agg(F.count("*").alias("times"))
    sampled = written(drawn.join(base, "row_id").select(F.col("sample").alias("tree"), "times", "features", "target"), "forest-rows")
    made = grow(sampled, width, depth=depth, least_rows=least_rows, trees=trees, features=max(1, math.isqrt(width)), seed=seed)
    return {"algorithm": "random_forest", "trees": [asdict(t) for t in made], "feature_importances": importances(made, width)}


def _logit(p: float) -> float:
    p = min(0.999999, max(0.000001, p))
    return math.log(p / (1 - p))


def fit_gradient_boosting(rows: DataFrame, width: int, trees: int = 25, depth: int = 2, rate: float = 0.1, least_rows: int = 4) -> dict:
    """Regression trees, each of what the ones before leave of the labels.  ``rows``: features, binary_label (row_id may be null)."""
    base = _base(rows if "row_id" in rows.columns else rows.withColumn("row_id", F.lit(None).cast("long")))
    n, pos = base.agg(F.count("*"), F.sum("target")).first()
    start = _logit(((pos or 0) + 0.5) / (n + 1))
    made: list[Tree] = []
    for _ in range(trees if n else 0):
        score = F.lit(start)
        for tree in made:
            score = score + F.lit(rate) * tree.node_of(F.col("features"), "value")
        left = F.col("target") - F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
        left_over = base.select("features", F.round(left / UNIT).cast("long").alias("target"), F.lit(0).alias("tree"), F.lit(1).cast("long").alias("times"))
        made += grow(left_over, width, "numbers", depth, least_rows)
    return {"algorithm": "gradient_boosting", "trees": [asdict(t) for t in made], "base_score": start, "learning_rate": rate, "feature_importances": importances(made, width)}


def scores(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probabilities, contributions, base) of a matrix's rows by an artifact of any algorithm.

    Base and contributions sum to the score: a probability for a tree or a forest, a logit for
    boosting and logistic regression.
    """
    kind = model.get("algorithm", "logistic_regression")
    sigmoid = lambda s: np.where(s >= 0, 1 / (1 + np.exp(-np.abs(s))), np.exp(-np.abs(s)) / (1 + np.exp(-np.abs(s))))
    if kind == "logistic_regression":
        parts = x * np.array(model["weights"])
        return sigmoid(parts.sum(axis=1) + model["bias"]), parts, float(model["bias"])
    trees = [Tree(**t) for t in model["trees"]]
    if not trees and kind != "gradient_boosting":
        return np.full(len(x), 0.5), np.zeros(x.shape), 0.5
    scale = model["learning_rate"] if kind == "gradient_boosting" else 1 / len(trees)
    parts = sum((t.explained(x) for t in trees), np.zeros(x.shape)) * scale
    base = float(sum(t.value[0] for t in trees) * scale + (model["base_score"] if kind == "gradient_boosting" else 0.0))
    total = sum((t.predicted(x) for t in trees), np.zeros(len(x)))
    return (sigmoid(model["base_score"] + scale * total) if kind == "gradient_boosting" else total / len(trees)), parts, base


FITTED = {"decision_tree": fit_decision_tree, "random_forest": fit_random_forest, "gradient_boosting": fit_gradient_boosting}


def fit(algorithm: str, rows: DataFrame, width: int, **options) -> dict:
    """An artifact of ``rows`` (row_id, features, binary_label) by the named algorithm; unknown names are an error."""
    if algorithm == "logistic_regression":
        from agora.operators import training

        return {"algorithm": algorithm} | training.fit_balanced(rows, width, **options)._asdict()
    if algorithm not in FITTED:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return FITTED[algorithm](rows, width, **options)


def predicted(rows: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """``rows`` with probability, predicted_label, base and contributions (array<double>) by an artifact of any algorithm.

    Batches go down the trees as matrices; the artifact goes to the tasks with the function.
    """
    columns = rows.columns
    kind = rows.withColumns({"probability": F.lit(0.0), "predicted_label": F.lit(0), "base": F.lit(0.0), "contributions": F.array().cast("array<double>")}).schema
    names, clean = kind.names, rows.withColumn("_x", plain_features())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                p, parts, base = scores(model, x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.full(len(x), base)), lists], names)

    return clean.mapInArrow(run, kind)
