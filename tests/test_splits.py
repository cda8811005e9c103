"""Exact trees, boosting and forests against plain ones; sampling by weight."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import sampling, splits


def gini(n, s):
    p = s / n
    return 1.0 - p * p - (1.0 - p) * (1.0 - p)


def plain_split(x, t, kind):
    n, s = len(t), int(t.sum())
    best = (splits.LEAST_GAIN, None, None)
    for f in range(x.shape[1]):
        values = sorted(set(x[:, f]))
        for v, nv in zip(values, values[1:]):
            left = x[:, f] <= v
            nl, sl = int(left.sum()), int(t[left].sum())
            nr, sr = n - nl, s - sl
            if kind == "classes":
                gain = gini(n, s) - (nl / n) * gini(nl, sl) - (nr / n) * gini(nr, sr)
            else:
                a, b, c = float(sl), float(sr), float(s)
                gain = (a * a / nl + b * b / nr - c * c / n) * (splits.UNIT * splits.UNIT)
            if gain > best[0]:
                best = (gain, f, (v + nv) / 2)
    return best


def plain_tree(x, t, kind, depth, least_rows=4):
    scale = 1.0 if kind == "classes" else splits.UNIT
    node = {"value": int(t.sum()) * scale / len(t), "n": len(t)}
    if depth and len(t) >= least_rows:
        gain, f, cut = plain_split(x, t, kind)
        if f is not None:
            left = x[:, f] <= cut
            node |= {"feature": f, "threshold": cut, "left": plain_tree(x[left], t[left], kind, depth - 1, least_rows), "right": plain_tree(x[~left], t[~left], kind, depth - 1, least_rows)}
    return node


def nested(tree, node=0):
    out = {"value": tree.value[node], "n": tree.n[node]}
    if tree.feature[node] >= 0:
        out |= {"feature": tree.feature[node], "threshold": tree.threshold[node], "left": nested(tree, tree.left[node]), "right": nested(tree, tree.right[node])}
    return out


def table_of(k):
    """Five tables: continuous, few values with many ties, one class, xor with constant columns, and repeated rows."""
    draw = np.random.default_rng(k)
    x = draw.normal(size=(150, 3)).round(3) if k == 0 else draw.integers(0, 4, (150, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=150) > 1).astype(int)
    if k == 2:
        y[:] = 1
    if k == 3:
        x[:, 2], y = 7.0, (x[:, 0] > 1).astype(int) ^ (x[:, 1] > 1).astype(int)
    if k == 4:
        x, y = np.repeat(x[:20], 8, axis=0), np.repeat(y[:20], 8)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(k, [float(v) for v in row], int(label)) for k, (row, label) in enumerate(zip(x, y))], "row_id long, features array<double>, binary_label int").repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_tree_like_a_plain_one(spark, k):
    x, y = table_of(k)
    model = splits.fit("decision_tree", frame(spark, x, y), 3)
    assert nested(splits.Tree(**model["trees"][0])) == plain_tree(x, y, "classes", 6)


def test_ranges_change_nothing(spark):
    for k in (0, 1):
        x, y = table_of(k)
        rows = frame(spark, x, y).select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("times"), "features", F.col("binary_label").cast("long").alias("target"))
        assert nested(splits.grow(rows, 3, range_rows=20)[0]) == plain_tree(x, y, "classes", 6)


def test_numbers_and_several_trees(spark):
    x, _ = table_of(1)
    draw = np.random.default_rng(3)
    target = draw.integers(-(1 << 30), 1 << 30, 150)
    times = draw.integers(0, 3, (3, 150))
    rows = spark.createDataFrame([(t, int(times[t, k]), x[k].tolist(), int(target[k])) for t in range(3) for k in range(150) if times[t, k]], "tree int, times long, features array<double>, target long")
    made = splits.grow(rows, 3, "numbers", depth=3, trees=3)
    for t, tree in enumerate(made):
        again = np.repeat(np.arange(150), times[t])
        assert nested(tree) == plain_tree(x[again], target[again], "numbers", 3)


def test_boosting_like_plain(spark):
    x, y = table_of(0)
    model = splits.fit("gradient_boosting", frame(spark, x, y), 3, trees=5)
    base = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    assert abs(model["base_score"] - base) < 1e-12
    score = np.full(len(y), base)
    for made in model["trees"]:
        left = np.round((y - 1 / (1 + np.exp(-score))) / splits.UNIT).astype(np.int64)
        tree = splits.Tree(**made)
        assert nested(tree) == plain_tree(x, left, "numbers", 2)
        score = score + 0.1 * tree.predicted(x)
    p, parts, start = splits.scores(model, x)
    assert np.allclose(p, 1 / (1 + np.exp(-score)), atol=1e-12) and np.allclose(start + parts.sum(axis=1), score, atol=1e-9)


@pytest.mark.parametrize("algorithm", ["decision_tree", "random_forest", "gradient_boosting", "logistic_regression"])
def test_artifacts_predict_and_explain(spark, algorithm):
    x, y = table_of(0)
    rows = frame(spark, x, y)
    options = {"random_forest": {"trees": 4, "depth": 3}, "gradient_boosting": {"trees": 3}, "logistic_regression": {"iterations": 20}}.get(algorithm, {})
    model = json.loads(json.dumps(splits.fit(algorithm, rows, 3, **options), default=lambda v: v.tolist()))
    got = splits.predicted(rows, model).collect()
    for r in got:
        total = r.base + sum(r.contributions)
        assert abs((1 / (1 + math.exp(-total)) if algorithm in ("gradient_boosting", "logistic_regression") else total) - r.probability) < 1e-9
        assert r.predicted_label == (r.probability >= 0.5)
    assert np.mean([r.predicted_label == r.binary_label for r in got]) > 0.6
    if "feature_importances" in model:
        assert abs(sum(model["feature_importances"]) - 1) < 1e-5


def test_native_places_are_those_of_walks(spark):
    x, y = table_of(0)
    rows = frame(spark, x, y)
    tree = splits.Tree(**splits.fit("decision_tree", rows, 3)["trees"][0])
    got = {r.row_id: r.p for r in rows.select("row_id", tree.node_of(F.col("features"), "value").alias("p")).collect()}
    assert [got[k] for k in range(len(x))] == tree.predicted(x).tolist()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(k, [None, float("nan")] if k % 2 else [1.0, 2.0], k % 2) for k in range(8)], "row_id long, features array<double>, binary_label int")
    model = splits.fit("decision_tree", rows, 2)
    assert {(r.binary_label, r.probability) for r in splits.predicted(rows, model).collect()} == {(0, 0.0), (1, 1.0)}
    assert splits.fit("decision_tree", rows.limit(0), 2)["trees"][0]["n"] == []
    with pytest.raises(ValueError):
        splits.fit("guess", rows, 2)


def test_bootstrap_is_exact_in_size_and_by_weight(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CELL_ROWS", 64)  # many ranges and cells
    weights = [0.0, 1.0, 2.0, 3.0, 10.0, 0.5, None, float("nan"), -1.0] * 20 + [100.0]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "row_id long, weight double")
    size = 40_000
    drawn = sampling.bootstrap(rows.repartition(5), size, seed=3).cache()
    assert drawn.count() == size and drawn.select("draw").distinct().count() == size and drawn.where("row_id IS NULL").count() == 0
    again = sampling.bootstrap(rows.orderBy(F.desc("row_id")).repartition(2), size, seed=3)
    assert drawn.exceptAll(again).count() == 0
    counts = {r.row_id: r["count"] for r in drawn.groupBy("row_id").count().collect()}
    sound = {k: w for k, w in enumerate(weights) if w is not None and w > 0}
    assert set(counts) <= set(sound)
    total = sum(sound.values())
    chi = sum((counts.get(k, 0) - size * w / total) ** 2 / (size * w / total) for k, w in sound.items())
    free = len(sound) - 1
    assert free - 4 * math.sqrt(2 * free) < chi < free + 4 * math.sqrt(2 * free)


def test_samples_differ_and_none_is_drawn_of_nothing(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.lit(1.0).alias("weight"))
    drawn = sampling.bootstrap(rows, samples=3)
    per = {r["sample"]: (r.n, r.d) for r in drawn.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d")).collect()}
    assert {n for n, _ in per.values()} == {500} and all(280 < d < 350 for _, d in per.values()) and len(per) == 3
    assert sampling.bootstrap(rows.withColumn("weight", F.lit(0.0))).count() == 0 and sampling.bootstrap(rows.limit(0)).count() == 0


def test_class_weighted(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, int(rng.random() < 0.1)) for k in range(3000)], "row_id long, binary_label int")
    r = sampling.class_weighted(rows).join(rows, "row_id").agg(F.count("*").alias("n"), F.avg("binary_label").alias("p")).first()
    assert r.n == 3000 and abs(r.p - 0.5) < 0.04
