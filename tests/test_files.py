import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import modeling, store, training
from agora.sources import files


def test_records(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿Name,Web Site,URL\n"a, ""b""\nc",x,example.com/p\n,,\nd,y,//e.org\n', encoding="utf-8")
    got = files.records(spark, str(path)).collect()
    assert [(r["name"], r.normalized_url) for r in got] == [('a, "b"\nc', "https://example.com/p"), ("d", "https://e.org")]
    with pytest.raises(ValueError):
        files.records(spark, str(path), "nope")


def test_url_column():
    assert files.url_column(["name", "href", "site"]) == "site"
    assert files.url_column(["a", "b"]) == "a"


def test_backup_round_trip(spark, tmp_path):
    jobs = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, status string")
    files.write_backup({"jobs": jobs}, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b/jobs"))
    assert files.restored({"jobs": jobs.where("id = '1'")}, {"jobs": back})["jobs"].count() == 1


def test_artifact(spark, tmp_path):
    files.write_artifact(spark, {"w": [1.5, 2], "name": "é"}, str(tmp_path / "m"))
    assert files.read_artifact(spark, str(tmp_path / "m")) == {"w": [1.5, 2], "name": "é"}


def test_categorized(spark):
    lines = spark.createDataFrame([("l", 1, "News"), ("l", 2, "1. a.com"), ("l", 3, "2) b.com"), ("l", 4, "Shops"), ("l", 5, "1. c.com")], "list_id string, line_no int, line string")
    assert [(r.category, r.entry) for r in files.categorized(lines).orderBy("line_no").collect()] == [("News", "a.com"), ("News", "b.com"), ("Shops", "c.com")]


def test_idempotent_append(spark):
    schema = "id int, job_id int, event_key string, created_at int"
    held = spark.createDataFrame([(1, 1, "a", 1), (2, 1, None, 2)], schema)
    fresh = spark.createDataFrame([(3, 1, "a", 3), (4, 1, None, 4), (5, 2, "a", 5)], schema)
    assert sorted(r.id for r in store.appended_once(held, fresh).collect()) == [1, 2, 4, 5]


def test_resampling(spark):
    rows = spark.range(1000).selectExpr("id", "IF(id % 10 = 0, 1, 0) AS binary_label")
    count = lambda s: {r[0]: r[1] for r in modeling.resampled(rows, s, "id").groupBy("binary_label").count().collect()}
    assert count("baseline") == {0: 900, 1: 100} and count("undersample") == {0: 100, 1: 100} and count("oversample") == {0: 900, 1: 900}
    odd = spark.range(97).selectExpr("id", "IF(id % 10 = 0, 1, 0) AS binary_label")
    assert {r[0]: r[1] for r in modeling.resampled(odd, "oversample", "id").groupBy("binary_label").count().collect()} == {0: 87, 1: 87}
    assert {r[0]: r[1] for r in modeling.class_prefix(odd, 0.25, "id").groupBy("binary_label").count().collect()} == {0: 22, 1: 3}


def test_hash_ranks_are_gapless(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 AS binary_label")
    for label, ranks in ((k, [r.hash_rank for r in modeling.hash_rank(rows, "id", ["binary_label"]).where(f"binary_label = {k}").collect()]) for k in range(3)):
        assert sorted(ranks) == list(range(1, len(ranks) + 1)), label


def test_logistic_learns(spark):
    rows = spark.range(200).selectExpr("array((id - 100) / 50.0D) AS features", "IF(id > 100, 1, 0) AS binary_label")
    model = training.fit_balanced(rows, 1, 60)
    assert model.loss[-1] < model.loss[0] and model.weights[0] > 0


def test_synthetic_rows_of_all_kinds(spark):
    rows = spark.createDataFrame([(k, [float(k), 0.0], float(k) if k else None, k % 2 == 0 if k % 3 else None, "abc"[k % 3] if k % 4 else None) for k in range(12)], "id long, features array<double>, size double, deep boolean, kind string")
    held = {r.id: r for r in rows.collect()}
    made = modeling.smote_rows(rows, ["size"], ["deep"], ["kind"], extra=40, k=3).collect()
    assert len(made) == 40 and len({r.dataset_row_id for r in made}) == 40
    for r in made:
        a, b, t = held[r.source_row_id], held[r.neighbor_row_id], r.alpha
        assert a.id != b.id and abs(r["size"] - round((a["size"] or 0) + ((b["size"] or 0) - (a["size"] or 0)) * t, 6)) < 2e-6
        assert r.deep == bool(a.deep if t < 0.5 else b.deep) and r.kind == ((a.kind or "") if t < 0.5 or not b.kind else b.kind)


def test_nearest(spark):
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(30)], "id long, features array<double>")
    got = modeling.nearest(rows, 2, most=7).where("id = 10").orderBy("rank").collect()
    assert [(r.near_id, r.distance) for r in got] == [(9, 1.0), (11, 1.0)]


@pytest.mark.parametrize("most", [40, 1 << 15])
def test_nearest_like_brute_force(spark, most):
    """Whatever the blocks, distances are those of plain differences, ties by id among them."""
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(150, 3)) * 2) / 2 + 1e6  # ties, far from zero
    got = {}
    for r in modeling.nearest(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, features array<double>"), 4, most).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.near_id, r.distance)
    for k, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        d[k] = np.inf
        want = [(int(j), float(d[j])) for j in np.lexsort((np.arange(len(d)), d))[:4]]
        assert [got[k][n] for n in (1, 2, 3, 4)] == want


def test_synthetic_rows(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "id long, features array<double>")
    made = modeling.smote(rows, extra=23, k=3).collect()
    assert len(made) == 23 and all(min(r.id, r.near_id) <= r.features[0] <= max(r.id, r.near_id) and r.features[1] == 1.0 for r in made)
    assert sorted(modeling.smote(rows, extra=3).select("id").toPandas().id.value_counts()) == [1, 1, 1]


def labelled(spark, n=300):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.25)
        rows.append((k, f"host{k % 12}", y, float(rng.normal(2.0 * y)), float(rng.normal()), "ab"[int(rng.random() < 0.5)]))
    return spark.createDataFrame(rows, "dataset_row_id long, item_id string, binary_label int, x double, z double, c string")


def test_many_models_like_one(spark):
    """Each of several models at once is what plain gradient descent on its own rows gives."""
    rows = labelled(spark)
    held, width = training.features(rows, ["x", "z"], ["c"])
    held = held.withColumn("learns", F.array(F.lit(True), F.col("dataset_row_id") % 2 == 0)).withColumn("shares", F.transform("learns", lambda x: x.cast("double")))
    models = training.fit(held, *training.scales(held, width, 2, 2), iterations=40)
    data = rows.toPandas()
    for k, some in ((0, data), (1, data[data.dataset_row_id % 2 == 0])):
        raw = np.column_stack([some.x, some.z, some.c == "a", some.c == "b"]).astype(float)
        center, scale = np.r_[raw[:, :2].mean(0), 0, 0], np.r_[raw[:, :2].std(0), 1, 1]
        x, y, w, b = (raw - center) / scale, some.binary_label.to_numpy(), np.zeros(4), 0.0
        for _ in range(40):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            w, b = w - 0.08 * (x.T @ (p - y) / len(y) + 5e-4 * w), b - 0.08 * (p - y).mean()
        assert np.allclose(models[k].weights, w / scale) and np.isclose(models[k].bias, b - (w * center / scale).sum())


def test_balanced_like_the_plain_fit(spark):
    rows = spark.range(200).selectExpr("array((id - 100) / 50.0D) AS features", "IF(id > 130, 1, 0) AS binary_label")
    found = training.fit_balanced(rows, 1, 12)
    x = (np.arange(200) - 100) / 50
    y = (np.arange(200) > 130).astype(float)
    each, w, b = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum())), 0.0, 0.0
    for _ in range(12):
        error = each * (1 / (1 + np.exp(-(x * w + b))) - y)
        w, b = w - 0.08 * ((x * error).mean() + 5e-4 * w), b - 0.08 * error.mean()
    assert np.allclose(found.weights, [w]) and np.isclose(found.bias, b)


def test_folds_curves_and_strategies(spark):
    rows, columns = labelled(spark), (F.col("item_id"), "dataset_row_id", ["x", "z"], ["c"])
    folds = training.cross_validated(rows, *columns, iterations=60).collect()
    assert sum(r.n_rows for r in folds) == 300 and all(r.roc_auc > 0.8 and r.n_rows + r.train_rows == 300 and r.best_f1 >= r.f1 for r in folds)
    curve = training.learning_curve(rows, *columns, fractions=(0.5, 1.0), iterations=40).collect()
    assert {(r.fraction, r.part) for r in curve} == {(f, p) for f in (0.5, 1.0) for p in ("train", "test")}
    sizes = {(r.fraction, r.part): r.n_rows for r in curve}
    assert sizes[0.5, "test"] == sizes[1.0, "test"] and abs(sizes[0.5, "train"] - sizes[1.0, "train"] / 2) <= 1
    found = training.compared(rows, *columns, iterations=60)
    by = {r.strategy: r for r in found.collect()}
    assert set(by) == set(training.STRATEGIES) and by["oversample"].recall > by["baseline"].recall
    board = {r.metric: r for r in training.leaderboard(found).collect()}
    assert board["recall"].value == max(r.recall for r in by.values()) and board["f1"].strategy in by
