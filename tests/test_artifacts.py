"""From labelled candidates to an artifact and scores; rows of exports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import artifacts, splits
from agora.sources import exports, files


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    data = []
    for k in range(240):
        a, kind = float(draw.normal()), ["x", "y", "z"][k % 3]
        label = int(a + (kind == "x") + draw.normal() * 0.3 > 1.2)
        data.append((f"r{k}", f"i{k % 40}", f"h{k % 23}.org", label if k % 11 else None, a, kind))
    return spark.createDataFrame(data, "dataset_row_id string, item_id string, host string, binary_label int, a double, kind string").cache()


@pytest.mark.parametrize("algorithm, strategy", [("logistic_regression", "baseline"), ("logistic_regression", "class_weighted"), ("decision_tree", "class_weighted"), ("gradient_boosting", "undersample"), ("random_forest", "oversample")])
def test_train_and_score(spark, rows, algorithm, strategy):
    options = {"logistic_regression": {"iterations": 60}, "gradient_boosting": {"trees": 3}, "random_forest": {"trees": 3, "depth": 3}}.get(algorithm, {})
    made = artifacts.train(rows, F.col("host"), "dataset_row_id", ["a"], ["kind"], algorithm, strategy, **options)
    made = json.loads(json.dumps(made))
    before, after = ({int(k): v for k, v in made[n].items()} for n in ("counts_before", "counts_after"))
    assert {"baseline": after == before, "class_weighted": sum(after.values()) == sum(before.values()), "undersample": after[0] == after[1] == min(before.values()), "oversample": after[0] == after[1] == max(before.values())}[strategy]
    test = made["metrics"]["test"]
    assert test["roc_auc"] > 0.75 and 0 < test["n_rows"] < made["metrics"]["train"]["n_rows"]
    got = artifacts.scored(rows, made).collect()
    assert len(got) == 240 and all(0 <= r.probability <= 1 and r.predicted_label == (r.probability >= 0.5) for r in got)
    high = artifacts.scored(rows, artifacts.with_threshold(made, 0.9))
    assert all(r.predicted_label == (r.probability >= 0.9) for r in high.collect())
    sums = {r.host: r for r in artifacts.summed(artifacts.scored(rows, made), "host", "dataset_row_id").collect()}
    assert sum(r.candidates for r in sums.values()) == 240
    for host, r in sums.items():
        mine = [x for x in got if x.host == host]
        assert r.best_probability == max(x.probability for x in mine) and r.best_row in {x.dataset_row_id for x in mine if x.probability == r.best_probability}


def test_runtime_scores_alike(spark, rows):
    made = artifacts.train(rows, F.col("host"), "dataset_row_id", ["a"], ["kind"], "decision_tree")
    bundle = json.loads(json.dumps(artifacts.runtime(made)))
    assert [d["index"] for d in bundle["vectorizer"]["descriptors"]] == list(range(bundle["vectorizer"]["dimension"])) == [0, 1, 2, 3]
    stats = bundle["vectorizer"]["numeric_stats"]["a"]
    for r in artifacts.scored(rows, made).collect():
        x = np.array([[(r.a - stats["mean"]) / stats["std"]] + [float(r.kind == d["category"]) for d in bundle["vectorizer"]["descriptors"][1:]]])
        assert splits.scores(bundle["model"], x)[0][0] == r.probability


def test_what_cannot_be_trained(rows):
    for bad in (dict(algorithm="guess"), dict(strategy="hope")):
        with pytest.raises(ValueError, match="unknown"):
            artifacts.train(rows, F.col("host"), "dataset_row_id", ["a"], [], **bad)
    with pytest.raises(ValueError, match="at least 4"):
        artifacts.train(rows.limit(3), F.col("host"), "dataset_row_id", ["a"], [])
    with pytest.raises(ValueError, match="both classes"):
        artifacts.train(rows.where("binary_label = 1"), F.col("host"), "dataset_row_id", ["a"], [])
    with pytest.raises(ValueError, match="between"):
        artifacts.with_threshold({}, 1.5)


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([("j", 1, 'a "b"\nc', None, ["k"])], "job_id string, row_number int, title string, best_score int, candidates array<string>")
    out = exports.item_records(items)
    r = out.first()
    assert len(out.columns) == len(set(out.columns)) == 49 and (r.candidate_count, r.score, r.title, r.blocker_type) == ("1", "", 'a "b"\nc', "")
    files.write_csv(out, str(tmp_path / "items"), exports.ITEM_FIRST)
    back = spark.read.csv(str(tmp_path / "items"), header=True, multiLine=True, escape='"')
    assert back.columns[:7] == exports.ITEM_FIRST and back.columns[7:] == sorted(back.columns[7:]) and back.first().title == 'a "b"\nc'
    data = exports.dataset_records(spark.createDataFrame([("d", 3, 1.5)], "dataset_row_id string, score int, text_length double"), ["text_length", "missing"])
    assert len(data.columns) == 29 and (data.first().score, data.first().text_length, data.first().missing) == ("3", "1.5", "")
