"""Live pages whose ids are negative, beyond 2^53 or missing."""

import pandas as pd
from pyspark.sql import functions as F
from test_against_sql import agrees
from test_tree_state import Map

from agora.plans import stream_plans
from agora.streaming import trees

STEP = 2**53 + 1


def test_ids_of_any_size_and_sign(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(((F.col("event_id") - 500) * STEP).alias("event_id"), F.when(F.col("event_id") % 50 != 7, F.col("user_id") % 3).alias("user_id"), "event_type", "props")
    agrees(spark, tmp_path, "live_regions", "events", events.schema, events.collect())


def test_the_event_that_is_the_root(spark, tmp_path, sf_dir):
    """Event 0 inserts a page's own node under itself."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.col("event_id") == 0
    events = events.select("event_id", (F.col("user_id") % 2).alias("user_id"), F.when(first, "view").otherwise(F.col("event_type")).alias("event_type"), F.when(first, '{"k": 60}').otherwise(F.col("props")).alias("props"))
    agrees(spark, tmp_path, "live_regions", "events", events.schema, events.collect())


def test_batches_of_negative_seqs():
    """What an older seq says changes nothing, whatever its sign; verdicts and regions name exact ids."""
    states = {}

    class Handle:
        def getMapState(self, name, *_):
            return states.setdefault(name, Map())

    regions = trees.Regions()
    regions.init(Handle())
    columns = "seq kind target node tag name value verdict".split()
    at = -(STEP + 1000)
    new = [(at, "attribute", at, None, None, "class", "comments", "pass"), (at + 1, "attribute", at, None, None, "role", "feed", "pass")]
    new += [(at + k, "insert", at, at + k, "p", None, None, "block") for k in range(2, 20)]
    (out,) = regions.handleInputRows((1,), iter([pd.DataFrame(new, columns=columns, dtype=object)]), None)
    assert out.iloc[0][["node", "change", "size", "children"]].tolist() == [at, "found", 18, 18] and round(out.iloc[0].raw, 9) == 0.68
    assert out.seq[1:].tolist() == [at + k for k in range(2, 20)] and out.node.unique().tolist() == [at]
    old = [(at - 1, "attribute", at, None, None, "class", "price", "pass"), (at - 1, "remove", 0, at + 5, None, None, None, "pass")]
    (out,) = regions.handleInputRows((1,), iter([pd.DataFrame(old, columns=columns, dtype=object)]), None)
    assert out.empty


def test_verdicts_name_exact_seqs(spark):
    log = [(1, STEP, "attribute", STEP, None, None, "class", "comments"), (1, STEP + 1, "attribute", STEP, None, None, "role", "feed")]
    log += [(1, STEP + k, "insert", STEP, STEP + k, "p", None, "<script>" if k == 10 else "<p>") for k in range(2, 20)]
    out = stream_plans.followed(spark, spark.createDataFrame(log, trees.MUTATION)).collect()
    assert [(r.node, r.seq, r.action) for r in out if r.action] == [(STEP, STEP + 10, "block")]
