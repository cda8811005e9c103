"""Jobs that are started again."""

from agora.operators import lifecycle


def test_restarting_joins_once(spark):
    schema = "job_id long, row_number int, status string, score double, input_url string"
    items = spark.createDataFrame([(1, 1, "failed", 0.5, "a"), (1, 1, "failed", 0.5, "a"), (2, 1, "running", 0.1, "b"), (None, 1, "failed", 1.0, "c"), (3, 1, None, None, None)], schema)
    out = lifecycle.restarted(items, spark.createDataFrame([(1,), (1,), (4,), (None,)], "job_id long"))
    again = (1, 1, "pending", None, "a")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([again, again, (2, 1, "running", 0.1, "b"), (None, 1, "failed", 1.0, "c"), (3, 1, None, None, None)], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
