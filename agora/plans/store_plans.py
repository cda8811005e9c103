"""Queries over jobs, items and events: orders stand for jobs, their lines for items, events for job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.operators import store
from agora.plans.registry import query, table
from agora.sources import exports


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "pending").otherwise("running")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("row_number"), status.alias("status"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.05).alias("ugc_detected"), F.col("l_shipdate").alias("updated_at"), F.col("l_quantity").alias("score"))


ITEMS = """WITH items AS (SELECT l_orderkey AS job_id, l_linenumber AS row_number,
  CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'running' END AS status,
  CASE WHEN l_tax > 0.02 THEN l_discount > 0.05 END AS ugc_detected, l_shipdate AS updated_at, l_quantity AS score FROM lineitem)"""


@query("""SELECT s.source AS job_id, coalesce(human_positive, 0) AS human_positive, coalesce(human_negative, 0) AS human_negative, coalesce(inferred_positive, 0) AS inferred_positive, coalesce(inferred_negative, 0) AS inferred_negative
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (
  SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS human_positive, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS human_negative,
    count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS inferred_positive, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS inferred_negative
  FROM documents JOIN labels USING (doc_id) GROUP BY source) c ON s.source = c.source""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("job_id"))
    reviews = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("job_id", F.when(F.col("quality") == 1, "comment_region").otherwise("not_comment_region").alias("label"), F.when(F.col("toxic") == 1, "inferred").otherwise("human").alias("source"))
    return store.label_summary(docs.select("job_id").distinct(), reviews)


@query(ITEMS + """, counts AS (SELECT job_id, count(*) AS total_urls, count(*) FILTER (WHERE status = 'pending') AS pending_count, count(*) FILTER (WHERE status = 'queued') AS queued_count, count(*) FILTER (WHERE status = 'running') AS running_count,
  count(*) FILTER (WHERE status = 'completed') AS completed_count, count(*) FILTER (WHERE status = 'failed') AS failed_count, count(*) FILTER (WHERE coalesce(ugc_detected, false)) AS detected_count FROM items GROUP BY job_id)
SELECT *, CASE WHEN completed_count + failed_count = total_urls AND failed_count = total_urls THEN 'failed' WHEN completed_count + failed_count = total_urls AND failed_count > 0 THEN 'completed_with_errors'
  WHEN completed_count = total_urls THEN 'completed' WHEN running_count > 0 OR completed_count > 0 OR failed_count > 0 THEN 'running' WHEN queued_count > 0 THEN 'queued' ELSE 'pending' END AS status FROM counts""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recomputed(items(spark, sf_dir))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM lineitem) AS items, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS failed_items, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished_jobs""")
def db_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("finished_jobs"))
    lines = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("failed_items"))
    return jobs.crossJoin(lines).crossJoin(table(spark, sf_dir, "events").agg(F.count("*").alias("events")))  # one row each


@query("""SELECT doc_id, lang, source FROM documents WHERE (lower(coalesce(text, '')) LIKE '%the%' OR lower(coalesce(lang, '')) LIKE '%the%' OR lower(coalesce(source, '')) LIKE '%the%')
  AND (lower(coalesce(text, '')) LIKE '%src1%' OR lower(coalesce(lang, '')) LIKE '%src1%' OR lower(coalesce(source, '')) LIKE '%src1%')""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(table(spark, sf_dir, "documents"), "the SRC1", ["text", "lang", "source"]).select("doc_id", "lang", "source")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), '1')""")
def search_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search_joined(table(spark, sf_dir, "customer"), "build 1", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query(ITEMS + " SELECT job_id, count(*) AS n FROM items WHERE status = 'completed' AND coalesce(ugc_detected, false) = false GROUP BY job_id")
def filter_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(store.item_filter(detected=False, status="completed")).groupBy("job_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 100)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), [F.col("ts").desc(), F.col("event_id").desc()], 20)


@query("SELECT coalesce(c_mktsegment, 'unknown') AS segment, event_type, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2")
def events_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return per_user.join(people, per_user.user_id == people.c_custkey, "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"), "event_type").agg(F.sum("n").alias("n"))


@query("SELECT n_name, count(c_custkey) AS items, coalesce(floor(max(c_acctbal) * 100 + 0.5) / 100, 0) AS top FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) c ON n_nationkey = c_nationkey GROUP BY n_name")
def dim_preserving_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("items"), F.max("c_acctbal").alias("top"))
    joined = table(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce(F.floor(F.col("top") * 100 + 0.5) / 100, F.lit(0.0)).alias("top"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def known_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unseen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(json_extract_string(props, '$.k')) AS k_count FROM events GROUP BY event_type")
def json_path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def unnest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    per = nested.select("conv_id", F.explode("roles").alias("role")).groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return per.groupBy("role").agg(F.sum("n").alias("turns"), F.count("*").alias("conversations"))


@query(ITEMS + " SELECT job_id, row_number FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY row_number) AS r FROM items WHERE status = 'pending') WHERE r <= 2")
def claim_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claimed(items(spark, sf_dir), 2).select("job_id", "row_number")


def _keyed(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_key"), F.col("ts").alias("created_at"))


@query("""WITH e AS (SELECT event_id AS id, user_id AS job_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_key, ts AS created_at FROM events),
b AS (SELECT *, 0 AS n FROM e UNION ALL SELECT *, 1 FROM e WHERE event_key = 'click')
SELECT id, job_id, event_key FROM (SELECT *, row_number() OVER (PARTITION BY job_id, event_key ORDER BY n, created_at, id) AS r FROM b WHERE event_key IS NOT NULL) WHERE r = 1 UNION ALL SELECT id, job_id, event_key FROM b WHERE event_key IS NULL""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _keyed(table(spark, sf_dir, "events"))
    return store.appended_once(held, held.where("event_key = 'click'")).select("id", "job_id", "event_key")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.upserted(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), ["user_id"], "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return store.inserted_if_absent(rows.where("c_mktsegment = 'BUILDING'").drop("c_mktsegment"), rows.drop("c_mktsegment"), ["c_custkey"])


@query("""SELECT source_ord, s_key, row_number() OVER (ORDER BY source_ord, s_key) AS row_number FROM (SELECT 0 AS source_ord, s_suppkey AS s_key FROM supplier UNION ALL SELECT 1, c_custkey FROM customer)""")
def combine_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s_key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_key"))]
    return store.combined(parts, ["s_key"])


@query(ITEMS + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('running', 'queued') AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status FROM items) GROUP BY status")
def stale_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stale_failed(items(spark, sf_dir), F.expr("timestamp_ntz'1998-01-01'")).groupBy("status").agg(F.count("*").alias("n"))


@query(ITEMS + " SELECT CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, count(*) FILTER (WHERE status = 'failed') AS resumed, count(*) AS n FROM items GROUP BY 1")
def resume_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumns({"attempts": F.when(F.col("status") == "failed", 2).otherwise(1), "error_message": F.when(F.col("status") == "failed", "timeout")})
    return store.resumed(rows).groupBy("status").agg(F.count_if(F.col("attempts") == 0).alias("resumed"), F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def keep_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.kept_last(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("event_id", "user_id")


@query("""SELECT event_type, user_id % 10 AS shard, count(*) AS calls, count(*) FILTER (WHERE value < 5) AS active, count(*) FILTER (WHERE event_type = 'error') AS errors, floor(sum(value) * 100 + 0.5) / 100 AS total_ms, floor(max(value) * 100 + 0.5) / 100 AS max_ms,
  floor(avg(value) * 100 + 0.5) / 100 AS avg_ms, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 10)
    out = store.hotspots(log, ["event_type", "shard"], F.col("event_type") == "error", F.col("value") < 5, "value", "ts")
    return out.withColumns({c: F.floor(F.col(c) * 100 + 0.5) / 100 for c in ("total_ms", "max_ms", "avg_ms")})


@query("SELECT CAST(floor((rn - 1) / 100) AS BIGINT) AS chunk, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, c_custkey AS rn FROM customer) GROUP BY 1")
def promote_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(store.chunk_of(F.col("c_custkey"), 100).alias("chunk")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query(ITEMS + " SELECT job_id, least(count(*) FILTER (WHERE status = 'pending'), greatest(0, 3 - count(*) FILTER (WHERE status = 'running'))) AS fill FROM items GROUP BY job_id")
def refill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = items(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("status") == "pending").alias("p"), F.count_if(F.col("status") == "running").alias("r"))
    return jobs.select("job_id", store.refill(F.col("p"), F.col("r"), F.lit(3)).alias("fill"))


@query("SELECT user_id, event_type AS status, n, rank FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank = 1")
def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "status")).cast("long")).where("rank = 1")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS job_id, CAST(o_orderkey AS VARCHAR) AS row_number, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '0' END AS candidate_count, CASE WHEN o_orderkey % 5 = 0 THEN 'wall' ELSE '' END AS blocker_type, CAST(o_orderkey % 7 AS VARCHAR) AS candidate_review_count, '' AS screenshot_url, 49 AS width FROM orders""")
def items_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of their customers' jobs, as rows of the items' export."""
    key = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), key.alias("row_number"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("status"),
        F.when(key % 2 == 0, F.array("o_orderkey", "o_custkey")).alias("candidates"), F.struct(F.when(key % 5 == 0, "wall").alias("blocker_type")).alias("scan_result"), F.struct((key % 7).alias("total")).alias("candidate_review_summary"),
    )
    rows = exports.item_records(items)
    return rows.select("job_id", "row_number", "title", "status", "candidate_count", "blocker_type", "candidate_review_count", "screenshot_url", F.lit(len(rows.columns)).alias("width"))


@query("""SELECT url, CASE WHEN page_id % 2 = 0 THEN 't' ELSE '' END AS title, CAST(page_id % 5 AS BIGINT) AS depth, (page_id % 4) / 4.0::DOUBLE AS relevance_score, CASE page_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' ELSE '' END AS matched_categories FROM pages WHERE page_id % 7 <> 0 AND (page_id % 4) / 4.0 >= 0.5""")
def crawl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("url", F.when(key % 2 == 0, "t").alias("title"), (key % 5).alias("depth"), ((key % 4) / 4).alias("relevance_score"), (key % 7 != 0).alias("is_relevant"), F.when(key % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(key % 3 == 1, F.array(F.lit("a"))).alias("matched_categories"))
    return exports.crawl_records(pages, 0.5)
