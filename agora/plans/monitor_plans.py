"""Queries of logs, queues, targets and summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions.numbers import round6
from agora.operators import monitor
from agora.plans.model_plans import SCORED, scored
from agora.plans.registry import query, table

_SQL_TEXT = "CASE event_type WHEN 'click' THEN 'SELECT *  FROM orders o JOIN customer c ON true' WHEN 'error' THEN 'insert into job_events values (1)' WHEN 'view' THEN 'WITH x AS (SELECT 1) SELECT * FROM x' WHEN 'signup' THEN '' ELSE 'UPDATE jobs SET a = 1' END"


@query(f"""SELECT event_id, CASE WHEN t = '' THEN 'UNKNOWN' ELSE upper(string_split(t, ' ')[1]) END AS statement_type, regexp_matches(t, '(?i)^(?:{monitor.WRITES})\\b') AS is_write,
  array_to_string(list_distinct(regexp_extract_all(t, '(?i)\\b(?:from|join|into|update|truncate table|alter table|create table(?: if not exists)?)\\s+([a-zA-Z0-9_."`\\[\\]-]+)', 1)).list_sort(), ',') AS tables, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS token_count
FROM (SELECT event_id, trim(regexp_replace({_SQL_TEXT}, '\\s+', ' ', 'g')) AS t FROM events)""")
def statement_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = monitor.statement(F.expr(_SQL_TEXT))
    parts["tables"] = F.array_join(F.array_sort(parts["tables"]), ",")
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in parts.items()))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END AS item_id FROM events")
def request_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/api/jobs/"), "user_id", F.when(F.col("event_type") == "click", F.concat(F.lit("/items/"), "event_id")).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in monitor.request_target(path).items()))


@query("SELECT o_orderkey, CAST(greatest(0, least(100, floor(o_totalprice / 100000 * 100 + 0.5))) AS BIGINT) AS percent, least(120000.0, greatest(750.0, o_totalprice))::DOUBLE AS delay FROM orders")
def progress_and_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", monitor.percent(F.col("o_totalprice"), F.lit(100000.0)).cast("long").alias("percent"), monitor.clamped(F.col("o_totalprice"), 750.0, 750.0, 120000.0).alias("delay"))


@query("""SELECT item_id, CASE WHEN status <> 'open' THEN status WHEN state = 'active' THEN 'running' WHEN state IN ('waiting', 'delayed') THEN 'queued' ELSE 'pending' END AS status FROM (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'open' END AS status FROM orders) o
LEFT JOIN (SELECT o_orderkey AS k, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'active' WHEN '2' THEN 'waiting' ELSE 'delayed' END AS state FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3')) q ON item_id = k""")
def queue_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    items = orders.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    queue = orders.where(first.isin("1", "2", "3")).select(F.col("o_orderkey").alias("item_id"), F.when(first == "1", "active").when(first == "2", "waiting").otherwise("delayed").alias("state"))
    return monitor.reconciled(items, queue)


@query("""SELECT page_id, CASE WHEN regexp_matches(h, 'stack(?:overflow|exchange)|superuser|serverfault|quora|hackernews|github\\.com/discussions') THEN 'qa' WHEN regexp_matches(h, 'reddit|forum|forums|boards\\.ie|resetera|neogaf|mumsnet|city-data|skool|discourse|phpbb|vbulletin|xenforo|ubuntuforums|steamcommunity') THEN 'forum'
 WHEN regexp_matches(h, 'metacritic|imdb|rottentomatoes|letterboxd|goodreads') THEN 'review' WHEN regexp_matches(h, 'producthunt|indiehackers|growthhackers|fandom|nexusmods|gamefaqs') THEN 'community' ELSE 'article' END AS kind
FROM (SELECT page_id, lower(CASE page_id % 3 WHEN 0 THEN 'forums.' WHEN 1 THEN 'imdb.' ELSE '' END || url) AS h FROM pages)""")
def site_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.when(F.col("page_id") % 3 == 0, "forums.").when(F.col("page_id") % 3 == 1, "imdb.").otherwise(""), "url")
    return table(spark, sf_dir, "pages").select("page_id", monitor.site_kind(host).alias("kind"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error ' || (user_id % 3) WHEN value > 60 THEN '' WHEN event_type = 'signup' THEN 'login wall' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 THEN 'no candidates' ELSE 'not detected' END AS reason FROM events) GROUP BY reason")
def capture_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("user_id") % 3))
    reason = monitor.capture_reason(error, F.col("value") > 60, F.when(F.col("event_type") == "signup", "login wall"), F.get_json_object("props", "$.k").cast("int") % 4)
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, floor(greatest(0, least(1, CASE WHEN q >= 15 THEN 0.25::DOUBLE WHEN q >= 8 THEN 0.2::DOUBLE WHEN q >= 5 THEN 0.15::DOUBLE WHEN q >= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN d >= 0.8 THEN 0.1::DOUBLE WHEN d >= 0.5 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN t >= 0.5 THEN 0.1::DOUBLE WHEN t >= 0.2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN d >= 0.5 THEN 0.1::DOUBLE WHEN d >= 0.2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN t >= 0.4 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN d >= 0.4 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q >= 10 THEN 0.1::DOUBLE WHEN q >= 3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN l_returnflag = 'R' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) * 1e6 + 0.5) / 1e6 AS score
FROM (SELECT *, l_quantity AS q, l_discount * 10 AS d, l_tax * 10 AS t FROM lineitem)""")
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round6(monitor.activity_score(q, d, t, d, t, d, q, F.col("l_returnflag") == "R")).alias("score"))


@query("""WITH m AS (SELECT user_id AS query_id, event_id AS item_id, CAST(floor(value) AS BIGINT) AS score FROM events WHERE event_type = 'click'), s AS (SELECT query_id, count(*) AS n FROM m GROUP BY 1),
g AS (SELECT user_id AS query_id, max(event_id) AS item_id, 90::BIGINT AS score FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY 1), b AS (SELECT *, 0 AS place FROM g UNION ALL SELECT *, 1 FROM m),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY place) AS f FROM b) WHERE f = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, item_id) AS rank FROM u)
SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM r LEFT JOIN s USING (query_id) WHERE rank <= greatest(coalesce(n, 1), 1)""")
def manual_target_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    matches = events.where("event_type = 'click'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.floor("value").alias("score"))
    targets = events.where("event_type IN ('click', 'view')").groupBy(F.col("user_id").alias("query_id")).agg(F.max("event_id").alias("item_id")).withColumns({"lookup_score": F.lit(90).cast("long"), "age_minutes": F.when(F.col("query_id") % 2 == 0, 5).otherwise(90)})
    return monitor.promoted(matches, targets)


@query("""WITH c AS (SELECT doc_id AS id, source || '|' || lang AS signature, CASE WHEN quality = 1 THEN 'comment_region' END AS label FROM documents LEFT JOIN labels USING (doc_id)), l AS (SELECT signature, max(label) AS label FROM c WHERE label IS NOT NULL GROUP BY 1)
SELECT c.id, c.signature, l.label FROM c JOIN l ON c.signature = l.signature WHERE c.label IS NULL""")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.concat_ws("|", "source", "lang").alias("signature"), F.when(F.col("quality") == 1, "comment_region").alias("human_label"), F.lit("human").alias("source"))
    return monitor.inferred(rows, rows.where("human_label IS NOT NULL").groupBy("signature").agg(F.max("human_label").alias("label")))


@query(SCORED + """, i AS (SELECT item_id, count(*) AS n, max(probability) AS top FROM s GROUP BY item_id) SELECT count(*) AS item_count, sum(n)::BIGINT AS candidate_count, count(*) FILTER (WHERE top >= 0.5) AS predicted_positive_item_count, count(*) FILTER (WHERE top > 0.2 AND top < 0.8) AS manual_review_item_count, floor(avg(top) * 1e6 + 0.5) / 1e6 AS mean_top_probability FROM i""")
def scored_items_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scored(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.max("probability").alias("top"))
    top = F.col("top")
    return items.agg(F.count("*").alias("item_count"), F.sum("n").alias("candidate_count"), F.count_if(top >= 0.5).alias("predicted_positive_item_count"), F.count_if((top > 0.2) & (top < 0.8)).alias("manual_review_item_count"), round6(F.avg("top")).alias("mean_top_probability"))


@query(SCORED + """, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY probability DESC, dataset_row_id) AS r FROM s) SELECT item_id, count(*) AS matched, floor(max(probability) * 1e6 + 0.5) / 1e6 AS max_probability, floor(avg(probability) * 1e6 + 0.5) / 1e6 AS mean_probability, array_to_string(list(dataset_row_id ORDER BY r) FILTER (WHERE r <= 3), ',') AS first_rows FROM k GROUP BY item_id""")
def host_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scored(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("probability").desc(), "dataset_row_id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "dataset_row_id")))), lambda x: x["dataset_row_id"].cast("string")), ",")
    return ranked.groupBy("item_id").agg(F.count("*").alias("matched"), round6(F.max("probability")).alias("max_probability"), round6(F.avg("probability")).alias("mean_probability"), first.alias("first_rows"))


@query("""WITH m AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS run, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*) AS f1 FROM events GROUP BY 1) SELECT count(*) AS runs, floor((arg_max(f1, run) - arg_min(f1, run)) * 1e6 + 0.5) / 1e6 AS f1_delta FROM m""")
def model_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).alias("run")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("f1"))
    return runs.agg(F.count("*").alias("runs"), round6(F.max_by("f1", "run") - F.min_by("f1", "run")).alias("f1_delta"))


@query("SELECT event_type, arg_max(user_id, [n, -user_id]) AS best_user, max(n) AS n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def best_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return runs.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", (-F.col("user_id")).alias("o"))).alias("best_user"), F.max("n").alias("n"))


@query("SELECT user_id, count(*) AS n, sum(k)::BIGINT AS k_sum FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id")
def json_recordset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON array, typed and unnested."""
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("props"), ","), F.lit("]")).alias("body"))
    rows = packed.select("user_id", F.inline(F.from_json("body", "array<struct<k:int>>")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("SELECT CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS class, floor(avg(n_chars) * 1e4 + 0.5) / 1e4 AS mean_chars, floor(avg((lang = 'en')::INT) * 1e6 + 0.5) / 1e6 AS share_en FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def class_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy(F.when(F.col("toxic") == 1, "positive").otherwise("negative").alias("class")).agg((F.floor(F.avg("n_chars") * 1e4 + 0.5) / 1e4).alias("mean_chars"), round6(F.avg((F.col("lang") == "en").cast("double"))).alias("share_en"))


@query(SCORED + " SELECT CASE WHEN binary_label = 1 THEN 'ugc' ELSE 'not_ugc' END AS human, CASE WHEN probability >= 0.8 THEN 'ugc' WHEN probability > 0.2 THEN 'uncertain' ELSE 'not_ugc' END AS system, count(*) AS n FROM s GROUP BY 1, 2")
def human_system_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probability")
    return scored(spark, sf_dir).groupBy(F.when(F.col("binary_label") == 1, "ugc").otherwise("not_ugc").alias("human"), F.when(p >= 0.8, "ugc").when(p > 0.2, "uncertain").otherwise("not_ugc").alias("system")).agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each key, as a minimum by order, which sums up before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT o_orderkey, n AS total, o_totalprice FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"))
    return table(spark, sf_dir, "orders").join(counts, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "total", "o_totalprice")
