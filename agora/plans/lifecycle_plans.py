"""Queries over changes of jobs, items and crawled pages, and over raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators import lifecycle, rawpage, store
from agora.plans.registry import query, table
from agora.plans.store_plans import ITEMS, items

_PAGES = "WITH p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'fetched' ELSE 'failed' END AS status, o_totalprice > 150000 AS is_relevant, o_totalprice / 1000 AS relevance_score, CASE WHEN o_orderpriority LIKE '1%' THEN 'accepted' WHEN o_orderpriority LIKE '2%' THEN 'rejected' END AS user_state, o_orderpriority LIKE '3%' AS include_in_training, CAST(o_custkey % 5 AS INTEGER) AS depth FROM orders)"


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "fetched").otherwise("failed").alias("status"),
        (F.col("o_totalprice") > 150000).alias("is_relevant"),
        (F.col("o_totalprice") / 1000).alias("relevance_score"),
        F.when(first == "1", "accepted").when(first == "2", "rejected").alias("user_state"),
        (first == "3").alias("include_in_training"),
        (F.col("o_custkey") % 5).cast("int").alias("depth"),
    )


@query(ITEMS + " SELECT job_id, row_number, status FROM items WHERE status IN ('failed', 'running')")
def status_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.with_statuses(items(spark, sf_dir), ["failed", " running ", ""]).select("job_id", "row_number", "status")


@query(ITEMS + " SELECT status, count(*) AS n FROM items WHERE status NOT IN ('completed', 'failed') GROUP BY status")
def not_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.without_statuses(items(spark, sf_dir), ["completed", "failed"]).groupBy("status").agg(F.count("*").alias("n"))


@query(ITEMS + " SELECT job_id, row_number, status FROM items WHERE job_id = 7 AND row_number = 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("job_id = 7 AND row_number = 1").select("job_id", "row_number", "status")


_REVIEW = """WITH m AS (SELECT event_id AS row_number, event_type = 'error' AS manual_capture_required, CASE WHEN event_type = 'purchase' THEN 'manual_snapshot' ELSE 'automated' END AS analysis_source, CASE WHEN event_id % 2 = 0 THEN ts END AS manual_captured_at, ts AS updated_at FROM events)"""


@query(_REVIEW + " SELECT row_number, CAST(row_number() OVER (ORDER BY CASE WHEN manual_capture_required THEN 0 ELSE 1 END, coalesce(manual_captured_at, updated_at) DESC, row_number) AS INTEGER) AS place FROM m WHERE manual_capture_required OR analysis_source = 'manual_snapshot' ORDER BY place LIMIT 500")
def manual_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 items that a reviewer sees first."""
    held = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), (F.col("event_type") == "error").alias("manual_capture_required"), F.when(F.col("event_type") == "purchase", "manual_snapshot").otherwise("automated").alias("analysis_source"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("manual_captured_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.col("ts").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    top = store.page(lifecycle.for_review(held), lifecycle.review_order(), 500)
    from pyspark.sql import Window

    return top.select("row_number", F.row_number().over(Window.orderBy(*lifecycle.review_order())).alias("place"))  # 500 rows


@query("SELECT event_id AS id, user_id AS job_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE ts > (SELECT max(ts) - INTERVAL 2 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 500")
def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), "c_name")
    last = held.agg(F.max("created_at")).first()[0]
    since = F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAY")
    return lifecycle.events_since(held, jobs, since, 1000).select("id", "job_id", "c_name")


@query(_PAGES + " SELECT id, relevance_score FROM p WHERE status = 'fetched' AND is_relevant AND relevance_score >= 200 AND user_state IS NULL")
def crawler_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.crawled_pages(crawl_pages(spark, sf_dir), "fetched", True, 200, "none").select("id", "relevance_score")


@query(_PAGES + " SELECT id FROM p WHERE include_in_training AND relevance_score >= 100")
def promotable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.promotable(crawl_pages(spark, sf_dir), only_training=True, least=100).select("id")


@query(_PAGES + " SELECT id, depth FROM p WHERE status = 'pending' ORDER BY depth, id LIMIT 50")
def crawl_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.crawl_claimed(crawl_pages(spark, sf_dir), 50).select("id", "depth")


@query(_PAGES + " SELECT status, user_state, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 THEN 'skipped' ELSE status END AS status, user_state FROM p) GROUP BY ALL")
def whitelisted_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of every third page's status; its other column is none that may be changed."""
    pages = crawl_pages(spark, sf_dir)
    changes = pages.where("id % 3 = 0").select("id", F.lit("skipped").alias("status"), F.lit(99).alias("depth"))
    return lifecycle.updated(pages, changes).groupBy("status", "user_state").agg(F.count("*").alias("n"))


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("row_number") % 2 == 0, F.lit("2024-01-01").cast("date"))
    return items(spark, sf_dir).select((F.col("job_id") * 10 + F.col("row_number")).alias("id"), "job_id", "row_number", "status", "ugc_detected", F.lit(1).alias("attempts"), at.alias("started_at"), F.lit(None).cast("string").alias("error_message"), F.col("updated_at").cast("date").alias("updated_at"), "score")


_NOW = "DATE '2024-06-01'"


@query(ITEMS + f" SELECT status, attempts, started_at, count(*) AS n FROM (SELECT CASE WHEN row_number = 1 THEN 'running' ELSE status END AS status, CASE WHEN row_number = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN row_number % 2 = 0 THEN DATE '2024-01-01' WHEN row_number = 1 THEN {_NOW} END AS started_at FROM items) GROUP BY ALL")
def mark_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _lined(spark, sf_dir)
    out = lifecycle.marked_running(held, held.where("row_number = 1").select("id"), F.lit("2024-06-01").cast("date"))
    return out.groupBy("status", "attempts", "started_at").agg(F.count("*").alias("n"))


_ORDERED = "WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_totalprice AS score FROM orders)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.col("o_totalprice").alias("score"), none("boolean", "ugc_detected"), none("double", "best_score"), none("string", "error_message"), none("date", "completed_at"))


@query(_ORDERED + " SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN score > 150000 END AS ugc_detected, CASE WHEN id % 3 = 0 THEN score END AS best_score, CASE WHEN id % 3 = 0 THEN CASE WHEN score > 150000 THEN '' ELSE 'captcha' END END AS error_message FROM o")
def mark_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _ordered(spark, sf_dir)
    best = F.struct(F.col("score"), F.lit("high").alias("confidence"), F.lit("").alias("ugc_type"))
    results = held.where("id % 3 = 0").select("id", (F.col("score") > 150000).alias("ugc_detected"), best.alias("best_candidate"), F.lit("captcha").alias("access_reason"))
    return lifecycle.marked_completed(held, results, F.lit("2024-06-01").cast("date")).select("id", "status", "ugc_detected", "best_score", "error_message")


@query(_ORDERED + " SELECT id, CASE WHEN id % 3 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN 'timeout' ELSE 'Scan failed' END END AS error_message FROM o")
def mark_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _ordered(spark, sf_dir)
    errors = held.where("id % 3 = 1").select("id", F.when(F.col("id") % 2 == 0, "timeout").otherwise("").alias("error"))
    return lifecycle.marked_failed(held, errors, F.lit("2024-06-01").cast("date")).select("id", "status", "error_message")


@query("SELECT l_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + m AS BIGINT) AS row_number FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber <= 2")
def append_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's first two lines put behind its others once more."""
    held = items(spark, sf_dir).select("job_id", "row_number", "status")
    fresh = held.where("row_number <= 2").select("job_id", "row_number", F.lit("again").alias("input_url"))
    return lifecycle.appended(held, fresh).where("input_url = 'again'").select("job_id", F.col("row_number").cast("long").alias("row_number"))


@query(ITEMS + ", j AS (SELECT job_id, count(*) AS total_urls, CASE WHEN count(*) FILTER (WHERE status = 'pending') = 0 THEN 'completed' ELSE 'running' END AS status FROM items GROUP BY job_id) SELECT CASE WHEN job_id % 4 = 0 AND status = 'completed' THEN 'pending' ELSE status END AS status, count(*) AS jobs, CAST(sum(total_urls + CASE WHEN job_id % 4 = 0 THEN 5 ELSE 0 END) AS BIGINT) AS total_urls FROM j GROUP BY 1")
def reopen_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = items(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("total_urls"), F.when(F.count_if(F.col("status") == "pending") == 0, "completed").otherwise("running").alias("status"))
    added = jobs.where("job_id % 4 = 0").select("job_id", F.lit(5).alias("n"))
    return lifecycle.reopened(jobs, added).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("total_urls").alias("total_urls"))


@query(ITEMS + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN job_id % 4 = 0 THEN 'pending' ELSE status END AS status FROM items) GROUP BY status")
def restart_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = items(spark, sf_dir).select("job_id", "row_number", "status")
    return lifecycle.restarted(held, held.where("job_id % 4 = 0").select("job_id")).groupBy("status").agg(F.count("*").alias("n"))


@query(ITEMS + " SELECT job_id, row_number, CASE WHEN status IN ('pending', 'queued', 'running') THEN 'pending' ELSE status END AS status, status NOT IN ('pending', 'queued', 'running') AS same_id FROM items")
def resume_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _lined(spark, sf_dir).select("id", "job_id", "row_number", "status")
    out = lifecycle.resumed_unfinished(held, "r1")
    return out.select("job_id", "row_number", "status", (F.col("id") == F.col("job_id") * 10 + F.col("row_number")).alias("same_id"))


@query("SELECT 'items' AS name, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT 'jobs', count(*) FROM orders WHERE o_orderkey % 5 <> 0")
def delete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    left = lifecycle.deleted({"items": items(spark, sf_dir), "jobs": jobs}, jobs.where("job_id % 5 = 0"))
    count = lambda name: left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("items").unionByName(count("jobs"))


@query("SELECT count(DISTINCT source) AS jobs, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS human_positive, CAST(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS human_negative, CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inferred_positive, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inferred_negative FROM documents LEFT JOIN labels USING (doc_id)")
def cross_job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.plans.store_plans import label_summary

    return lifecycle.totals(label_summary(spark, sf_dir))


@query("SELECT lang, count(*) AS total, count(*) FILTER (WHERE l = 'ugc') AS ugc, count(*) FILTER (WHERE l = 'not_ugc') AS not_ugc, count(*) FILTER (WHERE l NOT IN ('ugc', 'not_ugc')) AS uncertain, count(*) FILTER (WHERE d) AS detected, count(*) FILTER (WHERE n_chars > 2000) AS gate_passed, count(*) FILTER (WHERE doc_id % 3 = 0) AS repeating_structure FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'not_ugc' WHEN d THEN 'ugc' ELSE 'uncertain' END AS l FROM (SELECT *, n_chars > 1000 AS d FROM documents)) GROUP BY lang")
def heuristic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 4 == 0, "not_ugc").when(F.col("doc_id") % 4 == 1, " ").alias("heuristic_pseudo_label"), (F.col("n_chars") > 1000).alias("detected"), (F.col("n_chars") > 2000).alias("acceptance_gate_passed"), (F.col("doc_id") % 3 == 0).alias("repeated_structure_support"))
    return lifecycle.heuristic_summary(held, ["lang"])


@query("SELECT p_partkey, CASE WHEN b = CAST(p_size AS VARCHAR) THEN b ELSE b || '|' || p_size END AS ids FROM (SELECT *, split_part(p_brand, '#', 2) AS b FROM part)")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids by commas, blanks and line breaks, with one twice."""
    brand, size = F.split("p_brand", "#")[1], F.concat(F.lit(""), F.col("p_size").cast("string"))
    text = F.concat(F.lit(" "), brand, F.lit(", "), size, F.lit("\n"), brand, F.lit(" ,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lifecycle.id_list(text), "|").alias("ids"))


@query("SELECT conv_id, CAST(CASE WHEN conv_id % 4 = 0 THEN max(turn) WHEN conv_id % 4 = 1 THEN least(1, max(turn)) ELSE 0 END AS BIGINT) AS best_turn FROM conversations GROUP BY conv_id")
def best_candidate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key for a fourth of the items, by paths for a fourth, else the first (an unknown key, or no best one)."""
    turn = F.col("turn").cast("string")
    candidate = F.struct(F.col("turn").cast("long").alias("turn"), F.concat(F.lit("k"), turn).alias("candidate_key"), F.concat(F.lit("/x/"), turn).alias("xpath"), F.concat(F.lit("x > "), turn).alias("css_path"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(candidate)).alias("c"), F.max("turn").alias("last"))
    at = F.least(F.lit(1), F.col("last")).cast("string")
    none = F.lit(None).cast("string")
    best = F.when(F.col("conv_id") % 4 == 0, F.struct(F.lit(-1).cast("long").alias("turn"), F.concat(F.lit("k"), F.col("last").cast("string")).alias("candidate_key"), none.alias("xpath"), none.alias("css_path")))
    best = best.when(F.col("conv_id") % 4 == 1, F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("").alias("candidate_key"), F.concat(F.lit("/x/"), at).alias("xpath"), F.concat(F.lit("x > "), at).alias("css_path")))
    best = best.when(F.col("conv_id") % 4 == 2, F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("unknown").alias("candidate_key"), none.alias("xpath"), none.alias("css_path")))
    return held.withColumn("b", best).select("conv_id", lifecycle.best_candidate(F.col("c"), F.col("b"))["turn"].alias("best_turn"))


def _sql(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _feature_sql() -> str:
    held = "coalesce(html, '')"
    data = f"array_to_string(regexp_extract_all({held}, {_sql(rawpage.JSON_LD)}, 1), chr(10))"
    parts = [f"regexp_matches({held}, {_sql(p)}) AS {name}" for name, p in rawpage.FLAGS.items()]
    for name, patterns in rawpage.EXTRACTS.items():
        found = ", ".join(f"nullif(regexp_extract({held}, {_sql(p)}, 1), '')" for p in patterns)
        parts.append(f"lower(coalesce({found}, '')) AS {name}")
    for name, kind in (("json_ld_has_comment_type", "Comment"), ("json_ld_has_comment_action", "CommentAction")):
        pattern = r'"@type"\s*:\s*"' + kind + '"'
        parts.append(f"regexp_matches({data}, {_sql(pattern)}) AS {name}")
    parts.append(f"len(list_filter(regexp_extract_all({held}, {_sql(rawpage.PRELOAD)}), lambda x: regexp_matches(x, '(?i)avatar|profile|user'))) AS preload_avatar_count")
    return f"SELECT page_id, {', '.join(parts)} FROM pages"


@query(_feature_sql())
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in rawpage.features(F.col("html")).items()))


@query("SELECT page_id, p <> '' AS response_has_csp_header, regexp_matches(p, '(?i)script-src') AS response_csp_has_script_src, regexp_matches(p, '(?i)unsafe-inline') AS response_csp_allows_unsafe_inline, regexp_matches(p, '(?i)unsafe-eval') AS response_csp_allows_unsafe_eval FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'default-src self' WHEN 1 THEN 'Script-Src self ''unsafe-inline''' ELSE '' END AS p FROM pages)")
def response_csp(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("page_id") % 3
    policy = F.when(third == 0, F.create_map(F.lit("content-security-policy"), F.lit("default-src self"))).when(third == 1, F.create_map(F.lit("Content-Security-Policy"), F.lit("Script-Src self 'unsafe-inline'"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in rawpage.csp(policy).items()))


_TEXT = "CASE doc_id % 5 WHEN 0 THEN 'Attention Required ' WHEN 1 THEN 'unusual traffic ' WHEN 2 THEN 'Please sign in to continue ' WHEN 3 THEN 'subscribe ' ELSE '' END || text"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(t, {_sql(rawpage.CLOUDFLARE)}) THEN 'cloudflare' WHEN regexp_matches(t, {_sql(rawpage.CAPTCHA)}) THEN 'captcha' WHEN regexp_matches(t, {_sql(rawpage.LOGIN)}) AND regexp_matches(t, {_sql(rawpage.TO_DO)}) THEN 'login_wall' ELSE '' END AS blocker FROM (SELECT doc_id, regexp_replace({_TEXT}, '\\s+', ' ', 'g') AS t FROM documents)")
def access_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Attention Required ", "unusual traffic ", "Please sign in to continue ", "subscribe ", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", rawpage.blocker(F.lit(None).cast("string"), F.concat(said, "text")).alias("blocker"))


@query()
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pages as results of a search, with the beginnings of conversations as snippets."""
    said = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("page_id"), F.col("text").alias("snippet"))
    pages = table(spark, sf_dir, "pages").join(said, "page_id", "left")
    return pages.select("page_id", rawpage.result_score(F.col("url"), F.lit("Comments"), F.col("snippet")).alias("score"))
