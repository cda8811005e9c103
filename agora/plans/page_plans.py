"""Queries over page structure, reports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.hashing import hash31
from agora.functions.urls import hostname
from agora.operators import discovery, features, scoring
from agora.plans.node_plans import page_nodes
from agora.plans.registry import query, table
from agora.session import written
from agora.sources import files, html
from agora.streaming import streams


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hostname(F.col("url")).alias("host"))


#: What ranks the regions of a page, and their scores.
RANKED = ("page_id", "node", "last", "tag", "unit_count", "total_text_length", "score", "detected")


def candidates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Regions of all pages, some columns of them or all: roots are found first, and features made for them alone."""
    nodes = page_nodes(spark, sf_dir)
    roots = written(discovery.roots(discovery.structured(nodes)), "roots")
    found = scoring.scored(features.regions(nodes, roots, hosts(spark, sf_dir)))
    return written(found.select(*columns) if columns else found, "candidates")


def best(found: DataFrame, most: int = 50) -> DataFrame:
    """Of each page's scored regions the best that do not overlap, with their rank."""
    ranked = discovery.chosen(found, ["score", "unit_count", "total_text_length"], most)
    return found.drop("candidate_rank").join(ranked, ["page_id", "node"])


#: The two structures of the test pages that repeat, in SQL: the list of links, and the article's paragraphs.
_STRUCTURES = r"""WITH h AS (SELECT page_id, regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1) AS u, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
t AS (SELECT page_id, 'ul' AS tag, u AS inner_html, regexp_extract_all(u, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS parts FROM h UNION ALL SELECT page_id, 'article', a, list_transform(string_split(a, '<p>')[2:], lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) FROM h),
d AS (SELECT page_id, tag, len(parts) AS n, len(parts) + (tag = 'article')::INT AS child_count, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS parts,
trim(regexp_replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS words FROM t WHERE len(parts) > 0),
c AS (SELECT *, length(words) AS chars, n / child_count AS same, (CASE WHEN n >= 4 AND n / child_count >= 0.75 THEN 3 ELSE 0 END + CASE WHEN n >= 3 THEN 3 ELSE 0 END + CASE WHEN n >= 8 THEN 2 ELSE 0 END + CASE WHEN child_count > 1 AND n / child_count >= 0.6 THEN 2 ELSE 0 END + (tag = 'ul')::INT + (length(words) >= 200)::INT) AS quick FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY quick DESC, n DESC, chars DESC) AS place FROM c WHERE quick >= 3 AND ((n >= 4 AND same >= 0.75 AND chars >= 20) OR (n >= 3 AND same >= 0.5 AND chars >= 80) OR (child_count >= 4 AND same >= 0.75 AND chars >= 160)))"""
#: Of the rules those that the test pages can meet, written out on their own.
_RULED = _STRUCTURES + r""", f AS (SELECT *, tag = 'ul' AS ul, len(string_split(words, ' ')) AS n_words,
regexp_matches(words, '(?i)\b([0-9]+\s*(s(ec(ond)?s?)?|m(in(ute)?s?)?|h(r|our|ours)?|d(ay|days?)?|w(eek|weeks?)?|mo(nth|nths?)?|y(r|ear|ears)?)\s*ago|just\s*now|today|yesterday|[0-9]+\s*(s|m|h|d|w|mo|y)\b)\b') AS timed,
len(list_filter(parts, lambda x: regexp_matches(x, '(?i)[$€£¥₹]\s*[0-9]|[0-9]\s*[$€£¥₹]|\b[0-9]+\.[0-9]{2}\b|\bprice\b|\bUSD|EUR|GBP\b'))) > 0 AS priced, len(list_filter(parts, lambda x: length(x) < 10)) / n > 0.8 AS bare,
len(list_filter(parts, lambda x: regexp_matches(x, '(?i)\b(deleted|removed|hidden)\]'))) > 0 AS gone, list_sum(list_transform(parts, lambda x: length(x))) / length(words) > 0.75 AS linked FROM r)
SELECT page_id, tag, CAST(2 * (n >= 3)::INT + 3 * (n >= 8)::INT + 4 * (n >= 15)::INT + 3 * (same >= 0.65)::INT + 2 * (NOT ul)::INT + 1 + 2 * (chars > 20 AND n_words >= 40)::INT + 2 * (n >= 4 AND same >= 0.75)::INT + (ul AND n >= 3)::INT + 2 * timed::INT - 4 * priced::INT - 6 * bare::INT - 4 * ul::INT - 2 * (ul AND linked)::INT AS INTEGER) AS score, false AS detected FROM f"""


@query("""WITH d(tag, deepest) AS (VALUES ('html', 0), ('head', 1), ('body', 1), ('meta', 2), ('title', 2), ('style', 2), ('script', 2), ('nav', 2), ('div', 2), ('article', 2), ('footer', 2), ('ul', 3), ('h1', 3), ('p', 3), ('li', 4), ('b', 4), ('a', 5), ('br', 5))
SELECT tag, CAST(sum(len(regexp_extract_all(html, '<' || tag || '[ >]'))) AS BIGINT) AS n, deepest FROM pages, d GROUP BY tag, deepest HAVING n > 0""")
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.nodes(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query()
def dom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("page_id", "node", "tag", "signature", hash31(F.col("signature")).alias("sig_id"), "repeating_group_count", "sibling_homogeneity_score", "text_word_count", "link_density", "sample_text")


@query(_STRUCTURES + " SELECT page_id, tag, CAST(place AS INTEGER) AS candidate_rank, CAST(quick AS INTEGER) AS quick_score, CAST(n AS BIGINT) AS repeated, CAST(child_count AS INTEGER) AS child_count, CAST(chars AS BIGINT) AS text_length FROM r")
def discovered_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.roots(discovery.structured(page_nodes(spark, sf_dir)))
    return found.select("page_id", "tag", "candidate_rank", "quick_score", "repeated", "child_count", "text_length")


@query()
def repeated_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of the mode that takes every repeated structure, overlapping ones too."""
    found = discovery.roots(discovery.structured(page_nodes(spark, sf_dir)), "research")
    return found.select("page_id", "node", "tag", "candidate_rank", "xpath_repeated", "repeated", "quick_score")


@query(_RULED)
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir, "page_id", "tag", "score", "detected")


@query()
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("page_id", "node", "confidence", "ugc_type", "keyword_gate_tier", "heuristic_pseudo_label", F.array_join("matched_signals", ",").alias("matched"), F.array_join("penalty_signals", ",").alias("penalties"))


@query(_RULED.replace("SELECT page_id, tag, CAST(2", ", s AS (SELECT page_id, tag, n, chars, CAST(2").replace(", false AS detected FROM f", " FROM f) SELECT page_id, tag, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n DESC, chars DESC) AS INTEGER) AS candidate_rank, score FROM s"))
def overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(candidates(spark, sf_dir, *RANKED)).select("page_id", "tag", "candidate_rank", "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to regions to rule scores, the best of each page, summed up per host."""
    found = best(candidates(spark, sf_dir, *RANKED), most=5)
    joined = hosts(spark, sf_dir).withColumnRenamed("host", "hostname").join(found.select("page_id", "score", "detected"), "page_id", "left")
    return joined.groupBy("hostname").agg(F.count("score").alias("candidates"), F.count_if("detected").alias("detected"), F.max("score").alias("best_score"))


@query()
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("""SELECT 'overview' AS section, 'all' AS "group", 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'overview', 'all', 'high_total', count(*) FILTER (WHERE o_totalprice > 100000)::DOUBLE FROM orders
UNION ALL SELECT 'overview', 'all', 'urgent', count(*) FILTER (WHERE o_orderpriority LIKE '1%')::DOUBLE FROM orders UNION ALL SELECT 'status', o_orderstatus, 'count', count(*)::DOUBLE FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority, 'count', count(*)::DOUBLE FROM orders GROUP BY o_orderpriority""")
def summary_long_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    one = orders.agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 100000).alias("high_total"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    long = one.unpivot([], ["orders", "high_total", "urgent"], "metric", "value").select(F.lit("overview").alias("section"), F.lit("all").alias("group"), "metric", F.col("value").cast("double").alias("value"))
    count = lambda section, c: orders.groupBy(c).count().select(F.lit(section).alias("section"), F.col(c).alias("group"), F.lit("count").alias("metric"), F.col("count").cast("double").alias("value"))
    return long.unionByName(count("status", "o_orderstatus")).unionByName(count("priority", "o_orderpriority"))


@query("SELECT conv_id AS item_id, count(*) AS item_turns, CAST(max(turn) AS BIGINT) AS last_turn, arg_max(role, turn) AS best_candidate_role FROM conversations GROUP BY conv_id")
def site_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by(F.struct("turn", "role"), "turn").alias("best_candidate"))
    return items.select(F.col("conv_id").alias("item_id"), F.col("n").alias("item_turns"), F.col("best_candidate.turn").alias("last_turn"), F.col("best_candidate.role").alias("best_candidate_role"))


@query("SELECT conv_id AS item_id, turn AS candidate_turn, role AS candidate_role, length(text) AS candidate_chars FROM conversations")
def candidates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("chars"))).alias("candidates"))
    return nested.select(F.col("conv_id").alias("item_id"), F.explode("candidates").alias("c")).select("item_id", F.col("c.turn").alias("candidate_turn"), F.col("c.role").alias("candidate_role"), F.col("c.chars").alias("candidate_chars"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '[\"' || c_mktsegment || '\"]' AS tags FROM customer")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array("c_mktsegment").alias("tags")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.counters(streams.events(spark, sf_dir)), "complete", "counts")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.once(streams.events(spark, sf_dir), ["user_id", "event_type"]), "append", "dedup").select("user_id", "event_type")


@query("""WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, CAST(n AS INTEGER) AS tier, CAST(n AS INTEGER) AS count FROM c WHERE n IN (2, 3, 5, 8, 15) OR (n > 15 AND (n - 15) % 10 = 0)""")
def tier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.promotions(streams.events(spark, sf_dir)), "append", "tiers")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, sid"""


@query(_SESSIONS)
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.drained(streams.windowed(streams.events(spark, sf_dir), "1 day"), "complete", "windows")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.drained(streams.sessions(streams.events(spark, sf_dir), "6 hours"), "complete", "sessions")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
