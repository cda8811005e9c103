"""Queries over reviews, crawl addresses and places of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import urls
from agora.functions.text import title_of
from agora.operators import dom, metrics, reviews, shape
from agora.plans.model_plans import SCORED, scored
from agora.plans.page_plans import candidates
from agora.plans.registry import query, table
from agora.sources import html

_LOG = "CASE event_type WHEN 'click' THEN 'comment_region' WHEN 'view' THEN 'not_comment_region' WHEN 'purchase' THEN 'uncertain' WHEN 'error' THEN '' ELSE 'other' END"
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_ORIGIN = r"lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1))"


@query(f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE label = 'comment_region') AS comment_region, count(*) FILTER (WHERE label = 'not_comment_region') AS not_comment_region, count(*) FILTER (WHERE label = 'uncertain') AS uncertain
FROM (SELECT user_id, {_LOG} AS label FROM events) GROUP BY user_id""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.summary(table(spark, sf_dir, "events").select("user_id", F.expr(_LOG).alias("label")), ["user_id"])


@query(f"""WITH l AS (SELECT user_id, event_id, {_LOG} AS label FROM events), c AS (SELECT user_id, max(event_id) FILTER (WHERE label = '') AS cut FROM l GROUP BY 1)
SELECT user_id, arg_max(label, event_id) AS label, min(event_id) AS created_at, max(event_id) AS updated_at FROM l JOIN c USING (user_id) WHERE label <> '' AND (cut IS NULL OR event_id > cut) GROUP BY user_id""")
def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_LOG).alias("label"))
    return reviews.folded(log, ["user_id"], "event_id")


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'comment_region' ELSE 'not_comment_region' END AS label, CASE WHEN toxic = 1 THEN 'human_review' ELSE 'inferred' END AS source FROM labels), f AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'comment_region' ELSE 'uncertain' END AS found FROM documents)
SELECT coalesce(r.doc_id, f.doc_id) AS doc_id, CASE WHEN found IS NOT NULL AND coalesce(source, 'inferred') = 'inferred' THEN found ELSE label END AS label, CASE WHEN found IS NOT NULL AND coalesce(source, 'inferred') = 'inferred' THEN 'inferred' ELSE source END AS source FROM r FULL JOIN f ON r.doc_id = f.doc_id""")
def bulk_inferred_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "comment_region").otherwise("not_comment_region").alias("label"), F.when(F.col("toxic") == 1, "human_review").otherwise("inferred").alias("source"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "comment_region").otherwise("uncertain").alias("label"))
    return reviews.inferred_over(held, found, ["doc_id"])


@query("SELECT conv_id, count(*) AS candidates, 0::BIGINT AS with_path, sum(turn)::BIGINT AS ranks FROM conversations GROUP BY conv_id")
def clear_artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("screenshot_path"))).alias("candidates"))
    each = reviews.without_artifacts(items, "candidates", ["screenshot_path"]).select("conv_id", F.inline("candidates"))
    return each.groupBy("conv_id").agg(F.count("*").alias("candidates"), F.count("screenshot_path").alias("with_path"), F.sum("turn").cast("long").alias("ranks"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS pending, count(*) FILTER (WHERE event_type = 'view') AS crawling, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE value > 50) AS relevant, count(*) AS total FROM events GROUP BY user_id""")
def crawler_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("signup").alias("pending"), of("view").alias("crawling"), of("purchase").alias("done"), of("error").alias("failed"), F.count_if(F.col("value") > 50).alias("relevant"), F.count("*").alias("total"))


@query("SELECT event_id, coalesce(epoch_ms(try_cast(t AS TIMESTAMP)), 0) AS at_ms FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a time' WHEN event_type = 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)")
def timestamp_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "not a time").when(F.col("event_type") != "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0)).alias("at_ms"))


@query(rf"""SELECT page_id, substr(CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#]+') THEN regexp_replace({_ORIGIN} || {_PATH} || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1), '/$', '') ELSE url END, 1, 200) AS url_key FROM pages""")
def store_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.store_key(F.col("url")).alias("url_key"))


@query(rf"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '(?i)^https?://[^/?#]+') THEN '' ELSE {_ORIGIN} || CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS candidate_url
FROM (SELECT page_id, url, {_PATH} AS p, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '{urls.KEPT}')) AS k FROM pages)""")
def candidate_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.candidate_url(F.col("url")).alias("candidate_url"))


_PARTS = r"list_filter(string_split(p, '/'), lambda x: x <> '')"


@query(rf"""SELECT page_id, CAST(CASE WHEN NOT regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]+') THEN -100 ELSE
  CASE WHEN len({_PARTS}) = 0 THEN -4 ELSE 0 END + CASE WHEN len({_PARTS}) >= 2 THEN 3 ELSE 0 END + CASE WHEN len({_PARTS}) >= 3 THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(p, '{urls.ARTICLE_PATH}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(p, '{urls.POSITIVE_PATH}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(p, '\d{{4}}/\d{{2}}/\d{{2}}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(p, '\d{{5,}}') THEN 3 ELSE 0 END
  + CASE WHEN contains(coalesce({_PARTS}[-1], ''), '-') THEN 2 ELSE 0 END + CASE WHEN length(t) >= 24 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p, '{urls.NEGATIVE_PAGE}') THEN -16 ELSE 0 END + CASE WHEN regexp_matches(t, '{urls.NEGATIVE_PAGE}') THEN -12 ELSE 0 END
  + CASE WHEN regexp_matches(p, '{urls.TOPIC_END}') THEN -3 ELSE 0 END + CASE WHEN regexp_matches(p, '{urls.SECTION_END}') THEN -4 ELSE 0 END END AS INTEGER) AS path_score
FROM (SELECT page_id, url, lower({_PATH}) AS p, lower(substr(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200)) AS t FROM pages)""")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.path_score(F.col("url"), title_of(F.col("html"))).alias("path_score"))


@query(SCORED + """, c AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE AND binary_label = 1) AS tp, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE AND binary_label = 0) AS fp FROM s, (SELECT unnest(range(101)) AS t) GROUP BY t) SELECT threshold, tp, fp FROM c ORDER BY abs(threshold - 0.637), threshold LIMIT 1""")
def nearest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.threshold_curve(scored(spark, sf_dir))
    best = F.min_by(F.struct("threshold", "tp", "fp"), F.struct(F.abs(F.col("threshold") - 0.637), "threshold"))
    return curve.agg(best.alias("b")).select("b.threshold", "b.tp", "b.fp")


@query()
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html.nodes(table(spark, sf_dir, "pages"))
    return shape.paths(nodes, dom.repeated(dom.signatures(nodes)).where("repeating_group_count >= 2"))


@query()
def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shape.placed(html.nodes(table(spark, sf_dir, "pages")))
    return nodes.select("page_id", "node", "tag", "parent_index", "sibling_count", *(c.alias(n) for n, c in shape.attributes().items()))


@query()
def input_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html.nodes(table(spark, sf_dir, "pages"))
    return shape.input_distances(nodes, dom.repeated(dom.signatures(nodes)).where("repeating_group_count >= 2"))


@query()
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.kinds(html.nodes(table(spark, sf_dir, "pages")))


@query()
def nested_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.nested_penalty(candidates(spark, sf_dir), least=24).select("page_id", "node", "score", "final_score")
