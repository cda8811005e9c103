"""Queries of text, URL, hash and crawl functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import hashing, text, urls
from agora.operators import crawl, monitor
from agora.plans.registry import query, table
from agora.session import spread

_SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_HOST = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^[^@]*@|:[0-9]*$', '', 'g'), '^www\.', '')"
_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(rf"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS text_word_count, length(t) AS text_char_count,
  len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s) <> '')) AS text_sentence_count,
  CASE WHEN t = '' THEN 0.0 ELSE floor(list_sum(list_transform(string_split(t, ' '), lambda w: length(w)))::DOUBLE / len(string_split(t, ' ')) * 10 + 0.5) / 10 END AS avg_word_length
FROM (SELECT doc_id, {_SQUEEZED} AS t FROM documents)""")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) AS mention_count, len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS hashtag_count, len(regexp_extract_all(text, '\?')) AS question_mark_count, len(regexp_extract_all(text, '!')) AS exclamation_mark_count FROM documents""")
def mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in text.mark_counts(F.col("text")).items()))


@query(rf"SELECT doc_id, CASE WHEN length({_SQUEEZED}) > 80 THEN substr({_SQUEEZED}, 1, 79) || '…' ELSE {_SQUEEZED} END AS excerpt FROM documents")
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(text.squeezed(F.col("text")), 80).alias("excerpt"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name || ' ' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"))


@query()
def keyword_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.keyword_text("text").alias("t"))
    return docs.select("doc_id", F.length("t").alias("chars"), F.crc32("t").alias("crc"))


@query(r"SELECT page_id, substr(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.title_of(F.col("html")).alias("title"))


@query(r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))) AS chars FROM pages""")
def stripped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.stripped_tags(F.col("html"))).cast("long").alias("chars"))


@query(r"""SELECT page_id, regexp_extract(html, '(?i)<html[^>]*\blang\s*=\s*["'']?([A-Za-z-]+)', 1) AS html_lang, regexp_extract(html, '(?i)<meta[^>]*charset\s*=\s*["'']?([A-Za-z0-9_-]+)', 1) AS charset,
  regexp_matches(html, '(?i)<script[^>]*application/ld\+json') AS has_json_ld, regexp_matches(html, '(?i)csrf') AS has_csrf, len(regexp_extract_all(html, '(?i)<a\b')) AS anchors FROM pages""")
def raw_html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("html_lang"),
        F.regexp_extract(html, r"(?i)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1).alias("charset"),
        html.rlike(r"(?i)<script[^>]*application/ld\+json").alias("has_json_ld"),
        html.rlike("(?i)csrf").alias("has_csrf"),
        F.regexp_count(html, F.lit(r"(?i)<a\b")).cast("long").alias("anchors"),
    )


@query(rf"SELECT page_id, {_HOST} AS hostname FROM pages")
def hostname_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.hostname(F.col("url")).alias("hostname"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_replace(coalesce(url, ''), '#.*$', '')), '/+$', '') AS crawl_url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.crawl_url(F.col("url")).alias("crawl_url"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, '//') THEN 'https:' || u WHEN regexp_matches(u, '(?i)^[a-z0-9.-]+\.[a-z]{2,}(?:[/?#:].*)?$') THEN 'https://' || u ELSE u END AS normalized_url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?:', '') ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)""")
def input_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?:", "")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized_input(u).alias("normalized_url"))


@query(rf"SELECT hostname, CAST({_FNV.format('hostname')} AS BIGINT) AS hash, CAST({_FNV.format('hostname')} % 5 AS BIGINT) AS bucket FROM (SELECT DISTINCT {_HOST} AS hostname FROM pages)")
def fnv_bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(urls.hostname(F.col("url")).alias("hostname")).distinct()
    return hosts.select("hostname", hashing.fnv1a32(F.col("hostname")).alias("hash"), hashing.bucket(F.col("hostname"), 5).alias("bucket"))


@query(rf"SELECT bucket, count(DISTINCT hostname) AS domains, count(*) AS n, max(hostname) AS last_domain FROM (SELECT hostname, CAST({_FNV.format('hostname')} % 5 AS BIGINT) AS bucket FROM (SELECT {_HOST} AS hostname FROM pages)) GROUP BY bucket")
def domain_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "pages").groupBy(urls.hostname(F.col("url")).alias("hostname")).agg(F.count("*").alias("n"))
    return per.withColumn("bucket", hashing.bucket(F.col("hostname"), 5)).groupBy("bucket").agg(F.count("*").alias("domains"), F.sum("n").alias("n"), F.max("hostname").alias("last_domain"))


@query("SELECT event_id, substr(sha1(concat_ws('|', CAST(user_id AS VARCHAR), event_type, coalesce(props, ''))), 1, 16) AS candidate_key FROM events")
def candidate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", hashing.candidate_key(F.col("user_id"), F.col("event_type"), F.col("props")).alias("candidate_key"))


def _category_sql(column: str) -> str:
    parts = []
    for name, patterns in crawl.CATEGORIES.items():
        tests = " OR ".join("regexp_matches({0}, '{1}')".format(column, (("" if p == r"\bQ&A\b" else "(?i)") + p).replace("'", "''")) for p in patterns)
        parts.append(f"CASE WHEN {tests} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], lambda c: c IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(c, '|') AS categories, least(1.0, len(c) * 0.25)::DOUBLE AS relevance FROM (SELECT doc_id, {_category_sql('t')} AS c FROM (SELECT doc_id, text || CASE lang WHEN 'de' THEN ' leave a comment' WHEN 'fr' THEN ' Forum: write a review' ELSE '' END AS t FROM documents))")
def crawl_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.concat("text", F.when(F.col("lang") == "de", " leave a comment").when(F.col("lang") == "fr", " Forum: write a review").otherwise(""))
    found = crawl.with_categories(spread(table(spark, sf_dir, "documents").select("doc_id", held.alias("html"))), "c")
    return found.select("doc_id", F.array_join("c", "|").alias("categories"), crawl.relevance(F.col("c")).alias("relevance"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)', 1)) AS href FROM pages)
SELECT page_id, count(DISTINCT u) AS links FROM (SELECT page_id, regexp_replace(lower(regexp_replace(CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN origin || href END, '#.*$', '')), '/+$', '') AS u FROM l) WHERE u <> '' GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@query()
def lookup_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten saved pages that fit best to each fiftieth page's address, among all others."""
    parts = table(spark, sf_dir, "pages").select("page_id", urls.lookup_parts("url").alias("u"))
    saved = parts.select(F.col("page_id").alias("item_id"), "u", (F.col("page_id") % 7 == 0).alias("required"), (F.col("page_id") % 11 == 0).alias("snapshot"))
    asked = parts.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "u")
    return monitor.matched(asked, saved)


@query("""WITH RECURSIVE up AS (SELECT conv_id, max(turn) AS turn, 0 AS steps FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, turn - 1, steps + 1 FROM up WHERE turn > 0)
SELECT conv_id * 1000 + turn AS id, CAST(steps AS INTEGER) AS steps FROM up""")
def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_page_id"), F.floor(F.col("conv_id")).alias("c"))
    last = turns.groupBy("c").agg(F.max("id").alias("id"))
    return crawl.ancestry(turns, last).select("id", "steps")


@query("""SELECT id, min(depth) AS depth FROM (SELECT 'r0' AS id, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0) GROUP BY id""")
def bfs_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    down = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    down = down.unionByName(table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    seeds = table(spark, sf_dir, "region").where("r_regionkey = 0").select(name("r", "r_regionkey").alias("id"))
    return crawl.frontier(seeds, down, 2)
