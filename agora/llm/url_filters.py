"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank over links from hosts with allowed pages; distrust is one over
reversed links from hosts with blocked pages (who links to them is suspect).  Both are scaled so
that a host all of whose pages a rule decides has at least 1.  A host is blocked where distrust
exceeds trust by the threshold; pages that no rule decides follow their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share that follows links, how much all hosts together may still gain in the end, and how much distrust must exceed trust.
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
#: Scores of hosts are sent to every task up to so many bytes; more are joined.
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with rule and ruled: the longest of ``rules`` (host and path, verdict) that fits, else nulls.

    A rule fits its host and all subdomains where the path starts with the rule's; of two of one
    length the one given first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of a host link to another host, summed before they are shuffled."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    far = pages.select(F.col("host").alias("src"), F.explode(found).alias("href"))
    far = far.withColumn("dst", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))))
    return far.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): seeds (host, weight) and what reaches others over edges (src, dst, n), by PageRank from the seeds.

    Each round moves what the last one brought, and the last is when all hosts together could gain
    no more than ``tolerance`` from further ones, so that no host's score is off by more, however
    thin its share is spread on the way.  What is under way shrinks by the damping with every link:
    it always ends, after rounds that grow with the logarithm of the seeds' weight.  Without edges
    the seeds alone have scores.  Rounds are written to the shared folder; joins on hosts are
    split by Spark where a host has many links.
    """
    fresh = written(seeds.select("host", F.col("weight").alias("score")), "ranks")
    if edges.isEmpty():
        return fresh
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    total = fresh
    while (fresh.agg(F.sum("score")).first()[0] or 0.0) * DAMPING / (1 - DAMPING) > tolerance:
        moved = shares.join(fresh, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("share") * F.col("score"))).alias("score"))
        moved = written(moved, "moved")
        summed = written(total.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")), "ranks")
        forget(total)
        if fresh is not total:
            forget(fresh)
        total, fresh = summed, moved
    forget(shares)
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html).

    Null urls and those without ``://`` have an empty host and path, no links and no scores, and
    are allowed unless a rule fits.  Repeated rows each count and each give a row; of rules of one
    length the first given wins; an empty table gives no rows.  Urls and pages of any length are read
    whole, by native functions alone.  Columns of ``pages`` beyond these three are not read, so that
    names such as ``host``, ``rule`` or ``trust`` among them do no harm.
    """
    parted = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = judged_by_rules(parted.drop("html"), rules)
    hosts = ruled.where("host != ''").groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("allowed"), F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("blocked"))
    hosts = written(hosts, "hosts")
    edges = written(links(parted), "host-links")
    trust = spread(hosts.where("allowed > 0").select("host", F.col("allowed").alias("weight")), edges).withColumnRenamed("score", "trust")
    distrust = spread(hosts.where("blocked > 0").select("host", F.col("blocked").alias("weight")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).withColumnRenamed("score", "distrust")
    scored = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    scored = written(scored, "host-scores")
    for gone in (hosts, edges, trust, distrust):
        forget(gone)
    if (scored.agg(F.sum(F.octet_length("host") + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES:
        scored = F.broadcast(scored)
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow"))
    return ruled.join(scored, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
