"""Crawled pages: categories, relevance, links, ancestry and breadth-first frontiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.urls import crawl_url
from agora.session import written

#: What marks each category in a page's HTML, whatever the case.
CATEGORIES = {
    "comments": [r"\bcomments?\b", r"leave\s+a\s+comment", r"post\s+a?\s*comment", r"add\s+a?\s*comment", r"write\s+a?\s*comment", r"comment\s+section", "disqus", "livefyre", "intensedebate", r"id=[\"']comments?[\"']", r"class=[\"'][^\"']*\bcomments?\b"],
    "forum": [r"\bforum\b", r"\bthread\b", r"\breply\b", r"new\s+post\b", r"start\s+a?\s*thread", r"post\s+reply", r"\btopic\b", "phpbb", "vbulletin", r"\bboard\b", r"id=[\"'][^\"']*forum", r"class=[\"'][^\"']*forum"],
    "reviews": [r"write\s+a?\s*review", r"customer\s+reviews?", r"product\s+reviews?", r"\brate\s+this\b", r"star\s+rating", r"submit\s+review", r"\b\d+\s+reviews?\b", "trustpilot", r"id=[\"'][^\"']*review", r"class=[\"'][^\"']*review"],
    "discussion": [r"join\s+the\s+discussion", r"start\s+a?\s*discussion", r"\bdiscussion\b", r"ask\s+a\s+question", r"\bQ&A\b", r"\bcommunity\b", r"id=[\"'][^\"']*discuss", r"class=[\"'][^\"']*discuss"],
    "ugc": [r"submitted\s+by\b", r"posted\s+by\b", r"written\s+by\b", r"\bcontribute\b", r"<textarea[\s>]", r"name=[\"'](?:comment|message|reply|review|body|content)[\"']"],
    "guestbook": [r"\bguestbook\b", r"\bshoutbox\b", r"\bwall\s+post", r"\bnewsfeed\b", r"\bactivity\s+feed\b", r"\buser\s+feed\b"],
}


def needle(pattern: str) -> str:
    """The longest run of plain letters that every match of a pattern has, in lower case."""
    plain = re.sub(r"\(\?:[^)]*\)|\[[^\]]*\][*+?]?|\\.[*+?]?|.\?", "\0", pattern)
    return max(re.findall(r"[A-Za-z&=<]+", plain), key=len).lower()


def categories(html: Column, lower: Column) -> Column:
    """The categories of which a page has a mark, in their fixed order; ``lower`` is the page in lower case.

    Patterns are tried where the plain word that they share occurs alone.
    """
    found = []
    for name, patterns in CATEGORIES.items():
        by_needle: dict[str, list[str]] = {}
        for p in patterns:
            by_needle.setdefault(needle(p), []).append(r"(?-i:\bQ&A\b)" if p == r"\bQ&A\b" else p)
        marked = (F.contains(lower, F.lit(word)) & html.rlike("(?i)" + "|".join(those)) for word, those in by_needle.items())
        found.append(F.when(reduce(Column.__or__, marked), name))
    return F.array_compact(F.array(*found))


def with_categories(pages: DataFrame, name: str = "categories", html: str = "html") -> DataFrame:
    """``pages`` with their ``categories``."""
    held = pages.withColumn("_lower", F.lower(html))
    return held.withColumn(name, categories(F.col(html), F.col("_lower"))).drop("_lower")


def relevance(matched: Column) -> Column:
    return F.least(F.lit(1.0), F.size(matched) * 0.25)


def page_links(pages: DataFrame, most: int | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, url, position) of absolute links, each once a page, the first ``most``."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    origin = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(https?://[^/?#]+)", 1)
    rows = pages.select(key, origin.alias("origin"), F.posexplode(found).alias("position", "href"))
    absolute = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).when(F.col("href").startswith("/"), F.concat("origin", "href"))
    rows = rows.withColumn("url", crawl_url(absolute)).where("url IS NOT NULL AND url <> ''")
    once = rows.groupBy(key, "url").agg(F.min("position").alias("position"))
    if most is None:
        return once
    return once.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("_rank") <= most).drop("_rank")


def ancestry(pages: DataFrame, start: DataFrame, key: str = "id", parent: str = "parent_page_id") -> DataFrame:
    """(start, id, steps): each start's chain of parents, level by level to the top.

    A chain that comes back to itself ends there.
    """
    edges = pages.where(F.col(parent).isNotNull()).select(F.col(key).alias("_k"), F.col(parent).alias("_p"))
    level = start.select(F.col(key).alias("start"), F.col(key), F.lit(0).alias("steps"))
    seen = level
    while not level.isEmpty():
        up = level.join(edges, F.col(key) == F.col("_k")).select("start", F.col("_p").alias(key), (F.col("steps") + 1).alias("steps"))
        level = written(up.join(seen.select("start", key), ["start", key], "left_anti"), "ancestry")
        seen = seen.unionByName(level)
    return seen


def frontier(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(id, depth): what is reached from ``seeds`` (id) over ``links`` (src, dst), each at its least depth up to ``depth``."""
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    level = seen
    for d in range(1, depth + 1):
        found = level.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        level = written(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(level)
    return seen
