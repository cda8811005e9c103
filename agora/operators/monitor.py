"""Logs of statements and requests, queue states, review targets and other small state rules, as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import plain, squeezed
from agora.functions.urls import match_score

#: Statements that write.
WRITES = "INSERT|UPDATE|DELETE|ALTER|CREATE|DROP|TRUNCATE|VACUUM|REINDEX|GRANT|REVOKE|COMMENT|MERGE|DO|CALL"
#: Hosts and categories by which a site's kind is told, the first that fits.
SITE_KINDS = [
    (r"stack(?:overflow|exchange)|superuser|serverfault|quora|hackernews|github\.com/discussions", "qa"),
    (r"reddit|forum|forums|boards\.ie|resetera|neogaf|mumsnet|city-data|skool|discourse|phpbb|vbulletin|xenforo|ubuntuforums|steamcommunity", "forum"),
    ("metacritic|imdb|rottentomatoes|letterboxd|goodreads", "review"),
    ("producthunt|indiehackers|growthhackers|fandom|nexusmods|gamefaqs", "community"),
]


def statement(sql: Column) -> dict[str, Column]:
    """Type, whether it writes, tables named and number of tokens of an SQL text."""
    flat = squeezed(sql)
    named = F.regexp_extract_all(flat, F.lit(r'(?i)\b(?:from|join|into|update|truncate table|alter table|create table(?: if not exists)?)\s+([a-zA-Z0-9_."`\[\]-]+)'), F.lit(1))
    return {
        "statement_type": F.when(flat == "", "UNKNOWN").otherwise(F.upper(F.split(flat, " ")[0])),
        "is_write": flat.rlike(f"(?i)^(?:{WRITES})\\b"),
        "tables": F.array_distinct(named),
        "token_count": F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("long"),
    }


def request_target(path: Column) -> dict[str, Column]:
    """Job and item of an API path; null where it names none."""
    pattern = r"(?i)^/api/jobs/([^/]+)(?:/items/([^/]+))?"
    return {"job_id": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), "item_id": F.nullif(F.regexp_extract(path, pattern, 2), F.lit(""))}


def percent(current: Column, total: Column) -> Column:
    """0 to 100, half up; null without a total."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.greatest(current, F.lit(0)) / total * 100 + 0.5))))


def clamped(value: Column, default: float, least: float, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(value.try_cast("double"), F.lit(default))))


def item_status(queue_state: Column) -> Column:
    return F.when(queue_state == "active", "running").when(queue_state.isin("waiting", "waiting-children", "prioritized", "delayed", "paused"), "queued").otherwise("pending")


def reconciled(items: DataFrame, queue: DataFrame) -> DataFrame:
    """Unfinished items take the status of their queue entry (item_id, state), pending without one; finished ones stay."""
    joined = items.join(queue, "item_id", "left")
    open_ = F.col("status").isin("pending", "queued", "running")
    return joined.withColumn("status", F.when(open_, item_status(F.coalesce("state", F.lit("")))).otherwise(F.col("status"))).drop("state")


def site_kind(host: Column) -> Column:
    low, out = F.lower(host), F.lit("article")
    for pattern, kind in reversed(SITE_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def capture_reason(error: Column, detected: Column, access: Column, candidates: Column) -> Column:
    """Why a person should capture a page by hand; empty where nobody need."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", error)
        .when(F.coalesce(detected, F.lit(False)), "")
        .when(F.coalesce(access, F.lit("")) != "", access)
        .when(F.coalesce(candidates, F.lit(0)) == 0, "no candidates")
        .otherwise("not detected")
    )


#: From which amount on each sign of a live region counts how much, and what a table costs.
ACTIVITY = {
    "family": ((15, 0.25), (8, 0.20), (5, 0.15), (3, 0.10)),
    "homogeneity": ((0.8, 0.10), (0.5, 0.05)),
    "times": ((0.5, 0.10), (0.2, 0.05)),
    "authors": ((0.5, 0.10), (0.2, 0.05)),
    "replies": ((0.4, 0.08),),
    "avatars": ((0.4, 0.06),),
    "activity": ((10, 0.10), (3, 0.05)),
}
#: What attributes, places and tags add to the score or take from it.
KEYWORDS = (
    (r"\b(comment|comments|commenter|reply|replies|discussion|discussions|review|reviews|feedback|thread|threads|answer|answers|question|questions|forum|forums|qa|komentarz|komentarze|komentarzy|odpowiedz|odpowiedzi|comentario|comentarios|commentaire|commentaires|kommentar|kommentare|antwort|antworten|resposta|respostas|respuesta|respuestas|reponse|reponses)\b|\bq\s*(?:&|/)\s*a\b", 0.15),
    (r"\b(post|posts|message|messages|response|responses|conversation|conversations|community|communities)\b", 0.08),
    (r"\b(item|card|entry|block|unit|feed|list)\b", 0.03),
)
COMMERCE = r"\b(add.to.cart|buy.now|price|checkout|purchase|\$|€|£)\b"
NAVIGATION = r"\b(nav|navigation|menu|header|footer|breadcrumb|sidebar)\b"
SCHEMA, FEED, COMMENT, COMPOSER, COMMERCE_COST, NAVIGATION_COST, TABLE_COST = 0.12, 0.08, 0.08, 0.06, 0.15, 0.10, 0.15


def activity_score(
    family: Column, homogeneity: Column, times: Column, authors: Column, replies: Column, avatars: Column, activity: Column, table: Column,
    *, blob: Column | None = None, itemtype: Column | None = None, role: Column | None = None, composer: Column | None = None,
) -> Column:
    """The score of a live region, between 0 and 1.

    Of its repetition, the coverages of its units, its activity and its tag; ``blob`` are the tags,
    attribute names and values of it and its parent, with its short text, in which words for
    discussions add, and those for shops and menus take away; schema types, roles and an input
    nearby (``composer``) add.
    """
    steps = lambda x, *pairs: F.coalesce(*(F.when(x >= at, w) for at, w in pairs), F.lit(0.0))
    found = {"family": family, "homogeneity": homogeneity, "times": times, "authors": authors, "replies": replies, "avatars": avatars, "activity": activity}
    total = sum((steps(found[name], *pairs) for name, pairs in ACTIVITY.items()), F.lit(0.0))
    some = lambda c, w: F.when(c, w).otherwise(0.0)
    if blob is not None:
        total += F.coalesce(*(F.when(plain(blob).rlike(p), w) for p, w in KEYWORDS), F.lit(0.0))
        total = total - some(blob.rlike("(?i)" + COMMERCE), COMMERCE_COST) - some(blob.rlike("(?i)" + NAVIGATION), NAVIGATION_COST)
    if itemtype is not None:
        total += some(F.lower(itemtype).rlike("comment|review"), SCHEMA)
    if role is not None:
        total = total + some(role == "feed", FEED) + some(role == "comment", COMMENT)
    if composer is not None:
        total += some(composer, COMPOSER)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - some(table, TABLE_COST)))


def live_score(family: int, homogeneity: float, activity: int, tag: str, attrs: dict[str, str], parent_tag: str, parent_attrs: dict[str, str], rows: bool) -> float:
    """The terms of ``activity_score`` that a tree without texts can tell, of one region of a keyed state."""
    steps = lambda x, pairs: next((w for at, w in pairs if x >= at), 0.0)
    blob = " ".join([tag, *(x for kv in sorted(attrs.items()) for x in kv), parent_tag, *(x for kv in sorted(parent_attrs.items()) for x in kv)])
    words = "".join(c for c in unicodedata.normalize("NFKD", blob) if not "\u0300" <= c <= "\u036f").lower()
    total = sum(steps(x, ACTIVITY[name]) for name, x in (("family", family), ("homogeneity", homogeneity), ("activity", activity)))
    total += next((w for p, w in KEYWORDS if re.search(p, words, re.A)), 0.0)
    total += SCHEMA * bool(re.search("comment|review", attrs.get("itemtype", "").lower()))
    total += FEED * (attrs.get("role") == "feed") + COMMENT * (attrs.get("role") == "comment")
    total -= COMMERCE_COST * bool(re.search(COMMERCE, blob, re.I | re.A)) + NAVIGATION_COST * bool(re.search(NAVIGATION, blob, re.I | re.A))
    return round(max(0.0, min(1.0, total - TABLE_COST * (rows or tag in ("table", "tbody", "tr")))), 9)


#: Parts of a query's matches that are ranked on their own before the best of them are ranked together.
PARTS = 64


def matched(queries: DataFrame, items: DataFrame, most: int = 10, least: int = 60) -> DataFrame:
    """(query_id, item_id, score, rank): of all ``items`` (item_id, u, required, snapshot) the best for each of ``queries`` (query_id, u).

    ``u`` are ``lookup_parts``.  Only items of a query's host can match; the best of parts of them
    are found first, so that a host with very many items is not one task.  Of equal scores those
    that need a capture come first, then by item.
    """
    q = queries.select("query_id", F.col("u").alias("_q"), F.col("u.host").alias("_host"))
    i = items.select("item_id", F.col("u").alias("_i"), F.col("u.host").alias("_host"), "required", "snapshot")
    found = q.join(i, "_host").select("query_id", "item_id", "required", match_score(F.col("_q"), F.col("_i"), F.col("required"), F.col("snapshot")).alias("score")).where(F.col("score") >= least)
    best = [F.col("score").desc(), F.col("required").desc(), F.col("item_id")]
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("item_id"), F.lit(PARTS))).orderBy(*best)
    few = found.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= most).select("query_id", "item_id", "score", "rank")


def promoted(matches: DataFrame, targets: DataFrame, minutes: int = 30, least: int = 60) -> DataFrame:
    """Matches (query_id, item_id, score) with a recent target of the query put first, once, and as many rows as before."""
    fresh = targets.where((F.col("age_minutes") <= minutes) & (F.col("lookup_score") >= least)).select("query_id", F.col("item_id"), F.col("lookup_score").alias("score"), F.lit(0).alias("_place"))
    sizes = matches.groupBy("query_id").agg(F.count("*").alias("_n"))
    both = fresh.unionByName(matches.withColumn("_place", F.lit(1))).withColumn("_first", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("_place"))).where("_first = 1")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_place", F.col("score").desc(), "item_id")))
    return ranked.join(sizes, "query_id", "left").where("rank <= greatest(coalesce(_n, 1), 1)").select("query_id", "item_id", "score", "rank")


def inferred(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels passed on to candidates of the same signature that have none of their own.

    ``candidates``: id, signature, human_label, source; ``labels``: signature, label, one a signature.
    """
    free = F.col("human_label").isNull() | (F.col("source") == "inferred")
    return candidates.where(free & (F.col("signature") != "")).join(labels.where("label <> 'uncertain'"), "signature").select("id", "signature", "label")
