"""Pages with discussion: links worth following, and what a fetched page tells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import title_of
from agora.functions.urls import NEGATIVE_PAGE, candidate_url, hostname, path_of, path_score, same_site
from agora.operators import content

#: Addresses of files that are no pages.
FILES = r"(?i)\.(?:jpe?g|png|gif|svg|webp|pdf|zip|mp[34]|css|js|ico|woff2?)(?:[?#]|$)"
#: What each hard signal of a page is told by, its name, and whether it speaks of reviews alone.
SIGNALS = [
    (r"hedgehog-comment-embed", "comment embed", False),
    (r"disqus", "disqus", False),
    (r"giscus", "giscus", False),
    (r"utteranc\.es|utterances", "utterances", False),
    (r"viafoura", "viafoura", False),
    (r"spotim|openweb", "spotim/openweb", False),
    (r"coral-talk|coral comment", "coral", False),
    (r"hyvor-talk|hyvor", "hyvor", False),
    (r"graphcomment", "graphcomment", False),
    (r"commento", "commento", False),
    (r"remark42", "remark42", False),
    (r"facebook\.com/plugins/comments", "facebook comments", False),
    (r"commentcount", "commentCount", False),
    (r"show_comments", "show_comments", False),
    (r"comments?\s*:\s*\{[^}]{0,120}enabled", "comments enabled flag", False),
    (r"<[^>]+(?:id|class|data-[^=]+|aria-label|name)=[\"'][^\"']*\bcomments?\b[^\"']*[\"']", "comment selector", False),
    (r"<[^>]+(?:id|class|data-[^=]+|aria-label|name)=[\"'][^\"']*\bdiscussion\b[^\"']*[\"']", "discussion selector", False),
    (r"<[^>]+(?:id|class|data-[^=]+|aria-label|name)=[\"'][^\"']*\brepl(?:y|ies)\b[^\"']*[\"']", "reply selector", False),
    (r"<[^>]+(?:id|class|data-[^=]+|aria-label|name)=[\"'][^\"']*\breviews?\b[^\"']*[\"']", "review selector", True),
    (r"\bjoin the conversation\b", "join the conversation", False),
    (r"\bleave a comment\b|\bpost a comment\b|\badd a comment\b", "comment prompt", False),
    (r"\breader comments\b", "reader comments", False),
    (r"\bcommunity comments\b", "community comments", False),
]
#: Plain words, in lower case, of which every match of a signal has one at least, by its place.
NEEDLES = [
    ("hedgehog",), ("disqus",), ("giscus",), ("utteranc",), ("viafoura",), ("spotim", "openweb"), ("coral",), ("hyvor",), ("graphcomment",), ("commento",), ("remark42",), ("plugins/comments",), ("commentcount",), ("show_comments",),
    ("comment",), ("comment",), ("discussion",), ("repl",), ("review",), ("join the",), ("a comment",), ("reader comments",), ("community comments",),
]
#: What else adds or takes points, by the site's kind, title, address and search result.
BLOCKED = r"just a moment|security verification|captcha|please enable js|disable any ad blocker|access denied|verify you are human|bot verification"
TOPIC = r"\b(?:html|css|javascript|js|json|python|java|c\+\+|sql|bash|shell|code|source code|inline|multiline|block)\s+comments?\b|\bcomments?\s+in\s+(?:html|css|javascript|js|json|python|java|c\+\+|sql|bash|shell)\b|\bclean code comments?\b"
MANUAL = r"\b(docs?|documentation|tutorials?|reference|learn|guide|guides|how to|how-to|syntax)\b"
QA_SCHEMA = r"(?i)itemtype=\"https://schema\.org/(?:qapage|question)\""
THREAD_TEXT = r"\bdiscussion\b|\bthread\b|\breplies?\b|\bposted by\b|\blast reply\b"
REVIEW_TEXT = r"\buser reviews?\b|\breviewer\b|\brating\b|\bratings\b"
QA_PATH = r"/(?:questions/\d+|q/\d+|a/\d+)"
THREAD_PATH = r"/discussion/\d+|/(?:threads?|topic|topics)/[^/?#]+|/t/[^/?#]+|showthread\.php(?:\?|$)|/comments/[^/?#]+|/forum/[^/?#]+/\d+"
REVIEW_PATH = r"/(?:movie|movies|tv|book|books|game|games|album|albums|recipe|recipes|product|products|reviews?)/"
SECTION = r"\b(article|story|stories|review|reviews|blog|post)\b"


def anchors(pages: DataFrame, nodes: DataFrame, kind: Column | None = None, most: int = 10) -> DataFrame:
    """(page_id, url, title, discovery_score, rank): each page's best links to its own site.

    ``pages``: page_id, url; ``nodes``: their node table.  Links are absolute ones to pages, each
    once by its normalised address with the text of the first; those of a score of 1 or more are
    ranked by it, equal ones in document order.
    """
    links = nodes.where((F.col("tag") == "a") & F.col("attrs")["href"].rlike("(?i)^\\s*https?://")).select("page_id", "node", F.trim(F.col("attrs")["href"]).alias("href")).where(~F.col("href").rlike(FILES))
    links = links.join(content.texts(nodes, links), ["page_id", "node"]).join(pages.select("page_id", F.col("url").alias("_base"), (F.lit(None).cast("string") if kind is None else kind).alias("_kind")), "page_id")
    links = links.withColumn("url", candidate_url(F.col("href"))).where((F.col("url") != "") & same_site(hostname(F.col("url")), hostname(F.col("_base"))))
    once = links.groupBy("page_id", "url").agg(F.min(F.struct("node", F.col("inner_text").alias("title"), "_kind")).alias("f")).select("page_id", "url", "f.*")
    scored = once.withColumn("discovery_score", path_score(F.col("url"), F.col("title"), F.coalesce("_kind", F.lit("")))).where("discovery_score >= 1")
    by = Window.partitionBy("page_id").orderBy(F.desc("discovery_score"), "node")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("page_id", "url", "title", "discovery_score", "rank")


def evaluated(found: DataFrame, ending: str | None = r"\.(?:html|htm)$") -> DataFrame:
    """``found`` with title, score, status, signals (the first six) and access_note.

    ``found`` has url, final_url, html, ok, http_status, error, kind, source, snippet, title and
    discovery_score.  Hard signals count 12 each, words count by the site's kind; status is
    validated, likely, blocked-but-likely, weak or unresolved.  ``ending`` is what the last part of an
    article's address may end in to tell it as one; None for nothing.
    """
    html, kind = F.coalesce("html", F.lit("")), F.coalesce("kind", F.lit(""))
    held = found.withColumns({"_lower": F.lower(html), "_url": F.lower(F.coalesce(F.nullif("final_url", F.lit("")), "url")), "_title": F.coalesce(F.nullif(title_of(html), F.lit("")), "title", F.lit("")), "_snippet": F.coalesce("snippet", F.lit(""))})
    lower, url, title, snippet = (F.col(c) for c in ("_lower", "_url", "_title", "_snippet"))
    contains = lambda words: reduce(Column.__or__, (F.contains(lower, F.lit(w)) for w in words))
    held = held.withColumn("_hard", F.array(*(contains(words) & html.rlike("(?i)" + pattern) for words, (pattern, *_) in zip(NEEDLES, SIGNALS))))
    count = lambda keep: F.size(F.filter(F.arrays_zip(F.col("_hard").alias("h"), F.array(*(F.lit(r) for *_, r in SIGNALS)).alias("r")), keep))
    held = held.withColumns({"_n": count(lambda x: x["h"]), "_articles": count(lambda x: x["h"] & ~x["r"]), "_blocked": F.coalesce(F.col("http_status").isin(401, 403), F.lit(False)) | F.substring(lower, 1, 6000).rlike(BLOCKED)})
    article, thread = kind.isin("article", "blog"), kind.isin("forum", "community")
    topic = F.lower(F.concat_ws(" ", title, snippet))
    negative = F.lower(title).rlike(NEGATIVE_PAGE) | snippet.rlike("(?i)" + NEGATIVE_PAGE) | url.rlike(NEGATIVE_PAGE)
    held = held.withColumn("_negative", negative)
    bare = article & (F.col("_n") == 0)
    points = [
        (F.col("_blocked"), -2, None),
        ((F.col("source") == "search") & snippet.rlike(r"(?i)\bcomments?\b"), 2, None),
        ((kind == "qa") & html.rlike(QA_SCHEMA), 16, "QAPage schema"),
        ((kind == "qa") & lower.rlike(r"\banswers?\b") & lower.rlike(r"\bquestion\b"), 8, "question/answer text"),
        (thread & lower.rlike(THREAD_TEXT), 8, "discussion thread text"),
        ((kind == "review") & lower.rlike(REVIEW_TEXT), 8, "review text"),
        (article & lower.rlike(r"\bcomments?\b") & lower.rlike(r"\brepl(?:y|ies)\b"), 4, "comments and replies text"),
        (F.col("_negative"), -18, "help/policy page"),
        (bare & topic.rlike(TOPIC), -18, "comment topic article"),
        (bare & topic.rlike(MANUAL), -8, "documentation/tutorial page"),
        (F.lower(title).rlike(r"\bcommentary\b"), -8, None),
        (url.rlike(r"/(?:commentary|opinion/commentary)/"), -8, None),
    ]
    yes = lambda c: F.coalesce(c, F.lit(False))
    score = sum((F.when(yes(test), w).otherwise(0) for test, w, _ in points), F.coalesce(F.col("discovery_score"), F.lit(0)) + 12 * F.col("_n"))
    hard = F.transform(F.filter(F.arrays_zip(F.col("_hard").alias("h"), F.array(*(F.lit(n) for _, n, _ in SIGNALS)).alias("n")), lambda x: x["h"]), lambda x: x["n"])
    signals = F.slice(F.array_distinct(F.concat(hard, F.array_compact(F.array(*(F.when(yes(test), F.lit(name)) for test, _, name in points if name))))), 1, 6)
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    last, before = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    words = F.size(F.filter(F.split(last, "-"), lambda s: s != ""))
    articles = (F.size(parts) >= 2) & (url.rlike(r"\d{4}/\d{2}/\d{2}") | url.rlike(r"\d{5,}") | (words >= 4) | (last.rlike(ending) if ending else F.lit(False)) | before.rlike(SECTION)) & (F.col("_articles") > 0)
    others = ((kind == "qa") & (html.rlike(QA_SCHEMA) | url.rlike(QA_PATH))) | (thread & url.rlike(THREAD_PATH)) | ((kind == "review") & (lower.rlike(REVIEW_TEXT) | url.rlike(REVIEW_PATH)))
    held = held.withColumns({"score": score, "signals": signals, "_others": others, "_strong": articles | others})
    status = (
        F.when(F.col("_negative") & (F.col("_n") < 2) & ~F.col("_others"), "unresolved")
        .when((F.col("score") >= 28) & F.col("_strong"), "validated")
        .when((F.col("score") >= 18) & (F.col("_strong") | (F.col("_n") > 0)), F.when(F.col("_blocked"), "blocked-but-likely").otherwise("likely"))
        .when(F.col("score") >= 10, F.when(F.col("_blocked"), "blocked-but-likely").otherwise("weak"))
        .otherwise("unresolved")
    )
    note = F.array_join(F.array_compact(F.array(F.when(~F.col("ok") & (F.col("http_status") != 0), F.concat(F.lit("http "), F.col("http_status").cast("string"))), F.nullif("error", F.lit("")), F.when(F.col("_blocked"), "blocked or verification required"))), "; ")
    return held.withColumns({"title": title, "status": status, "access_note": note}).drop(*(c for c in held.columns if c.startswith("_")))


#: The order of statuses, the best first.
STATUSES = ["validated", "likely", "blocked-but-likely", "weak", "unresolved"]


def best_of_sites(results: DataFrame, site: str = "site") -> DataFrame:
    """The best evaluation of each site: by status, then score, then the score it was found with."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(9))
    by = Window.partitionBy(site).orderBy(rank, F.desc("score"), F.desc("discovery_score"), "url")
    return results.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
