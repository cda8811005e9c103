"""URL functions: columns where a pattern does, one Arrow UDF where query parameters must be parsed."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

#: Parameters that only track, and those that identify a page.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "src", "si", "spm")
IMPORTANT = ("v", "id", "p", "story_fbid", "comment_id", "review_id", "thread_id")

_TEXTS = ("href", "origin", "host", "pathname", "path_key", "last_segment")
#: What an address is taken apart into.
PARTS = StructType()
for _name in _TEXTS:
    PARTS = PARTS.add(_name, StringType())
PARTS = PARTS.add("params", MapType(StringType(), StringType()))


def normalized_input(url: Column) -> Column:
    """http and https stay; ``//x`` and bare domains get https; the rest stays as it is."""
    held = F.trim(F.coalesce(url, F.lit("")))
    return (
        F.when(held.rlike("(?i)^https?://"), held)
        .when(held.startswith("//"), F.concat(F.lit("https:"), held))
        .when(held.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(?:[/?#:].*)?$"), F.concat(F.lit("https://"), held))
        .otherwise(held)
    )


def hostname(url: Column) -> Column:
    """Host in lower case without port, user and one leading ``www.``."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:[0-9]*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def crawl_url(url: Column) -> Column:
    """Without fragment, in lower case, without slashes at the end; the query stays."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")), "/+$", "")


def skippable(url: Column) -> Column:
    return url.rlike(r"(?i)^(?:mailto|tel|javascript|data):|\.(?:jpe?g|png|gif|svg|webp|pdf|zip|mp[34]|css|js|ico|woff2?)(?:[?#]|$)")


def same_site(host: Column, other: Column) -> Column:
    return (host == other) | host.endswith(F.concat(F.lit("."), other)) | other.endswith(F.concat(F.lit("."), host))


@F.pandas_udf(PARTS)
def lookup_parts(urls: pd.Series) -> pd.DataFrame:
    """The parts by which saved pages are matched: tracking parameters, fragment and default ports dropped, parameters sorted."""

    def one(url: str | None) -> tuple:
        try:
            parts = urlsplit(url or "")
            host = (parts.hostname or "") + (f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else "")
        except ValueError:
            parts, host = None, ""
        if not parts or parts.scheme not in ("http", "https") or not host:
            return url or "", "", "", url or "", url or "", "", {}
        kept = sorted(((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING and not k.lower().startswith("utm_")), key=lambda x: x[0])
        origin, path = f"{parts.scheme}://{host}", parts.path or "/"
        short = path.rstrip("/") or "/"
        segments = [s for s in short.split("/") if s]
        first = {}
        for k, v in kept:
            first.setdefault(k, v)
        return origin + path + ("?" + urlencode(kept) if kept else ""), origin, host, short, origin + short, segments[-1] if segments else "", {k: first[k] for k in IMPORTANT if first.get(k)}

    return pd.DataFrame([one(u) for u in urls], columns=[*_TEXTS, "params"])


def match_score(left: Column, right: Column, required: Column | None = None, snapshot: Column | None = None) -> Column:
    """How well two ``lookup_parts`` fit: 100 same address, 95 or 85 same path, 72 same last segment, 60 same host, else 0."""
    shared = F.size(F.map_filter(left["params"], lambda k, v: right["params"][k] == v))
    base = (
        F.when(left["href"] == right["href"], 100)
        .when((left["path_key"] == right["path_key"]) & (shared > 0), 95)
        .when(left["path_key"] == right["path_key"], 85)
        .when((left["origin"] != "") & (left["origin"] == right["origin"]) & (left["last_segment"] != "") & (left["last_segment"] == right["last_segment"]), 72)
        .when((left["host"] != "") & (left["host"] == right["host"]), 60)
        .otherwise(0)
    )
    if required is not None:
        base = base + F.when(required, 5).otherwise(0)
    if snapshot is not None:
        base = base - F.when(snapshot, 10).otherwise(0)
    return base


#: Parameters that a candidate page's address keeps, and patterns by which its path is scored.
KEPT = r"(?i)^(?:id|p|q|page|commentid|discussion|item)="
NEGATIVE_PAGE = r"\b(help|support|faq|policy|guidelines?|rules?|terms?|privacy|account|login|logout|sign[ -]?in|sign[ -]?out|sign[ -]?up|register|subscribe|subscription|newsletter|contact|feedback|about|careers?|jobs?|advertis(?:e|ing)|accessibility|authors?|tag|tags|category|categories|search|sitemap|cookie|preferences|comment(?:ing)? experience|comments? section|how to comment)\b"
POSITIVE_PATH = r"\b(comments?|discussion|discussions|thread|threads|topic|topics|forum|forums|question|questions|answer|answers|review|reviews|posts?|community|communities|reply|replies)\b"
ARTICLE_PATH = r"/(?:\d{4}/\d{2}/\d{2}/|article|articles|story|stories|blog|blogs|post|posts|news|politics|world|technology|tech|sports|travel|food|lifestyle)/"
TOPIC_END = r"/(?:topic|topics|forum|forums|questions|discussions?)/?$"
SECTION_END = r"/(?:news|politics|world|business|tech|technology|travel|food|blog|blogs|community|forums?)/?$"
KIND_PATHS = {"qa": (r"/questions?/", 10), "forum": (r"/(?:forum|forums|thread|threads|topic|topics|discussion|discussions|comments)/", 10), "review": (r"/(?:title|movie|show|book|album|game|games|recipe|recipes|product|products|review|reviews)/", 8)}


def path_of(url: Column) -> Column:
    """The path of an absolute address, ``/`` where it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def candidate_url(url: Column) -> Column:
    """Without fragment, slashes at the path's end and all but a few parameters; empty if it is no address."""
    found = url.rlike(r"(?i)^https?://[^/?#]+")
    origin = F.lower(F.regexp_extract(url, r"^([^:]+://[^/?#]*)", 1))
    path = path_of(url)
    short = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike(KEPT))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(found, F.concat(origin, F.when(short == "", "/").otherwise(short), query)).otherwise("")


def store_key(url: Column, most: int = 200) -> Column:
    """Origin, path and query without one slash at the end, cut to ``most`` characters."""
    whole = F.concat(F.lower(F.regexp_extract(url, r"^([^:]+://[^/?#]*)", 1)), path_of(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1))
    return F.substring(F.when(url.rlike(r"(?i)^https?://[^/?#]+"), F.regexp_replace(whole, "/$", "")).otherwise(url), 1, most)


def path_score(url: Column, title: Column, kind: Column | None = None, hint: Column | None = None) -> Column:
    """How likely an address leads to a page with discussion, by its path, its title and the site's kind; -100 for none."""
    path, text = F.lower(path_of(url)), F.lower(F.coalesce(title, F.lit("")))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    rules = [
        (F.size(parts) == 0, -4), (F.size(parts) >= 2, 3), (F.size(parts) >= 3, 2),
        (path.rlike(ARTICLE_PATH), 4), (path.rlike(POSITIVE_PATH), 8), (path.rlike(r"\d{4}/\d{2}/\d{2}"), 3), (path.rlike(r"\d{5,}"), 3),
        (last.contains("-"), 2), (F.length(text) >= 24, 2),
        (path.rlike(NEGATIVE_PAGE), -16), (text.rlike(NEGATIVE_PAGE), -12), (path.rlike(TOPIC_END), -3), (path.rlike(SECTION_END), -4),
    ]
    if hint is not None:
        rules.append((F.coalesce((hint != "") & path.contains(F.lower(hint)), F.lit(False)), 2))
    if kind is not None:
        rules += [((kind == k) & path.rlike(pattern), points) for k, (pattern, points) in KIND_PATHS.items()]
    total = sum((F.when(c, points).otherwise(0) for c, points in rules), F.lit(0))
    return F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+"), total).otherwise(-100)
