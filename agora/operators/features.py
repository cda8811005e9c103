"""Features of regions, as columns over what lies in their scope.

``scope`` brings each root's nodes together with its units, parent, siblings, headings and inputs in
one pass over whole pages; patterns are tried on these rows natively, then summed up by unit and by
root.  So texts of subtrees are made for roots alone, and for what a pattern reads.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.numbers import ratio
from agora.functions.text import emoji_count, plain, squeezed
from agora.operators import dom
from agora.operators.content import laid_out
from agora.operators.discovery import attr_text, attribute, full_attr_text
from agora.operators.tree import Pages, by_page
from agora.session import written

#: The patterns by which features are told, in the order of the features.
PATTERNS = {
    "more_options": r"(?i)\b(more|options|menu|actions|settings|ellipsis)\b",
    "author": r"(?i)\b(author|username|user.?name|display.?name|commenter|poster|handle|screen.?name|member)\b",
    "avatar": r"(?i)\b(avatar|user.?photo|profile.?pic|userpic|gravatar|author.?img|user.?image|member.?photo)\b",
    "avatar_url": r"(?i)/(avatar|gravatar|profile|user.?image|photo|avatars|userpic)s?/|/\d{4,}\.(jpg|jpeg|png|webp|gif)",
    "mention": r"@[\w.]+",
    "hashtag": r"#[\w]+",
    "relative": r"(?i)\b(\d+\s*(?:s(?:ec(?:ond)?s?)?|m(?:in(?:ute)?s?)?|h(?:r|our|ours)?|d(?:ay|days?)?|w(?:eek|weeks?)?|mo(?:nth|nths?)?|y(?:r|ear|ears)?)\s*ago|just\s*now|today|yesterday|\d+\s*(?:s|m|h|d|w|mo|y)\b)\b",
    "date": r"(?i)\b(?:20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/](?:20\d{2}|\d{2}))\b",
    "month": r"(?i)\b(?:(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?(?:\s+\d{2,4})?|\d{1,2}\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?),?(?:\s+\d{2,4})?)\b",
    "time_attribute": r"(?i)^(datetime|data-time|data-date|data-timestamp|data-created|data-epoch|timeago)$",
    "schema": r"(?i)schema\.org/(Comment|UserComments)",
    "reply": r"(?i)\b(reply|respond|quote|answer|write\s+a\s+reply)\b",
    "report": r"(?i)\b(report|flag|spam|abuse|inappropriate|block\s+user|hide)\b",
    "unit_avatar": r"(?i)\b(avatar|user.?photo|profile.?pic|userpic|gravatar|author.?img)\b",
    "unit_avatar_url": r"(?i)/(avatar|gravatar|profile|photo)s?/|/\d{4,}\.(jpg|jpeg|png|webp|gif)",
    "unit_author": r"(?i)\b(author|username|user.?name|display.?name|handle|screen.?name|member)\b",
    "reaction": r"(?i)\b(like|upvote|heart|clap|helpful|thumb|vote|react)\b",
    "amount": r"(?i)\b\d+[km]?\b",
    "edit": r"(?i)\b(edit|delete|remove|trash|discard)\b",
    "profile": r"(?i)/(?:user|profile|u|member|people|users?)/|/@[\w.-]+|^@[\w.-]+$",
    "load_more": r"(?i)\b(load\s+more|show\s+more|view\s+more|next\s+page|show\s+\d+\s+more|more\s+comments|more\s+replies|more\s+answers)\b",
    "counter": r"(?i)\b\d+\s*/\s*\d+\b|\bcharacters?\s*(remaining|left|used)\b|\b\d+\s*chars?\b",
    "submit": r"(?i)\b(post|submit|comment|reply|respond|send|publish|add\s+comment|add\s+review)\b",
    "collapse": r"(?i)\b(show\s+\d+\s+repl|hide\s+repl|expand|collapse|view\s+\d+\s+repl|show\s+\d+\s+answers?)\b",
    "price": r"(?i)[$€£¥₹]\s*\d|\d\s*[$€£¥₹]|\b\d+\.\d{2}\b|\bprice\b|\bUSD|EUR|GBP\b",
    "cart": r"(?i)\b(add\s+to\s+cart|buy\s+now|add\s+to\s+bag|purchase|checkout)\b",
    "rating": r"(?i)\b(star|rating|stars|rated|review-score)\b",
    "near_avatar": r"(?i)\b(avatar|user.?photo|profile.?pic|gravatar|userpic)\b",
    "near_author": r"(?i)\b(author|username|user.?name|handle|display.?name|member)\b",
    "near_time": r"(?i)\b(\d+\s*(minute|hour|day|week|month)s?\s*ago|just\s*now|\d+[smhdwy]\b)\b",
    "indent": r"(?i)\b(indent|level|depth|nested|child-comment|sub-comment)\b",
    "indent_style": r"(?i)margin-?left:\s*\d+|padding-?left:\s*\d+",
    "share": r"(?i)\b(share|retweet|repost|forward|copy\s+link)\b",
    "up": r"(?i)\b(upvote|up-vote|thumbs.?up|like|agree)\b",
    "down": r"(?i)\b(downvote|down-vote|thumbs.?down|dislike|disagree)\b",
    "permalink": r"(?i)\b(permalink|link\s+to|#comment-|#reply-|#post-)\b",
    "deleted": r"(?i)\[(deleted|removed|hidden)\]",
    "read_more": r"(?i)\b(read\s+more|show\s+more|see\s+more|expand)\b",
    "edited": r"(?i)\(\s*edited\s*\)|\b(last\s+modified|updated|edited)\b",
    "pinned": r"(?i)\b(pinned|featured|sticky|stickied)\b",
    "verified": r"(?i)\b(verified|checkmark|badge|tick|official)\b",
    "spoiler": r"(?i)\b(spoiler|content.?warning|cw:|sensitive)\b",
    "thread_depth": r"(?i)\b(level|depth|tier|indent|nested|child)\b",
    "like_count": r"(?i)\b(like|upvote|heart|helpful|agree)\b",
    "bare_count": r"(?i)^\d+[km]?$",
}
#: What a text must have for a pattern to be found in it: one of these in lower case, where 0 stands for any digit.
NEEDLES = {
    "relative": "0 just today yesterday", "date": "0", "month": "0", "near_time": "0 just", "price": "0 price usd eur gbp", "deleted": "[", "read_more": "more expand", "edited": "edited modified updated", "pinned": "pinned featured sticky stickied",
    "counter": "/ char", "cart": "cart bag buy purchase checkout", "load_more": "more next", "collapse": "show hide expand collapse view", "spoiler": "spoiler warning cw: sensitive",
}
HIGH_NEEDLES = "comment repl discussion review feedback thread answer question forum qa komentarz odpowied kommentar antwort respost respuesta reponse & /"
MEDIUM_NEEDLES = "post message response conversation communit"
#: Ancestors, from the parent on, among which navigation and headers are looked for.
NEAR = 5
_FAR = 1 << 40


def _says(text: Column, name: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(PATTERNS[name])


def _holds(low: Column, digits: Column, needles: str) -> Column:
    return reduce(Column.__or__, (digits if n == "0" else F.contains(low, F.lit(n)) for n in needles.split()))


def _long_says(name: str) -> Column:
    """As ``_says`` of the inner text, for rows of ``_searched``: the pattern is tried only on a text that has what it needs."""
    return _holds(F.col("_low"), F.col("_digits"), NEEDLES[name]) & _says(F.col("inner_text"), name)


def _searched(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_low": F.lower("inner_text"), "_digits": F.col("inner_text").rlike("[0-9]")})


def _prepared(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of pages with roots, with what ``scope`` reads: which are roots, and what texts are wanted of.

    Roots go along with the nodes, each as a row behind its own, so that pages come together by one shuffle.
    """
    tag, role, css = F.col("tag"), attribute("role"), attribute("class")
    like = lambda *words: reduce(Column.__or__, (F.contains(css, F.lit(w)) for w in words))
    button = (tag == "button") | (role == "button")
    marks = {
        "button": button,
        "control": button | (tag == "a"),
        "reacts": button | like("like", "vote", "react"),
        "counts": button | like("like", "vote", "count", "react"),
        "heading": tag.rlike("^h[1-6]$") | like("header", "heading"),
        "submits": button | ((tag == "input") & (attribute("type") == "submit")),
        "link": (tag == "a") & F.col("attrs").getItem("href").isNotNull(),
        "guides": tag.isin("nav", "header") | role.isin("navigation", "banner"),
        "is_textarea": tag == "textarea",
        "is_editable": F.col("attrs").getItem("contenteditable").isNotNull(),
        "is_article": role == "article",
    }
    given = ["page_id", "node", "parent", "last", "depth", "tag", "attrs", "text", "pieces", "pieces_end"]
    told = ["group_kind", "group_value", "sig_value"]
    wanted = roots.where("page_id IS NOT NULL").select("page_id", "node", *told, F.lit(1).alias("_key"))
    both = nodes.select(*given, F.lit(0).alias("_key")).unionByName(wanted, allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("node", "_key")
    page = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.lead(c).over(order)
    both = both.withColumns({"_some": F.max("_key").over(page), "is_root": F.coalesce((after("_key") == 1) & (after("node") == F.col("node")), F.lit(False)), **{f"_{c}": after(c) for c in told}})
    kept = both.where("_key = 0 AND _some = 1").withColumns({c: F.when(F.col("is_root"), F.col(f"_{c}")) for c in told})
    kept = kept.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in marks.items()} | {"attr_text": attr_text()})
    return kept.select("page_id", "node", "parent", "last", "depth", "tag", "attrs", "text", "pieces", "pieces_end", "attr_text", "group_kind", "group_value", "sig_value", "is_root", *marks)


_CARRIED = ["page_id", "node", "tag", "attrs", "text", "attr_text", "signature", "sig_group_count", "button", "control", "reacts", "counts", "link"]
_MADE = {
    "root": pa.int32(), "unit": pa.int32(), "place": pa.string(), "child": pa.bool_(), "inner_text": pa.string(), "inner_chars": pa.int64(), "next_text": pa.string(), "parent_attrs": pa.string(), "feed_articles": pa.bool_(),
    "inner_depth": pa.int64(), "tag_variety": pa.int64(), "guided": pa.bool_(), "guide_depth": pa.int64(), "textarea_steps": pa.int64(), "editable_steps": pa.int64(), "recursive": pa.bool_(), "pieces": pa.list_(pa.string()),
}


def scope(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each root and each node below it, its parent, siblings, and headings and submit controls near it.

    ``place`` is root, inner, parent, sibling, heading or submit; ``unit`` is the unit that an inner
    node is or lies in.  ``roots`` are rows of ``discovery.roots``; where they overlap, a node has a
    row for each.
    """
    prepared = _prepared(nodes, roots)
    held = dict(prepared.dtypes) | {"signature": "string", "sig_group_count": "long"}
    ddl = {"int32": "int", "int64": "long", "bool": "boolean", "string": "string"}
    schema = ", ".join([f"{c} {held[c]}" for c in _CARRIED] + [f"{c} {ddl.get(str(k), 'array<string>')}" for c, k in _MADE.items()])

    def step(pages: Pages) -> pa.Table:
        flag = {c: pages.rows.column(c).to_numpy(zero_copy_only=False) for c in ("is_root", "control", "reacts", "counts", "heading", "submits", "link", "guides", "is_textarea", "is_editable", "is_article")}
        texts, starts, ends = laid_out(pages)
        page_of = np.cumsum(np.concatenate([[0], pages.first[1:] != pages.first[:-1]]))
        depth = pages.column("depth").astype(np.int64)
        deepest = pages.up(depth, np.maximum) - depth
        steps = []
        for kind in ("is_textarea", "is_editable"):
            least = pages.up(np.where(flag[kind], depth, _FAR), np.minimum)
            steps.append(pages.down(least - 2 * depth, np.minimum) + depth)
        articles = pages.sums(flag["is_article"].astype(np.int64)) - flag["is_article"] > 0
        tags = pages.rows.column("tag").dictionary_encode().indices.to_numpy()
        shaped = dom.shapes(pages)
        shapes = shaped["signature"].to_pylist()
        named, attr_texts = pages.rows.column("tag").to_pylist(), pages.rows.column("attr_text").to_pylist()
        counts, pieces_end = np.diff(pages.rows.column("pieces").offsets.to_numpy()), pages.column("pieces_end").astype(np.int64)
        pieces = [" ".join(x.split()) for x in pages.rows.column("pieces").flatten().to_pylist()]
        before = np.concatenate([[0], np.cumsum(counts)])
        kinds_of, values, sig_values = (pages.rows.column(c).to_pylist() for c in ("group_kind", "group_value", "sig_value"))
        inner = lambda k: texts[page_of[k]][starts[k] : ends[k]]
        parent, last, first = pages.parent, pages.last, pages.first

        def next_text(k: int) -> str:
            up, follow = parent[k], last[k] + 1
            at = int(first[k])
            if up < 0:
                return ""
            if before[follow] - before[at] > pieces_end[k] and pieces_end[up] > pieces_end[k]:
                return pieces[before[at] + pieces_end[k]]
            return inner(follow) if follow < len(parent) and parent[follow] == up else ""

        rows: list[int] = []
        made: dict[str, list] = {c: [] for c in _MADE}

        def put(k: int, **given) -> None:
            rows.append(k)
            for c in _MADE:
                made[c].append(given.get(c))

        for r in np.flatnonzero(flag["is_root"]).tolist():
            root, up = int(pages.node[r]), int(parent[r])
            children = r + 1 + np.flatnonzero(parent[r + 1 : last[r] + 1] == r)
            unit_of = np.full(last[r] - r + 1, -1, np.int64)
            source = named if kinds_of[r] == "tag" else shapes
            for c in children.tolist():
                if values[r] is not None and source[c] == values[r]:
                    unit_of[c - r : last[c] - r + 1] = pages.node[c]
            same = [c for c in children.tolist() if shapes[c] == sig_values[r]]
            again = any(shapes[k] == sig_values[r] for c in same for k in range(c + 1, int(last[c]) + 1))
            guide, far = up, 0
            while guide >= 0 and far < NEAR and not flag["guides"][guide]:
                guide, far = int(parent[guide]), far + 1
            guided = guide >= 0 and far < NEAR
            base = int(before[first[r]])
            opened, closed = int(before[r]), base + int(pieces_end[r])
            put(r, root=root, place="root", inner_text=inner(r), inner_chars=int(ends[r] - starts[r]), inner_depth=int(deepest[r]), tag_variety=len(np.unique(tags[r : last[r] + 1])), guided=guided, guide_depth=far if guided else -1, textarea_steps=int(steps[0][r]) if steps[0][r] < _FAR >> 1 else None, editable_steps=int(steps[1][r]) if steps[1][r] < _FAR >> 1 else None, recursive=again, pieces=[p for p in pieces[opened:closed] if p])
            for k in range(r + 1, int(last[r]) + 1):
                unit, child = int(unit_of[k - r]), parent[k] == r
                is_unit = unit == pages.node[k]
                read = child or is_unit or flag["control"][k] or flag["reacts"][k] or flag["counts"][k] or flag["link"][k]
                put(
                    k, root=root, place="inner", unit=unit if unit >= 0 else None, child=bool(child), inner_text=inner(k) if read else None, inner_chars=int(ends[k] - starts[k]),
                    next_text=next_text(k) if flag["reacts"][k] else None, parent_attrs=attr_texts[parent[k]] if flag["counts"][k] else None, feed_articles=bool(articles[k]),
                )
            over = up if up >= 0 else r
            put(over, root=root, place="parent", inner_text=inner(over))
            for k in (over + np.flatnonzero(flag["heading"][over : last[over] + 1])).tolist():
                if k != over:
                    put(k, root=root, place="heading", inner_text=inner(k))
            for k in (over + np.flatnonzero(flag["submits"][over : last[over] + 1])).tolist():
                if k != over:
                    put(k, root=root, place="submit", inner_text=inner(k))
            if up >= 0:
                for k in (up + 1 + np.flatnonzero(parent[up + 1 : last[up] + 1] == up)).tolist():
                    if k != r:
                        put(k, root=root, place="sibling", inner_text=inner(k))
        whole = pa.Table.from_batches([pages.rows]).append_column("signature", shaped["signature"]).append_column("sig_group_count", shaped["sig_group_count"].fill_null(0))
        taken = whole.select(_CARRIED).take(pa.array(rows, pa.int64()))
        for name, kind in _MADE.items():
            taken = taken.append_column(name, pa.array(made[name], kind))
        return taken.combine_chunks()

    return by_page(prepared, step, schema)


def page_marks(nodes: DataFrame) -> DataFrame:
    """(page_id, json_ld_has_comment_type, json_ld_has_comment_action) of pages with such scripts."""
    found = nodes.where((F.col("tag") == "script") & (F.lower(attribute("type")) == "application/ld+json"))
    says = lambda kind: F.max(F.col("text").rlike(rf'(?i)"@type"\s*:\s*"{kind}"'))
    return found.groupBy("page_id").agg(says("Comment").alias("json_ld_has_comment_type"), says("CommentAction").alias("json_ld_has_comment_action"))


def _link_host(href: Column) -> Column:
    """The host that a link names; empty if it names none."""
    found = F.regexp_extract(F.trim(href), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(found, r"^.*@", ""), r":\d*$", ""))


def _either(*tests: Column) -> Column:
    return reduce(Column.__or__, (F.coalesce(t, F.lit(False)) for t in tests))


def of_units(rows: DataFrame) -> DataFrame:
    """(page_id, root, unit, ...): what each unit has."""
    inside, is_unit = F.col("node") != F.col("unit"), F.col("node") == F.col("unit")
    tag, aria, text, href = F.col("tag"), attribute("aria-label"), F.col("inner_text"), attribute("href")
    label = F.concat_ws(" ", aria, F.coalesce(text, F.lit("")))
    image, source = inside & (tag == "img"), F.coalesce(F.col("attrs")["src"], F.col("attrs")["data-src"], F.lit(""))
    told = lambda name: inside & F.col("control") & (_says(aria, name) | _says(text, name))
    own = lambda name: is_unit & _long_says(name)
    timed = inside & (tag == "time") & F.col("attrs").getItem("datetime").isNotNull()
    names = F.exists(F.map_keys("attrs"), lambda k: k.rlike(PATTERNS["time_attribute"]))
    tests = {
        "reply": told("reply"), "report": told("report"), "edit": told("edit"), "share": told("share"),
        "reaction": inside & F.col("reacts") & (_says(label, "reaction") | _says(attribute("class"), "reaction")) & (_says(label, "amount") | _says(F.col("next_text"), "amount")),
        "profile": inside & F.col("link") & _says(href, "profile"),
        "permalink": inside & F.col("link") & (_says(href, "permalink") | _says(label, "permalink")),
        "up": inside & F.col("button") & _says(label, "up"),
        "down": inside & F.col("button") & _says(label, "down"),
        "avatar": image & (_says(F.col("attr_text"), "unit_avatar") | _says(source, "unit_avatar_url")),
        "author": inside & _says(F.col("attr_text"), "unit_author"),
        "near_avatar": image & _says(F.col("attr_text"), "near_avatar"),
        "near_author": inside & _says(F.col("attr_text"), "near_author"),
        "near_time": _either(timed, own("near_time")),
        "time": _either(timed, is_unit & names, own("relative"), own("date"), own("month")),
        "keyword": is_unit & plain(full_attr_text()).rlike(dom.HIGH), "price": own("price"), "deleted": own("deleted"), "read_more": own("read_more"), "edited": own("edited"), "pinned": own("pinned"),
        "quote": inside & (tag == "blockquote"),
        "action": inside & F.col("button"),
        "indent": is_unit & (attribute("style").rlike(PATTERNS["indent_style"]) | _says(F.col("attr_text"), "indent")),
        "levels": is_unit & (_says(F.col("attr_text"), "thread_depth") | _says(attribute("data-depth"), "thread_depth") | _says(attribute("data-level"), "thread_depth")),
        "like_count": inside & F.col("counts") & F.coalesce(text, F.lit("")).rlike(PATTERNS["bare_count"]) & _says(F.concat_ws(" ", "attr_text", "parent_attrs"), "like_count"),
        "empty": is_unit & (F.col("inner_chars") < 10),
        "nests": is_unit & (F.col("sig_group_count") >= 2),
    }
    inner = _searched(rows.where(F.col("unit").isNotNull() & (F.col("place") == "inner")))
    return inner.groupBy("page_id", "root", "unit").agg(*(F.max(_either(test)).alias(k) for k, test in tests.items()), F.max(F.when(is_unit, F.struct("inner_text"))).alias("u"))


def of_roots(rows: DataFrame, hosts: DataFrame | None) -> DataFrame:
    """(page_id, root, ...): what each root's subtree and surroundings have.

    A root's own columns are taken from its row, tests of all other rows are summed up as flags and
    counts of fixed size, and hosts meet the links alone; so no text is sorted.
    """
    keys = ["page_id", "root"]
    place, tag, text = F.col("place"), F.col("tag"), F.col("inner_text")
    inner, aria = place == "inner", attribute("aria-label")
    source = F.coalesce(F.col("attrs")["src"], F.col("attrs")["data-src"], F.lit(""))
    any_ = lambda test: F.max(_either(test))
    some = lambda test: F.count_if(_either(test))
    prop = lambda *names: any_(inner & attribute("itemprop").isin(*names))
    submit = _says(text, "submit") | _says(attribute("value"), "submit") | _says(aria, "submit")
    label = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(attribute("value"))
    links = inner & F.col("link")
    own = _searched(rows.where("place = 'root'")).select(
        *keys, "tag", "inner_text", "inner_chars", "text", "attr_text", "signature", "inner_depth", "tag_variety", "guided", "guide_depth", "textarea_steps", "editable_steps", "recursive", plain(full_attr_text()).alias("_full"),
        F.map_keys("attrs").alias("attr_names"), F.map_values("attrs").alias("attr_values"), (attribute("role") == "feed").alias("is_feed"), _either(_long_says("deleted")).alias("deleted_placeholder_present"),
        _either(_holds(F.col("_low"), F.col("_digits"), NEEDLES["relative"]) & F.exists("pieces", lambda p: p.rlike(PATTERNS["relative"]))).alias("has_relative_time_text"),
    )
    submits = rows.where((place == "submit") & submit).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", label.alias("label")))), lambda x: x["label"]), " | ").alias("submit_labels"))
    hrefs = rows.where(links).select(*keys, _link_host(attribute("href")).alias("_name")).where("_name <> ''").groupBy(*keys, "_name").agg(F.count("*").alias("n"))
    if hosts is not None:
        hrefs = hrefs.join(hosts.select("page_id", F.col("host").alias("_host")), "page_id", "left").where(F.col("_name") != F.coalesce("_host", F.lit("")))
    summed = _searched(rows).groupBy(*keys).agg(
        any_((place == "heading") & plain(F.coalesce(text, F.lit(""))).rlike(dom.COUNTED)).alias("comment_header_with_count"),
        some(inner & F.col("button")).alias("action_button_count"),
        some(inner & F.col("button") & (_says(aria, "more_options") | _says(text, "more_options"))).alias("more_options_button_count"),
        some(inner & _says(F.col("attr_text"), "author")).alias("author_element_count"),
        some(inner & (tag == "img") & (_says(F.concat_ws(" ", "attr_text", attribute("alt")), "avatar") | _says(source, "avatar_url"))).alias("avatar_img_count"),
        some(links).alias("link_count"), F.sum(F.when(links, F.col("inner_chars")).otherwise(0)).alias("link_text_length"),
        some(inner & (tag == "time") & F.col("attrs").getItem("datetime").isNotNull()).alias("time_datetime_element_count"),
        some(inner & _says(attribute("itemtype"), "schema")).alias("schema_org_comment_count"), some(inner & (attribute("role") == "comment")).alias("aria_role_comment_count"),
        some(inner & (attribute("role") == "feed")).alias("aria_role_feed_count"),
        any_(inner & (attribute("role") == "feed") & F.col("feed_articles")).alias("aria_role_feed_with_articles"),
        prop("author").alias("microdata_itemprop_author"), prop("datePublished", "dateCreated").alias("microdata_itemprop_date_published"), prop("text", "description").alias("microdata_itemprop_text"),
        any_((place == "sibling") & _long_says("load_more")).alias("pagination_load_more_adjacent"),
        any_((place == "parent") & _long_says("counter")).alias("char_counter_near_textarea"), any_((place == "parent") & _long_says("cart")).alias("add_to_cart_present"),
        any_((place == "submit") & submit).alias("submit_button_present"),
        any_(inner & F.col("child") & _long_says("collapse")).alias("collapse_expand_control"),
        any_(inner & (_says(F.col("attr_text"), "spoiler") | _either(F.col("child") & _long_says("spoiler")))).alias("spoiler_tag_present"),
        any_(inner & F.col("child") & (tag == "tr")).alias("has_tr_children"), any_(inner & _says(F.col("attr_text"), "rating")).alias("star_rating_present"),
        some(inner & (_says(F.col("attr_text"), "verified") | _says(attribute("title"), "verified"))).alias("verification_badge_count"),
        some(inner & (tag.isin("button", "input", "select", "textarea") | (attribute("role") == "button") | F.col("attrs").getItem("tabindex").isNotNull())).alias("ui_interactive_element_count"),
        some(inner & (tag == "form")).alias("ui_form_count"), some(inner & F.col("attrs").getItem("contenteditable").isNotNull()).alias("ui_contenteditable_count"),
    )
    out = own.join(summed, keys).join(submits, keys, "left").join(hrefs.groupBy(*keys).agg(F.sum("n").alias("external_link_count")), keys, "left")
    return out.na.fill("", ["submit_labels"]).na.fill(0, ["external_link_count"])


def regions(nodes: DataFrame, roots: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """All features that ``scoring`` reads, and others, of ``roots`` (rows of ``discovery.roots``) among ``nodes``.

    ``hosts`` (page_id, host) tell which links lead elsewhere; without them every absolute link does.
    """
    rows = written(scope(nodes, roots), "scope")
    units = of_units(rows)
    share = lambda c: ratio(F.count_if(F.col(c)), F.count("*"))
    first = F.min_by(F.col("pinned"), "unit")
    summed = units.withColumns({"colocated": F.col("avatar") & F.col("author"), "signed": F.col("near_avatar") & F.col("near_author") & F.col("near_time"), "voted": F.col("up") & F.col("down")}).groupBy("page_id", "root").agg(
        F.count("*").alias("unit_count"),
        *(share(c).alias(n) for c, n in (("reply", "reply_button_unit_coverage"), ("report", "report_flag_unit_coverage"), ("reaction", "reaction_coverage"), ("edit", "edit_delete_coverage"), ("time", "time_datetime_per_unit"), ("profile", "profile_link_coverage"), ("keyword", "keyword_unit_high_coverage"), ("colocated", "author_avatar_coverage"), ("empty", "text_empty_unit_proportion"), ("price", "price_coverage"), ("share", "share_coverage"), ("quote", "quote_coverage"))),
        *(F.count_if(F.col(c)).alias(n) for c, n in (("signed", "author_timestamp_unit_count"), ("voted", "units_with_vote_pair"), ("permalink", "units_with_permalink"), ("share", "units_with_share"), ("quote", "units_with_blockquote"), ("price", "price_currency_unit_count"), ("deleted", "deleted_placeholder_unit_count"), ("read_more", "units_with_read_more"), ("edited", "edited_unit_count"), ("indent", "indented_unit_count"), ("levels", "depth_indicator_unit_count"), ("like_count", "units_with_like_count"), ("action", "units_with_action_buttons"))),
        F.max("nests").cast("int").alias("reply_nesting_depth"), first.alias("pinned_post_indicator"),
        F.substring(F.array_join(F.transform(F.slice(F.filter(F.array_sort(F.collect_list(F.struct("unit", F.col("u.inner_text").alias("t")))), lambda x: x["t"] != ""), 1, 3), lambda x: F.substring(x["t"], 1, 220)), " | "), 1, 500).alias("sample_text"),
    )
    groups = roots.select("page_id", F.col("node").alias("root"), "last", "parent", "depth", "candidate_rank", "quick_score", F.coalesce("repeating_group_count", F.lit(0)).alias("repeating_group_count"), "xpath_star_group_count", "group_kind", "group_value", F.coalesce("sibling_homogeneity_score", F.lit(0.0)).alias("sibling_homogeneity_score"), "child_count", "child_variety")
    out = groups.join(of_roots(rows, hosts), ["page_id", "root"]).join(summed, ["page_id", "root"], "left").join(page_marks(nodes), "page_id", "left")
    numbers = [c for c, k in summed.dtypes if c not in ("page_id", "root") and k in ("bigint", "int", "double")]
    out = out.na.fill(0, numbers).na.fill(False, ["pinned_post_indicator", "json_ld_has_comment_type", "json_ld_has_comment_action"])
    text, n, full = F.col("inner_text"), F.col("repeating_group_count"), F.col("_full")
    out = out.withColumn("_plain", plain(text))
    scanned = lambda needles, pattern: _holds(F.col("_plain"), F.lit(False), needles) & F.col("_plain").rlike(pattern)
    high = lambda c: plain(c).rlike(dom.HIGH)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    near = lambda c, most: F.coalesce(F.col(c) < most, F.lit(False))
    outside = ratio(F.col("external_link_count"), F.col("link_count"))
    out = out.withColumns({
        "schema_org_comment_itemtype": F.col("schema_org_comment_count") > 0, "aria_role_comment": F.col("aria_role_comment_count") > 0, "aria_role_feed": (F.col("aria_role_feed_count") > 0) | F.col("is_feed"),
        "attributes_contain_keywords": full.rlike(dom.HIGH), "keyword_container_high": full.rlike(dom.HIGH), "keyword_container_med": full.rlike(dom.MEDIUM), "keyword_container_low": full.rlike(r"\b(item|card|entry|block|unit|feed|list)\b"),
        "keyword_attr_name_high": F.exists("attr_names", high), "keyword_attr_value_high": F.exists("attr_values", high), "keyword_tag_name_high": high(F.col("tag")), "keyword_direct_text_high": high(squeezed(F.col("text"))),
        "keyword_text_high": scanned(HIGH_NEEDLES, dom.HIGH), "keyword_text_med": scanned(MEDIUM_NEEDLES, dom.MEDIUM), "keyword_unit_high": F.col("keyword_unit_high_coverage") > 0,
        "keyword_container_raw": full, "submit_button_keyword_high": high(F.col("submit_labels")), "submit_button_keyword_med": plain(F.col("submit_labels")).rlike(dom.MEDIUM),
        "sig_id_count_weak": n >= 3, "sig_id_count_medium": n >= 8, "sig_id_count_strong": n >= 15, "depth_and_variety_pass": (F.col("inner_depth") >= 3) & (F.col("tag_variety") >= 5),
        "author_timestamp_colocated": F.col("author_timestamp_unit_count") > 0, "sig_id_recursive_nesting": F.col("recursive"), "upvote_downvote_pair": F.col("units_with_vote_pair") > 0,
        **{k: F.col(c) > 0 for k, c in (("permalink_per_unit", "units_with_permalink"), ("share_button_per_unit", "units_with_share"), ("quote_block_per_unit", "units_with_blockquote"), ("price_currency_in_unit", "price_currency_unit_count"), ("read_more_truncation", "units_with_read_more"), ("has_edit_history_indicator", "edited_unit_count"), ("indent_margin_pattern", "indented_unit_count"), ("thread_depth_indicator", "depth_indicator_unit_count"), ("like_count_pattern", "units_with_like_count"), ("has_avatar", "avatar_img_count"), ("includes_author", "author_element_count"), ("has_more_options_button", "more_options_button_count"), ("has_action_buttons", "action_button_count"), ("verification_badge_present", "verification_badge_count"), ("text_contains_links", "link_count"))},
        "reply_button_per_unit": F.col("reply_button_unit_coverage") >= 0.5, "has_relative_time": (F.col("time_datetime_element_count") > 0) | F.col("has_relative_time_text"),
        "textarea_tree_proximity": F.col("textarea_steps"), "contenteditable_tree_proximity": F.col("editable_steps"), "nearest_input_distance": F.least("textarea_steps", "editable_steps"),
        "has_nearby_textarea": near("textarea_steps", 30), "textarea_close": near("textarea_steps", 20), "aligned_with_textarea": near("textarea_steps", 15), "textarea_very_close": near("textarea_steps", 10), "aligned_with_content_editable": near("editable_steps", 15),
        "has_text_content": F.col("inner_chars") > 20, "total_text_length": F.col("inner_chars"), "text_char_count": F.col("inner_chars"), "text_word_count": F.size(words), "text_contains_mentions": F.contains(text, F.lit("@")) & _says(text, "mention"), "text_contains_hashtags": F.contains(text, F.lit("#")) & _says(text, "hashtag"),
        "text_emoji_count": emoji_count(text), "text_question_mark_count": F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))), "text_exclamation_mark_count": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "link_density": ratio(F.col("link_text_length"), F.col("inner_chars")), "external_link_proportion": outside, "high_external_link_density": outside > 0.6, "external_link_density_low": outside < 0.2,
        "table_row_structure": F.col("tag").isin("table", "tbody") | F.col("has_tr_children"), "no_text_content_in_units": F.col("text_empty_unit_proportion") > 0.8, "nav_header_ancestor": F.col("guided"), "star_rating_no_text": F.col("star_rating_present") & (F.size(words) <= 15),
    })
    return out.withColumnRenamed("root", "node").drop("_full", "_plain", "text", "is_feed", "guided", "recursive", "attr_names", "attr_values", "textarea_steps", "editable_steps")
