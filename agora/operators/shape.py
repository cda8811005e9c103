"""Places and kinds of single nodes: paths, distances to inputs, kinds for a graph, nested candidates.

What goes up the tree is read in passes over whole pages, which cost in proportion to their nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.hashing import hash31
from agora.functions.text import squeezed
from agora.operators import dom
from agora.operators.dom import input_distances  # noqa: F401
from agora.operators.tree import Pages, by_page

#: What the kinds of graph nodes are told by.
ACTION_TAGS = ("a", "button", "input", "label", "select", "summary", "textarea")
MEDIA_TAGS = ("canvas", "img", "picture", "svg", "video")
INLINE_TAGS = ("a", "abbr", "b", "cite", "code", "em", "i", "small", "span", "strong", "time")
PLAIN_TAGS = ("body", "defs", "g", "head", "html", "link", "meta", "path", "script", "style", "title")
META_TEXT = r"(?i)\b(\d+\s*(s|m|h|d|w|mo|yr)s?\b|ago|reply|replies|like|likes|share|shares|edited|pinned|follow|following)\b"
ACTION_ROLES = ("button", "link", "textbox")


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_index (from 0), sibling_count and tag_index (from 1, among siblings of the tag)."""
    siblings = Window.partitionBy("page_id", "parent")
    alike = Window.partitionBy("page_id", "parent", "tag").orderBy("node")
    return nodes.withColumns({
        "parent_index": F.when(F.col("parent") < 0, 0).otherwise(F.row_number().over(siblings.orderBy("node")) - 1),
        "sibling_count": F.when(F.col("parent") < 0, 0).otherwise(F.count("*").over(siblings)),
        "tag_index": F.row_number().over(alike),
    })


def attributes() -> dict[str, Column]:
    """Columns over ``attrs``: classes, data- and aria- attributes as name=value, role."""
    named = lambda prefix: F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: k.startswith(prefix))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    classes = F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")
    return {
        "classes": classes,
        "classes_count": F.size(classes),
        "data_attributes": named("data-"),
        "data_attributes_count": F.size(named("data-")),
        "aria_attributes": named("aria-"),
        "aria_attributes_count": F.size(named("aria-")),
        "role_attribute": F.coalesce(F.col("attrs")["role"], F.lit("")),
    }


def _escaped(name: str) -> str:
    """An id as CSS writes it: a backslash before what is no plain character."""
    return "".join("\\" + c if c in " !\"#$%&'()*+,./:;<=>?@[\\]^`{|}~" else c for c in name)


def _steps(pages: Pages) -> tuple[np.ndarray, np.ndarray]:
    """(index, count): each node's place among its siblings of the same tag, and how many these are."""
    tags = pages.rows.column("tag").dictionary_encode().indices.to_numpy()
    family = np.where(pages.parent >= 0, pages.parent, -1 - pages.first)
    order = np.lexsort((pages.node, tags, family))
    fresh = np.concatenate([[True], (tags[order][1:] != tags[order][:-1]) | (family[order][1:] != family[order][:-1])])
    starts = np.flatnonzero(fresh)
    sizes = np.diff([*starts, len(order)])
    index, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    index[order], count[order] = np.arange(len(order)) - np.repeat(starts, sizes) + 1, np.repeat(sizes, sizes)
    return index, count


def paths(nodes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(page_id, node, xpath, xpath_star, css_path, sigpath, node_id) of ``chosen``, or of all nodes.

    An xpath has an index where it is over 1, and its last becomes ``*`` in xpath_star.  A css_path
    goes up to the nearest id and has an index where siblings share the tag.  sigpath has the
    signature ids from the root down.
    """

    def step(pages: Pages) -> pa.RecordBatch:
        index, count = _steps(pages)
        tags, ids, sigs, shapes = (pages.rows.column(c).to_pylist() for c in ("tag", "id", "sig_id", "signature"))
        places, counts, parents = index.tolist(), count.tolist(), pages.parent.tolist()
        out = []
        for row in np.flatnonzero(pages.rows.column("_chosen").fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            xpath, css, sig, at, ended = [], [], [], row, False
            while at >= 0:
                xpath.append(tags[at] if places[at] == 1 else f"{tags[at]}[{places[at]}]")
                sig.append(str(sigs[at]))
                if not ended:
                    ended = bool(ids[at])
                    css.append(f"css={tags[at]}#{_escaped(ids[at])}" if ended else f"css={tags[at]}" + (f":nth-of-type({places[at]})" if counts[at] > 1 else ""))
                at = parents[at]
            path = "/" + "/".join(reversed(xpath))
            star = (path[: path.rindex("[")] if path.endswith("]") else path) + "[*]"
            out.append((int(pages.page[row]), int(pages.node[row]), path, star, " >> ".join(reversed(css)), "->".join(reversed(sig)), f"{path}|{shapes[row]}"))
        columns = [*zip(*out)] or [()] * 7
        kinds = (pa.int64(), pa.int32(), *[pa.string()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "node", "xpath", "xpath_star", "css_path", "sigpath", "named"])

    shaped = dom.signatures(nodes).select("page_id", "node", "parent", "last", "depth", "tag", F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"), "sig_id", "signature")
    if chosen is None:
        marked = shaped.withColumn("_chosen", F.lit(True))
    else:
        marked = shaped.join(chosen.select("page_id").distinct(), "page_id", "left_semi").join(chosen.select("page_id", "node").distinct().withColumn("_chosen", F.lit(True)), ["page_id", "node"], "left")
    found = by_page(marked, step, "page_id long, node int, xpath string, xpath_star string, css_path string, sigpath string, named string")
    return found.withColumn("node_id", hash31(F.col("named"))).drop("named")


def resolved(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ref_id, page_id, node, by) of ``wanted`` (ref_id, page_id, css_path, xpath): the node that a css_path names, else the xpath.

    A path finds what has it on the page: an equality join of ``paths``, the first in document order
    where several have it.  Rows whose paths are on no node have a null node.
    """
    every = paths(nodes.join(wanted.select("page_id").distinct(), "page_id", "left_semi"))
    asked = wanted.select("ref_id", "page_id", F.explode(F.array(F.struct(F.lit("css").alias("by"), F.col("css_path").alias("path")), F.struct(F.lit("xpath").alias("by"), F.col("xpath").alias("path")))).alias("w")).select("ref_id", "page_id", "w.by", "w.path").where("path <> ''")
    held = every.select("page_id", "node", F.explode(F.array("css_path", "xpath")).alias("path"))
    met = asked.join(held, ["page_id", "path"]).groupBy("ref_id", "page_id").agg(F.min(F.struct("by", "node")).alias("m"))
    return wanted.select("ref_id", "page_id").join(met, ["ref_id", "page_id"], "left").select("ref_id", "page_id", F.col("m.node").alias("node"), F.col("m.by").alias("by"))


def kinds(nodes: DataFrame) -> DataFrame:
    """(page_id, node, parent, kind, chars) for a graph: ACTION, MEDIA, COMMENT, META, TEXT, or null.

    Lengths are those of a node's text with all below it; words that tell META are looked for in its own
    text.  Nodes below the page's largest group of like siblings count as inside a block.
    """
    upto = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    runs = nodes.withColumn("own", squeezed(F.col("text"))).withColumn("run", F.sum(F.length("own")).over(upto))
    ends = runs.select("page_id", F.col("node").alias("last"), F.col("run").alias("end"))
    of = nodes.groupBy("page_id", F.col("parent").alias("node")).agg(
        F.count("*").alias("children"),
        F.bool_and(F.col("tag").isin(*INLINE_TAGS)).alias("inline"),
        F.bool_or(F.col("tag").isin(*ACTION_TAGS)).alias("act"),
        F.bool_or(F.col("tag").isin(*MEDIA_TAGS)).alias("show"),
    )
    block = dom.repeated(dom.signatures(nodes)).groupBy("page_id").agg(F.max_by("node", F.struct("repeating_group_count", -F.col("node"))).alias("node"), F.max("repeating_group_count").alias("size"))
    spans = block.where("size >= 2").join(nodes.select("page_id", "node", "last"), ["page_id", "node"]).select("page_id", F.col("node").alias("b_first"), F.col("last").alias("b_last"))
    all_ = runs.join(ends, ["page_id", "last"]).join(of, ["page_id", "node"], "left").join(spans, "page_id", "left")
    all_ = all_.withColumns({"chars": F.col("end") - F.col("run") + F.length("own"), "children": F.coalesce("children", F.lit(0)), "role": F.lower(squeezed(F.coalesce(F.col("attrs")["role"], F.lit(""))))})
    yes = lambda c: F.coalesce(c, F.lit(False))
    tag, chars, children, plain = F.col("tag"), F.col("chars"), F.col("children"), F.coalesce("inline", F.lit(True))
    inside = yes((F.col("b_first") < F.col("node")) & (F.col("node") <= F.col("b_last")))
    kind = (
        F.when(tag.isin(*PLAIN_TAGS), None)
        .when(tag.isin(*ACTION_TAGS) | F.col("role").isin(*ACTION_ROLES) | (yes(F.col("act")) & chars.between(1, 40) & (children <= 4)), "ACTION")
        .when(tag.isin(*MEDIA_TAGS) | (yes(F.col("show")) & (chars <= 24) & (children <= 3)), "MEDIA")
        .when(plain & ((inside & (chars >= 36)) | (chars >= 96)), "COMMENT")
        .when((tag == "time") | (plain & (F.col("own").rlike(META_TEXT) | chars.between(1, 24))), "META")
        .when(plain & (chars >= 24), "TEXT")
    )
    return all_.select("page_id", "node", "parent", kind.alias("kind"), "chars")


def nested_penalty(candidates: DataFrame, score: str = "score", least: float = 0.35, factor: float = 0.6) -> DataFrame:
    """Candidates (page_id, node, last) with ``final_score``: times ``factor`` below another whose score is ``least`` or more."""
    order = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col(score) >= least, F.col("last"))).over(order)  # spans are nested or apart
    return candidates.withColumn("_reach", reach).withColumn("final_score", F.when(F.col("_reach") >= F.col("node"), F.col(score) * factor).otherwise(F.col(score))).drop("_reach")
