"""What nodes hold: the text and the markup of their subtrees, and samples of their units.

A page is laid out once as one string (all pieces of text in order, or all tags and pieces); what a
node holds is a part of it, between its opening and its end.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.tree import Pages, by_page
from agora.sources.html import VOID

#: Elements whose text is not escaped.
RAW = ("script", "style")
#: Blanks that SQL squeezes by name, and the spaces that its trim takes from both ends (those of category Zs).
_NAMED = re.compile("[ \t\n\r]+")
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeezed(text: str) -> str:
    """All blanks that Unicode knows are one space, and none at the ends."""
    return " ".join(text.split())


def sql_squeezed(text: str) -> str:
    """Spaces, tabs and ends of lines are one space, other blanks stay; spaces of all widths are taken from the ends."""
    return _NAMED.sub(" ", text).strip(_SPACES)


def _chosen(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The nodes of pages that have chosen ones, and which these are.

    The chosen go along with the nodes, each as a row behind its own, so that pages come together by one shuffle.
    """
    keys = chosen.select("page_id", "node").where("page_id IS NOT NULL").distinct()
    both = nodes.withColumn("_key", F.lit(0)).unionByName(keys.withColumn("_key", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("node", "_key")
    page = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = both.withColumns({"_chosen": (F.lead("_key").over(order) == 1) & (F.lead("node").over(order) == F.col("node")), "_some": F.max("_key").over(page)})
    return marked.where("_key = 0 AND _some = 1").drop("_key", "_some")


def laid_out(pages: Pages, squeeze: Callable[[str], str] = squeezed) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, starts, ends): each page's squeezed text, and where in it each node's own and inner text stands."""
    pieces = pages.rows.column("pieces")
    counts = np.diff(pieces.offsets.to_numpy())
    words = [squeeze(x) for x in pieces.flatten().to_pylist()]
    ends_of = pages.column("pieces_end").astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    base = before[pages.first]
    texts, starts, ends = [], np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    cuts = [*np.unique(pages.first).tolist(), len(counts)]
    for a, b in zip(cuts, cuts[1:]):
        own = words[before[a] : before[b - 1] + counts[b - 1]]
        shown = [w for w in own if w]
        texts.append(" ".join(shown))
        # piece k begins at opening[k]; those left out are nowhere
        sizes = [len(w) + 1 if w else 0 for w in own]
        opening = np.array([0, *accumulate(sizes)])
        first, last = opening[before[a:b] - base[a]], opening[ends_of[a:b]]
        starts[a:b], ends[a:b] = first, np.maximum(first, last - 1)
    return texts, starts, ends


def texts(nodes: DataFrame, chosen: DataFrame, squeeze: Callable[[str], str] = squeezed) -> DataFrame:
    """(page_id, node, inner_text) of ``chosen``: all text at and below a node in order, blanks squeezed piece by piece."""

    def step(pages: Pages) -> pa.RecordBatch:
        laid, starts, ends = laid_out(pages, squeeze)
        which = np.cumsum(np.concatenate([[0], pages.first[1:] != pages.first[:-1]]))
        rows = np.flatnonzero(pages.rows.column("_chosen").fill_null(False).to_numpy(zero_copy_only=False))
        found = [laid[which[r]][starts[r] : ends[r]] for r in rows.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(pages.page[rows]), pa.array(pages.node[rows].astype(np.int32)), pa.array(found, pa.string())], ["page_id", "node", "inner_text"])

    columns = ("page_id", "node", "parent", "last", "depth", "pieces", "pieces_end")
    return by_page(_chosen(nodes.select(*columns), chosen), step, "page_id long, node int, inner_text string")


def _opening(tag: str, attrs: list[tuple[str, str]]) -> str:
    return "<" + tag + "".join(f' {k}="{entities.escape(v).replace("&#x27;", chr(39))}"' for k, v in attrs) + ">"


def serialized(tags: list[str], attrs: list, lasts: list[int], pieces: list[list[str]], ends: list[int]) -> tuple[list[str], list[int], list[int]]:
    """(tokens, opened, closed): a page's tags and texts in order, and which tokens open and end each node.

    A node ends once its last descendant has been opened and its last piece has come.
    """
    tokens: list[str] = []
    opened, closed, held, seen = [0] * len(tags), [0] * len(tags), [], 0

    def close(k: int) -> None:
        while held and lasts[held[-1]] <= k and ends[held[-1]] <= seen:
            node = held.pop()
            if tags[node] not in VOID:
                tokens.append(f"</{tags[node]}>")
            closed[node] = len(tokens)

    for k, tag in enumerate(tags):
        opened[k] = len(tokens)
        tokens.append(_opening(tag, attrs[k] or []))
        held.append(k)
        close(k)
        for piece in pieces[k]:
            tokens.append(piece if held and tags[held[-1]] in RAW else entities.escape(piece, quote=False))
            seen += 1
            close(k)
    return tokens, opened, closed


def markup(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, node, outer_html, outer_html_length, text_excerpt) of ``chosen``, each whole; the excerpt has 1200 characters.

    Markup is written anew from the nodes: entities are escaped, every element that has content is
    ended, attributes are quoted, comments are left out.
    """

    def step(pages: Pages) -> pa.RecordBatch:
        wanted = pages.rows.column("_chosen").fill_null(False).to_numpy(zero_copy_only=False)
        tags, attrs, pieces, ends = (pages.rows.column(c).to_pylist() for c in ("tag", "attrs", "pieces", "pieces_end"))
        out, laid = [], laid_out(pages)
        cuts = [*np.unique(pages.first).tolist(), len(tags)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows = a + np.flatnonzero(wanted[a:b])
            if len(rows):
                tokens, opened, closed = serialized(tags[a:b], attrs[a:b], (pages.last[a:b] - a).tolist(), pieces[a:b], ends[a:b])
                for r in rows.tolist():
                    whole = "".join(tokens[opened[r - a] : closed[r - a]])
                    out.append((int(pages.page[r]), int(pages.node[r]), whole, len(whole), laid[0][n][laid[1][r] : laid[2][r]][:1200]))
        columns = [*zip(*out)] or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()))], ["page_id", "node", "outer_html", "outer_html_length", "text_excerpt"])

    columns = ("page_id", "node", "parent", "last", "depth", "tag", "attrs", "pieces", "pieces_end")
    return by_page(_chosen(nodes.select(*columns), chosen), step, "page_id long, node int, outer_html string, outer_html_length long, text_excerpt string")


def sampled(inner: Column, node: Column) -> Column:
    """An aggregate over a region's units: the first three texts that are not empty, 220 characters of each, in one of 500."""
    units = F.array_sort(F.collect_list(F.struct(node.alias("n"), inner.alias("t"))))
    some = F.slice(F.filter(units, lambda u: u["t"] != ""), 1, 3)
    return F.substring(F.array_join(F.transform(some, lambda u: F.substring(u["t"], 1, 220)), " | "), 1, 500)


def sample_text(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """(page_id, root, unit_count, sample_text) of regions, from ``units`` (page_id, root, node)."""
    found = units.join(texts(nodes, units), ["page_id", "node"])
    return found.groupBy("page_id", "root").agg(F.count("*").alias("unit_count"), sampled(F.col("inner_text"), F.col("node")).alias("sample_text"))
