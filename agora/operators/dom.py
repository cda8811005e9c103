"""Structure of pages over the node table: signatures, groups of like children, ways to inputs, and the words of discussions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions.hashing import hash31
from agora.functions.numbers import ratio
from agora.functions.text import emoji_count, plain, squeezed
from agora.operators.tree import Pages, by_page
from agora.session import written

#: Keyword patterns on text in lower case without accents.
HIGH = r"\b(?:comment|comments|commenter|reply|replies|discussion|discussions|review|reviews|feedback|thread|threads|answer|answers|question|questions|forum|forums|qa|qa_answers|komentarz|komentarze|komentarzy|odpowiedz|odpowiedzi|comentario|comentarios|commentaire|commentaires|kommentar|kommentare|antwort|antworten|resposta|respostas|respuesta|respuestas|reponse|reponses)\b|\bq\s*(?:&|/)\s*a\b"
MEDIUM = r"\b(?:post|posts|message|messages|response|responses|conversation|conversations|community|communities)\b"
COUNTED = r"\b(?:\d+)\s*(?:comment|reply|response|review|discussion|answer|question|post|komentarz|komentarze|odpowiedz|odpowiedzi|comentario|comentarios|commentaire|commentaires|kommentar|kommentare|antwort|antworten|resposta|respostas|respuesta|respuestas|reponse|reponses)s?\b"
QA = r"\b(?:answer|answers|question|questions|qa|qa_answers|odpowiedz|odpowiedzi|respuesta|respuestas|resposta|respostas|antwort|antworten|reponse|reponses)\b|\bq\s*(?:&|/)\s*a\b"
THREAD = r"\b(?:forum|forums|thread|threads|discussion|discussions|post|posts)\b"


def shapes(pages: Pages) -> dict[str, pa.Array]:
    """What ``signatures`` and ``repeated`` tell, of whole pages in one pass, for plans that need both with texts.

    child_count, child_variety, signature; sig_group_count and xpath_star_group_count with sig_value and
    tag_value, the largest groups of like children (the first of equal ones), null without children.
    """
    tags = pages.rows.column("tag").dictionary_encode()
    words = sorted(tags.dictionary.to_pylist())
    places = {w: k for k, w in enumerate(words)}
    codes = np.array([places[w] for w in tags.dictionary.to_pylist()], np.int64)[tags.indices.to_numpy()]
    n = len(codes)
    children = np.flatnonzero(pages.parent >= 0)
    fresh = lambda *keys: np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])[: len(keys[0])]

    def sized(values: np.ndarray) -> tuple[np.ndarray, ...]:
        """Children by parent and value, where each group of them begins, and its parent and size."""
        order = children[np.lexsort((children, values[children], pages.parent[children]))]
        starts = np.flatnonzero(fresh(pages.parent[order], values[order]))
        return order, starts, pages.parent[order][starts], np.diff([*starts, len(order)])

    def largest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, starts, parents, sizes = sized(values)
        by = np.lexsort((order[starts], -sizes, parents))
        best = by[fresh(parents[by])]
        most, value = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        most[parents[best]], value[parents[best]] = sizes[best], values[order[starts[best]]]
        return most, value

    order, starts, parents, _ = sized(codes)
    count, variety = np.bincount(pages.parent[children], minlength=n), np.bincount(parents, minlength=n)
    named, below = [words[c] for c in codes[order].tolist()], [""] * n
    cuts = np.flatnonzero(fresh(pages.parent[order]))
    for up, a, b in zip(pages.parent[order][cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        below[up] = ",".join(named[a:b])
    signature = pa.array([f"{words[c]}[{b}]" for c, b in zip(codes.tolist(), below)], pa.string())
    coded = signature.dictionary_encode()
    (t_most, t), (s_most, s) = largest(codes), largest(coded.indices.to_numpy().astype(np.int64))
    none = count == 0
    taken = lambda values, at: pa.array(values, pa.string()).take(pa.array(at, mask=none))
    return {
        "child_count": pa.array(count.astype(np.int32)), "child_variety": pa.array(variety.astype(np.int32)), "signature": signature,
        "sig_group_count": pa.array(s_most, mask=none), "xpath_star_group_count": pa.array(t_most, mask=none),
        "sig_value": taken(coded.dictionary, s), "tag_value": taken(words, t),
    }


SHAPES = "child_count int, child_variety int, signature string, sig_group_count long, xpath_star_group_count long, sig_value string, tag_value string"


def signatures(nodes: DataFrame) -> DataFrame:
    """Nodes with child_count, signature (tag and the sorted tags of its children) and sig_id."""
    tags = nodes.groupBy("page_id", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    out = nodes.join(tags, ["page_id", "node"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    signature = F.concat("tag", F.lit("["), F.array_join("tags", ","), F.lit("]"))
    return out.withColumns({"child_count": F.size("tags"), "child_variety": F.size(F.array_distinct("tags")), "signature": signature}).withColumn("sig_id", hash31(F.col("signature"))).drop("tags")


def repeated(nodes: DataFrame) -> DataFrame:
    """(page_id, node) of parents with their largest group of like children: by signature, or by tag if that is larger.

    Columns: repeating_group_count, sig_group_count, xpath_star_group_count, sig_value, group_kind (signature
    or tag), group_value and sibling_homogeneity_score.
    """
    children = nodes.where("parent >= 0")

    def groups(value: str, kind: str) -> DataFrame:
        sized = children.groupBy("page_id", "parent", F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min("node").alias("first"))
        best = F.max_by(F.struct("value", "n"), F.struct("n", (-F.col("first")).alias("f")))
        return sized.groupBy("page_id", "parent").agg(best.alias(kind), F.sum("n").alias("children"), F.max("n").alias("most"))

    by_signature = groups("signature", "s").withColumnsRenamed({"most": "s_most"})
    by_tag = groups("tag", "t").drop("children").withColumnsRenamed({"most": "t_most"})
    both = by_signature.join(by_tag, ["page_id", "parent"])
    tagwise = F.col("t_most") > F.col("s_most")
    return both.select(
        "page_id",
        F.col("parent").alias("node"),
        F.greatest("s_most", "t_most").alias("repeating_group_count"),
        F.col("s_most").alias("sig_group_count"),
        F.col("t_most").alias("xpath_star_group_count"),
        F.col("s.value").alias("sig_value"),
        F.when(tagwise, "tag").otherwise("signature").alias("group_kind"),
        F.when(tagwise, F.col("t.value")).otherwise(F.col("s.value")).alias("group_value"),
        F.when(F.col("children") < 2, 0.0).otherwise(ratio(F.greatest("s_most", "t_most"), F.col("children"))).alias("sibling_homogeneity_score"),
    )


#: Further than any input can be.
_FAR = 1 << 40


def input_distances(nodes: DataFrame, chosen: DataFrame, editable: Column | None = None) -> DataFrame:
    """(page_id, node, textarea and contenteditable distances, flags): steps through the tree to the nearest input.

    Null where a page has none; flags are false then.  ``editable`` tells which nodes are, if not
    their attributes do.  The nearest input below each node goes up the levels of depth, and the
    best way over an ancestor comes down again.
    """
    kinds = {"textarea": F.col("tag") == "textarea", "contenteditable": F.col("attrs").getItem("contenteditable").isNotNull() if editable is None else editable}
    names = list(kinds)

    def step(pages: Pages) -> pa.RecordBatch:
        depth = pages.column("depth").astype(np.int64)
        rows = np.flatnonzero(pages.rows.column("_chosen").fill_null(False).to_numpy(zero_copy_only=False))
        found = []
        for kind in names:
            held = np.where(pages.rows.column(f"is_{kind}").to_numpy(zero_copy_only=False), depth, _FAR)
            over = pages.down(pages.up(held, np.minimum) - 2 * depth, np.minimum)
            steps = (over + depth)[rows]
            found.append(pa.array(steps, pa.int64(), mask=steps > _FAR >> 1))
        return pa.RecordBatch.from_arrays([pa.array(pages.page[rows]), pa.array(pages.node[rows].astype(np.int32)), *found], ["page_id", "node", *(f"{k}_tree_proximity" for k in names)])

    marks = nodes.select("page_id", "node", "parent", "last", "depth", *(F.coalesce(v, F.lit(False)).alias(f"is_{k}") for k, v in kinds.items()))
    marks = marks.join(chosen.select("page_id", "node").distinct().withColumn("_chosen", F.lit(True)), ["page_id", "node"], "left")
    text, edit = F.col("textarea_tree_proximity"), F.col("contenteditable_tree_proximity")
    return by_page(marks, step, "page_id long, node int, textarea_tree_proximity long, contenteditable_tree_proximity long").withColumns({
        "nearest_input_distance": F.least(text, edit),
        **{name: F.coalesce(col < most, F.lit(False)) for name, col, most in (("has_nearby_textarea", text, 30), ("textarea_close", text, 20), ("aligned_with_textarea", text, 15), ("textarea_very_close", text, 10), ("aligned_with_content_editable", edit, 15))},
    })
