"""CSS selectors over the node table.

A selector becomes one condition a compound and one step a combinator.  Ancestors are told without
a join: spans of a tree are nested or apart, so a node lies below a chosen one exactly if the
furthest end of the chosen ones before it reaches it, a running maximum over the page in document
order.  Siblings are windows over a parent's children, and parents one equality join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<comma>\s*,\s*)|(?P<combine>\s*[>+~]\s*|\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]
    |:not\((?P<not>[^()]*)\)|:(?P<pseudo>[a-z-]+)(?:\(\s*(?P<arg>[^)]*?)\s*\))?""",
    re.VERBOSE,
)
_NTH = re.compile(r"^(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?$")


def positions(nodes: DataFrame) -> DataFrame:
    """Nodes with place (among siblings, from 1), siblings, tag_index (among those of the tag) and tag_count."""
    among, alike = Window.partitionBy("page_id", "parent"), Window.partitionBy("page_id", "parent", "tag")
    return nodes.withColumns({
        "place": F.row_number().over(among.orderBy("node")),
        "siblings": F.count("*").over(among),
        "tag_index": F.row_number().over(alike.orderBy("node")),
        "tag_count": F.count("*").over(alike),
    })


def _nth(place: Column, arg: str) -> Column:
    """Whether ``place`` is a * n + b for some n from 0 on."""
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    found = _NTH.match(arg)
    if not found or arg == "":
        raise ValueError(f"cannot read position {arg!r}")
    step = found["a"]
    a = 0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)
    b = int((found["b"] or "0").replace(" ", ""))
    if a == 0:
        return place == b
    return ((place - b) % a == 0) & ((place - b) / a >= 0)


def _attribute(name: str, op: str | None, value: str, small: bool) -> Column:
    held = F.col("attrs")[name]
    if op is None:
        return held.isNotNull()
    text, value = (F.lower(held), value.lower()) if small else (held, value)
    tests = {
        "=": text == value,
        "^=": text.startswith(value),
        "$=": text.endswith(value),
        "*=": F.contains(text, F.lit(value)),
        "~=": F.array_contains(F.split(text, r"\s+"), value),
        "|=": (text == value) | text.startswith(value + "-"),
    }
    empty = op in ("^=", "$=", "*=", "~=") and not value or (op == "~=" and re.search(r"\s", value))
    return F.lit(False) if empty else F.coalesce(tests[op], F.lit(False))


def _pseudo(name: str, arg: str | None) -> Column:
    place, siblings, index, count = (F.col(c) for c in ("place", "siblings", "tag_index", "tag_count"))
    known = {
        "first-child": place == 1,
        "last-child": place == siblings,
        "only-child": siblings == 1,
        "first-of-type": index == 1,
        "last-of-type": index == count,
        "only-of-type": count == 1,
        "root": F.col("parent") < 0,
        "empty": (F.col("last") == F.col("node")) & (F.col("text") == ""),
    }
    counted = {"nth-child": place, "nth-last-child": siblings - place + 1, "nth-of-type": index, "nth-last-of-type": count - index + 1}
    if name in known and arg is None:
        return known[name]
    if name in counted and arg is not None:
        return _nth(counted[name], arg.lower())
    raise ValueError(f"unknown pseudo-class :{name}")


def parse(selector: str) -> list[list[tuple[str, Column]]]:
    """A list of alternatives; each has (combinator with what stands before it, condition) from left to right."""
    alternatives, steps, tests, combine, at, text = [], [], [], " ", 0, selector.strip()

    def close() -> None:
        if not tests:
            raise ValueError(f"cannot read selector {selector!r}")
        steps.append((combine, reduce(Column.__and__, tests)))
        tests.clear()

    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"cannot read selector {selector!r} at {at}")
        at, m = found.end(), found.groupdict()
        if m["comma"] is not None:
            close()
            alternatives.append(steps)
            steps, combine = [], " "
        elif m["combine"] is not None:
            close()
            combine = m["combine"].strip() or " "
        elif m["tag"]:
            if tests:
                raise ValueError(f"cannot read selector {selector!r} at {found.start()}")
            tests.append(F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower())
        elif m["id"]:
            tests.append(_attribute("id", "=", m["id"], False))
        elif m["class"]:
            tests.append(_attribute("class", "~=", m["class"], False))
        elif m["attr"]:
            value = next((m[k] for k in ("q", "a", "bare") if m[k] is not None), "")
            tests.append(_attribute(m["attr"].lower(), m["op"], value, bool(m["flag"])))
        elif m["not"] is not None:
            inner = parse(m["not"])
            if any(len(x) > 1 for x in inner):
                raise ValueError(":not takes compounds")
            tests.append(~reduce(Column.__or__, (x[0][1] for x in inner)))
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
    close()
    return [*alternatives, steps]


def flagged(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """``nodes`` with positions and one boolean column for each selector, named by its key."""
    order = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    family = Window.partitionBy("page_id", "parent").orderBy("node")
    out = positions(nodes)
    for name, selector in selectors.items():
        kept = []
        for k, steps in enumerate(parse(selector)):
            on = f"_{name}_{k}"
            out = out.withColumn(on, F.coalesce(steps[0][1], F.lit(False)))
            for combine, test in steps[1:]:
                if combine == " ":
                    reached = F.max(F.when(F.col(on), F.col("last"))).over(order) >= F.col("node")
                elif combine == "+":
                    reached = F.lag(on).over(family)
                elif combine == "~":
                    reached = F.max(on).over(family.rowsBetween(Window.unboundedPreceding, -1))
                else:
                    chosen = out.where(on).select(F.col("page_id").alias("_page"), F.col("node").alias("_up"), F.lit(True).alias("_reached"))
                    out = out.join(chosen, (F.col("page_id") == F.col("_page")) & (F.col("parent") == F.col("_up")), "left").drop("_page", "_up")
                    reached = F.col("_reached")
                if combine in "+~":  # a node without parent has no siblings
                    reached = reached & (F.col("parent") >= 0)
                out = out.withColumn(on, F.coalesce(reached & test, F.lit(False))).drop("_reached")
            kept.append(on)
        out = out.withColumn(name, reduce(Column.__or__, map(F.col, kept))).drop(*kept)
    return out


def select(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(selector, page_id, node) of every node that each of ``selectors`` (name: CSS) finds.

    Known are tags, ``*``, ids, classes, attributes with all their operators, ``:not`` of compounds,
    positions among siblings, and the four combinators.  ``nodes`` are read once for each child
    combinator more; keep them in a table.  Attribute names are those of the parser, in lower case.
    """
    out = flagged(nodes.select("page_id", "node", "parent", "last", "tag", "attrs", "text"), {f"s{k}": css for k, css in enumerate(selectors.values())})
    names = F.array(*(F.when(F.col(f"s{k}"), F.lit(name)) for k, name in enumerate(selectors)))
    return out.select(F.explode(F.array_compact(names)).alias("selector"), "page_id", "node")
