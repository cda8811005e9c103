"""Trees of live pages as keyed state: mutations in, regions and verdicts out.

A mutation (page, seq, kind, target, node, tag, name, value) inserts a node under a target, removes
it, or sets an attribute.  Where a node is, and each of its attributes, is what the mutation of the
highest seq says; how active a target is, is the number of insertions.  So the state does not
depend on the order in which mutations arrive: after any part of a log it is what ``rebuilt`` makes
of that part.  Every node keeps how many children it has of each tag, and of each signature (a tag
and the tags of its children), so that its largest group of like children is known without a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agora.operators.monitor import live_score

MUTATION = "page long, seq long, kind string, target long, node long, tag string, name string, value string"
#: Least number of like children of a region, and the scores from which a region counts and is guarded.
LEAST_GROUP, LOW, HIGH = 3, 0.35, 0.65
#: What a region's score is multiplied with below another that counts.
NESTED = 0.6
_STATE = "nodes array<struct<node:long,tag:string,parent:long,placed:long,attrs:map<string,struct<seq:long,value:string>>,child_tags:map<string,int>,shapes:map<string,int>,activity:int>>"
#: Nodes whose numbers are this near are kept as one entry of the state, so that it is read and written in few calls.
BLOCK = 2048
_REGION = "page long, node long, change string, size int, children int, activity int, raw double, score double, looped boolean"
_VERDICT = "page long, seq long, node long, score double, action string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Node:
    """A node's state in memory while a batch of its page goes on."""

    def __init__(self, held: tuple | None):
        tag, parent, placed, attrs, child_tags, shapes, activity = held or (None, None, None, {}, {}, {}, 0)
        self.tag, self.parent, self.placed, self.activity = tag, parent, placed, activity
        self.attrs = {k: tuple(v) for k, v in (attrs or {}).items()}
        self.child_tags, self.shapes = dict(child_tags or {}), dict(shapes or {})

    def row(self) -> tuple:
        return self.tag, self.parent, self.placed, self.attrs, self.child_tags, self.shapes, self.activity

    @property
    def signature(self) -> str:
        return f"{self.tag}[{','.join(t for t in sorted(self.child_tags) for _ in range(self.child_tags[t]))}]"

    @property
    def group(self) -> int:
        return max(self.shapes.values(), default=0)

    @property
    def children(self) -> int:
        return sum(self.child_tags.values())


def _count(counts: dict, key: str, by: int) -> None:
    counts[key] = counts.get(key, 0) + by
    if not counts[key]:
        del counts[key]


class Tree:
    """A page's nodes over a keyed store; those that a batch touches are held until ``flush``."""

    def __init__(self, get, put):
        self._get, self._put = get, put
        self.held: dict[int, _Node] = {}
        self.touched: set[int] = set()

    def at(self, node: int) -> _Node:
        if node not in self.held:
            self.held[node] = _Node(self._get(node))
        return self.held[node]

    def _reshape(self, node: int, change) -> None:
        """Changes a node's children, and with them its signature among its parent's."""
        mine = self.at(node)
        up = self.at(mine.parent) if mine.parent is not None else None
        if up:
            _count(up.shapes, mine.signature, -1)
        change(mine)
        if up:
            _count(up.shapes, mine.signature, 1)
            self.touched.add(mine.parent)
        self.touched.add(node)

    def _place(self, node: int, parent: int | None, tag: str | None) -> None:
        mine = self.at(node)
        if mine.parent is not None:
            old, signature = mine.parent, mine.signature

            def leave(up: _Node) -> None:
                _count(up.child_tags, mine.tag, -1)
                _count(up.shapes, signature, -1)

            mine.parent = None
            self._reshape(old, leave)
        if tag is not None:
            mine.tag = tag
        if parent is not None:

            def enter(up: _Node) -> None:
                _count(up.child_tags, mine.tag, 1)
                _count(up.shapes, mine.signature, 1)

            self._reshape(parent, enter)
            mine.parent = parent
        self.touched.add(node)

    def apply(self, kind: str, seq: int, target: int | None, node: int | None, tag: str | None, name: str | None, value: str | None) -> None:
        if kind == "attribute" and target is not None and name is not None:
            held = self.at(target).attrs
            if name not in held or seq > held[name][0]:
                held[name] = (seq, value)
                self.touched.add(target)
        elif kind in ("insert", "remove") and node is not None:
            if kind == "insert" and target is not None:
                self.at(target).activity += 1
                self.touched.add(target)
            mine = self.at(node)
            if mine.placed is None or seq > mine.placed:
                mine.placed = seq
                self._place(node, target if kind == "insert" else None, tag if kind == "insert" else mine.tag)

    def above(self, node: int) -> Iterator[int]:
        """The nodes above one, as far as they are known; a cycle ends where it begins."""
        seen, up = {node}, self.at(node).parent
        while up is not None and up not in seen:
            yield up
            seen.add(up)
            up = self.at(up).parent

    def looped(self, node: int) -> bool:
        """Whether a node lies below itself, as one that was put into itself or into what it holds."""
        return self.at([node, *self.above(node)][-1]).parent == node

    def raw(self, node: int) -> float | None:
        """A region's own score; None of what has too few like children."""
        mine = self.at(node)
        if mine.children < LEAST_GROUP or mine.group < LEAST_GROUP:
            return None
        up = self.at(mine.parent) if mine.parent is not None else None
        plain = lambda n: {k: v or "" for k, (_, v) in n.attrs.items()}
        return live_score(mine.group, mine.group / mine.children, mine.activity, mine.tag or "", plain(mine), up.tag or "" if up else "", plain(up) if up else {}, "tr" in mine.child_tags)

    def flush(self) -> None:
        for node in self.touched:
            self._put(node, self.at(node).row())
        self.touched.clear()


class Regions(StatefulProcessor):
    """Keeps a page's tree; emits regions that are new, changed or gone, and judges content inserted into guarded ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("nodes", "block long", _STATE)
        self.regions = handle.getMapState("regions", "node long", "size int, children int, activity int, raw double, score double, looped boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        page = key[0]
        some, blocks, changed_blocks = self.blocks.exists(), {}, set()

        def block(b: int) -> dict[int, tuple]:
            if b not in blocks:
                held = self.blocks.getValue((b,))[0] if some and self.blocks.containsKey((b,)) else ()
                blocks[b] = {r[0]: _Node(tuple(r[1:])).row() for r in held}
            return blocks[b]

        def put(n: int, row: tuple) -> None:
            block(n // BLOCK)[n] = row
            changed_blocks.add(n // BLOCK)

        tree = Tree(lambda n: block(n // BLOCK).get(n), put)
        whole = lambda v: None if pd.isna(v) else int(v)
        text = lambda v: v if isinstance(v, str) else None
        judged, changed = [], set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                tree.apply(r.kind, int(r.seq), whole(r.target), whole(r.node), text(r.tag), text(r.name), text(r.value))
                if r.verdict != "pass":
                    judged.append((int(r.seq), whole(r.target), r.verdict))
        changed |= tree.touched
        known = {k[0]: tuple(v) for k, v in self.regions.iterator()}
        # a node's attributes are read by its children's scores too
        below = {n for n in known if tree.at(n).parent in changed}
        raws = {n: v[3] for n, v in known.items()}
        for n in changed | below:
            value = tree.raw(n)
            if value is None:
                raws.pop(n, None)
            else:
                raws[n] = value
        finals = {}
        out = []
        for n in sorted(raws):
            nested = any(raws.get(up, 0.0) >= LOW for up in tree.above(n))
            mine = tree.at(n)
            finals[n] = (mine.group, mine.children, mine.activity, raws[n], raws[n] * NESTED if nested else raws[n], tree.looped(n))
            if known.get(n) != finals[n]:
                out.append((page, n, "found" if n not in known else "changed", *finals[n], None, None))
                self.regions.updateValue((n,), finals[n])
        for n in sorted(known.keys() - finals.keys()):
            out.append((page, n, "gone", *known[n], None, None))
            self.regions.removeKey((n,))
        for seq, target, verdict in sorted(judged):
            if target is not None:
                most = max((finals[n][4] for n in (target, *tree.above(target)) if n in finals), default=0.0)
                if most >= HIGH:
                    out.append((page, target, verdict, None, None, None, None, most, None, seq, verdict))
        tree.flush()
        for b in sorted(changed_blocks):
            self.blocks.updateValue((b,), ([(n, *row) for n, row in blocks[b].items()],))
        names = [c.split()[0] for c in (_REGION + ", seq long, action string").split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object)  # numbers beside nulls would become doubles
        yield frame.astype({c: "Int64" for c in ("page", "node", "seq")} | {c: "Int32" for c in ("size", "children", "activity")} | {c: "float64" for c in ("raw", "score")} | {"looped": "boolean"})

    def close(self) -> None:
        pass


def followed(mutations: DataFrame) -> DataFrame:
    """Of a stream of mutations with ``verdict`` (block, flag or pass): changes of regions, and judged insertions.

    Rows (page, node, change, size, children, activity, raw, score, looped, seq, action): change is found,
    changed or gone for regions; else it is the verdict on content (seq) put into a region, or below
    one, whose score is ``HIGH`` or more once the batch has been taken in.  A region that is ``looped``
    lies below itself, which lowers no score.  Pages and seqs are not null.
    Needs the RocksDB state store (``STATE_STORE``).
    """
    # as text, since pandas reads longs among nulls as doubles, which are not exact beyond 2^53
    given = mutations.withColumns({c: F.col(c).cast("string") for c in ("target", "node")})
    return given.groupBy("page").transformWithStateInPandas(statefulProcessor=Regions(), outputStructType=_REGION + ", seq long, action string", outputMode="Update", timeMode="None")


def latest(changes: DataFrame) -> DataFrame:
    """The regions as they stand after batches of changes (batch, page, node, change, ...)."""
    last = changes.where("action IS NULL").groupBy("page", "node").agg(F.max_by(F.struct("change", "size", "children", "activity", "raw", "score", "looped"), "batch").alias("r"))
    return last.where("r.change <> 'gone'").select("page", "node", "r.size", "r.children", "r.activity", "r.raw", "r.score", "r.looped")


def placed(mutations: DataFrame) -> DataFrame:
    """(page, node, parent, tag) of nodes that stand under another, from a log as a table."""
    moves = mutations.where("kind IN ('insert', 'remove') AND node IS NOT NULL")
    last = moves.groupBy("page", "node").agg(F.max_by(F.when(F.col("kind") == "insert", F.col("target")), "seq").alias("parent"), F.max_by("tag", F.when((F.col("kind") == "insert") & F.col("tag").isNotNull(), F.col("seq"))).alias("tag"))
    return last.where("parent IS NOT NULL")


def rebuilt(mutations: DataFrame) -> DataFrame:
    """(page, node, size, children, activity) of every node with like enough children, from a log as a table."""
    nodes = placed(mutations)
    tags = nodes.groupBy("page", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    shaped = nodes.join(tags, ["page", "node"], "left").withColumn("signature", F.concat("tag", F.lit("["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","), F.lit("]")))
    groups = shaped.groupBy("page", "parent", "signature").agg(F.count("*").alias("n")).groupBy("page", F.col("parent").alias("node")).agg(F.max("n").cast("int").alias("size"), F.sum("n").cast("int").alias("children"))
    active = mutations.where("kind = 'insert' AND node IS NOT NULL AND target IS NOT NULL").groupBy("page", F.col("target").alias("node")).agg(F.count("*").cast("int").alias("activity"))
    return groups.where(F.col("size") >= LEAST_GROUP).join(active, ["page", "node"], "left").withColumn("activity", F.coalesce("activity", F.lit(0)))


def merged_ring(state: DataFrame | None, batch: DataFrame, keys: list[str], by: list[Column], size: int) -> DataFrame:
    """A key's last ``size`` rows of those held and those new, by ``by`` (which tells any two rows apart)."""
    both = batch if state is None else state.unionByName(batch)
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc() for c in by))))
    return ranked.where(F.col("_n") <= size).drop("_n")
