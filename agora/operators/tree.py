"""Whole pages of the node table at a time, in document order, for what goes up or down the tree.

Nodes come together by page once.  Within a batch of whole pages, numpy goes over levels of depth,
so that a page costs in proportion to its nodes and not to pairs of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Pages:
    """Some whole pages: ``parent`` and ``last`` are rows of this batch, -1 where there is none."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.combine_chunks().to_batches()[0]
        self.page = self.column("page_id")
        self.node = self.column("node").astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(self.page[1:] != self.page[:-1]) + 1])
        self.first = np.repeat(starts, np.diff([*starts, len(self.page)]))
        at = self.node - self.node[self.first]  # places of a page follow each other
        parent = self.column("parent").astype(np.int64)
        self.at, self.parent = at, np.where(parent >= 0, parent + self.first, -1)
        self.last = self.column("last").astype(np.int64) + self.first

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Rows by depth, from the roots down."""
        depth = self.column("depth")
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def up(self, values: np.ndarray, join: np.ufunc) -> np.ndarray:
        """Each node's value joined with those of all nodes below it."""
        out = values.copy()
        for level in self.levels[:0:-1]:
            join.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Each node's value joined with its parent's, from the roots on."""
        out = values.copy()
        for level in self.levels[1:]:
            out[level] = join(out[self.parent[level]], out[level])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it, as differences of running sums."""
        running = np.cumsum(values)
        return running[self.last] - running + values


def by_page(nodes: DataFrame, step: Callable[[Pages], pa.RecordBatch | pa.Table], schema: str | T.StructType) -> DataFrame:
    """``step`` over batches of whole pages of ``nodes`` (page_id, node, parent, last, depth, ...), which Spark deals by page."""

    def batches(table: pa.RecordBatch | pa.Table) -> list[pa.RecordBatch]:
        return table.to_batches() if isinstance(table, pa.Table) else [table]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in given:
            if not batch.num_rows:
                continue
            page = batch.column("page_id").to_numpy()
            if held and held[-1].column("page_id")[0].as_py() != page[0]:
                yield from batches(step(Pages(pa.Table.from_batches(held))))
                held = []
            starts = np.flatnonzero(page[1:] != page[:-1]) + 1
            if len(starts):  # whole pages go on; the last page of a batch may have more nodes in the next
                yield from batches(step(Pages(pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))]))))
                held = []
            held.append(batch.slice(int(starts[-1]) if len(starts) else 0))
        if held:
            yield from batches(step(Pages(pa.Table.from_batches(held))))

    return nodes.repartition("page_id").sortWithinPartitions("page_id", "node").mapInArrow(run, schema)
