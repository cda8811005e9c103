"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors are fixed-point integers, so that sums are exact in any order.  A task decomposes the
centred rows of each batch and keeps all singular values, right singular vectors and the sums; two
such summaries merge by stacking their scaled vectors over one row for the gap between their means
and decomposing the stack again, which loses nothing.  Summaries of tasks merge in groups, level by
level, in Spark, until one is left.  No covariance is formed on the way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Summaries that merge in one group of a level.
FAN = 16
#: Directions whose singular value is at most so much of the greatest one, times rows or columns, have no spread.
FLAT = np.finfo(np.float64).eps
_SUMMARY = "part int, dim int, n long, sums array<decimal(38,0)>, spread array<double>, directions binary"
_MOMENTS = "part int, dim int, n long, mean array<double>, moments binary"


@dataclass(frozen=True)
class Summary:
    """Of some rows: how many, their sums, and the decomposition of what is left after centring."""

    n: int
    sums: np.ndarray
    spread: np.ndarray
    directions: np.ndarray


def fixed_point(vector: Column, scale: int, offset: int = 0) -> Column:
    """``floor(scale * c) + offset`` of each entry, as long; null for null vectors and those with null or non-finite entries.

    Scaled entries beyond 2^62 or -2^62 count as these.
    """
    end = F.lit(2.0**62)
    entries = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < math.inf))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(entries, lambda c: (F.floor(F.least(F.greatest(c * float(scale), -end), end)) + offset).cast("long")))


def _exact_sums(x: np.ndarray) -> np.ndarray:
    narrow = len(x) == 0 or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
    return (x.sum(axis=0) if narrow else x.astype(object).sum(axis=0)).astype(object)


def _scaled_gap(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exactly: as longs where they and the sum of their squares fit, else as Python's integers."""
    base = np.array([int(s) // n for s in sums], object)
    rest = np.array([int(s) - int(b) * n for s, b in zip(sums, base)], object)
    if all(abs(int(b)) < 1 << 62 for b in base):
        far = np.abs(x.astype(np.float64) - base.astype(np.float64)).max() if x.size else 0.0
        if ((far + 2) * n) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return n * (x - base.astype(np.int64)) - rest.astype(np.int64)
    return n * x.astype(object) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_scaled_gap(x, n, sums) / n).astype(np.float64)


def summary(x: np.ndarray) -> Summary:
    """Of the rows of a matrix of longs."""
    n, sums = len(x), _exact_sums(x)
    triangle = np.linalg.qr(_centred(x, n, sums), mode="r")
    _, spread, directions = np.linalg.svd(triangle, full_matrices=False)
    return Summary(n, sums, spread, directions)


def merged(one: Summary, other: Summary) -> Summary:
    n = one.n + other.n
    gap = ((other.sums * one.n - one.sums * other.n) / (one.n * other.n)).astype(np.float64)
    correction = math.sqrt(one.n / n * other.n) * gap
    stack = np.vstack([one.spread[:, None] * one.directions, other.spread[:, None] * other.directions, correction[None]])
    _, spread, directions = np.linalg.svd(stack, full_matrices=False)
    return Summary(n, one.sums + other.sums, spread, directions)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length among a batch's column x."""
    column = batch.column("x")
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for length in np.unique(lengths).tolist():
        if length:
            places = np.flatnonzero(lengths == length)
            yield places, flat[starts[places][:, None] + np.arange(length)]


def _summary_row(part: int, s: Summary) -> dict:
    return {"part": part, "dim": len(s.sums), "n": s.n, "sums": [Decimal(int(v)) for v in s.sums], "spread": s.spread.tolist(), "directions": s.directions.tobytes()}


def _summary_of(row) -> Summary:
    dim = len(row.sums)
    return Summary(int(row.n), np.array([int(v) for v in row.sums], object), np.array(row.spread, np.float64), np.frombuffer(row.directions, np.float64).reshape(-1, dim))


def _levels(parts: DataFrame, schema: str, merge: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row for each dim: rows (part, dim, ...) merged in groups of ``FAN`` parts, level by level."""
    width = parts.rdd.getNumPartitions()

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([merge(rows.sort_values("part")) | {"part": int(rows["part"].iloc[0]) // FAN, "dim": int(rows["dim"].iloc[0])}])

    while width > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("group"), "dim").applyInPandas(level, schema)
        width = -(-width // FAN)
    return parts


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: the count and sums of the vectors, eigenvalues of their covariance, unit eigenvectors as rows."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n x - sums)^2`` of each row, exactly; None where it exceeds a long."""
        gap = _scaled_gap(x, self.n, self.sums)
        return [v if v < 1 << 63 else None for v in map(int, (gap * gap).sum(axis=1))]

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows projected on the first components and scaled to unit variance; 0 where a component has none."""
        held = self.eigenvalues[:most]
        scale = np.divide(1.0, np.sqrt(held), out=np.zeros_like(held), where=held > 0)
        return _centred(x, self.n, self.sums) @ self.components[:most].T * scale

    def explained(self, most: int) -> list[float]:
        total = float(self.eigenvalues.sum())
        return [float(e) / total if total else 0.0 for e in self.eigenvalues[:most]]


def fit(vectors: DataFrame) -> Whitening | None:
    """From the rows of ``vectors`` (x: array<long>) that are not null; None without any.

    All vectors of the commonest length count (of equally common ones, the greatest; empty vectors
    never do).  What reaches the driver is one decomposition for each length, dim x dim numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                now = summary(x)
                held[x.shape[1]] = merged(held[x.shape[1]], now) if x.shape[1] in held else now
        part = TaskContext.get().partitionId()
        if held:
            yield pa.RecordBatch.from_pylist([_summary_row(part, s) for s in held.values()], pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("spread", pa.list_(pa.float64())), ("directions", pa.binary())]))

    def merge(rows: pd.DataFrame) -> dict:
        first, *others = map(_summary_of, rows.itertuples())
        for other in others:
            first = merged(first, other)
        return _summary_row(0, first)

    parts = vectors.select("x").where("x IS NOT NULL").mapInArrow(run, _SUMMARY)
    found = _levels(parts, _SUMMARY, merge).orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return None
    whole = _summary_of(found)
    dim = len(whole.sums)
    directions = whole.directions
    if len(directions) < dim:  # fewer rows than dimensions: any orthonormal directions complete them, without spread
        directions = np.vstack([directions, np.linalg.svd(directions)[2][len(directions) :]])
    spread = np.concatenate([whole.spread, np.zeros(dim - len(whole.spread))])
    spread[spread <= (spread[0] if dim else 0.0) * FLAT * max(whole.n, dim)] = 0.0
    largest = np.abs(directions).argmax(axis=1)
    directions = directions * np.where(directions[np.arange(dim), largest] < 0, -1.0, 1.0)[:, None]
    return Whitening(whole.n, whole.sums, spread**2 / whole.n, directions)


def transform(vectors: DataFrame, model: Whitening, most: int) -> DataFrame:
    """(vec_id, deviation, whitened: array<double>) of the rows of ``vectors`` (vec_id, x) of the model's length."""
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _matrices(batch):
                if x.shape[1] == dim:
                    white = model.whitened(x, most)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), pa.array(model.deviations(x), pa.int64()), rows], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").where(F.size("x") == dim).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, spread: np.ndarray) -> float:
    """The largest absolute entry of the covariance of ``whitened`` (array<double>) less the identity, measured on all rows.

    Components without ``spread`` have no unit variance to be held to and are left out.
    """
    held = np.flatnonzero(spread > 0)

    def row(part: int, n: int, mean: np.ndarray, moments: np.ndarray) -> dict:
        return {"part": part, "dim": len(mean), "n": n, "mean": mean.tolist(), "moments": moments.tobytes()}

    def joined(one: tuple, other: tuple) -> tuple:
        (n, mean, moments), (m, mean2, moments2) = one, other
        gap = mean2 - mean
        return n + m, mean + gap * (m / (n + m)), moments + moments2 + np.outer(gap, gap) * (n / (n + m) * m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, -1)[:, held]
                mean = rows.mean(axis=0)
                now = len(rows), mean, (rows - mean).T @ (rows - mean)
                total = joined(total, now) if total else now
        if total:
            yield pa.RecordBatch.from_pylist([row(TaskContext.get().partitionId(), *total)], pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("moments", pa.binary())]))

    def of(r) -> tuple:
        return int(r.n), np.array(r.mean, np.float64), np.frombuffer(r.moments, np.float64).reshape(len(r.mean), -1)

    def merge(rows: pd.DataFrame) -> dict:
        first, *others = map(of, rows.itertuples())
        for other in others:
            first = joined(first, other)
        return row(0, *first)

    found = _levels(whitened.select("whitened").mapInArrow(run, _MOMENTS), _MOMENTS, merge).first() if len(held) else None
    if found is None:
        return 0.0
    n, _, moments = of(found)
    return float(np.abs(moments / n - np.eye(len(moments))).max())


ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    ``vectors`` (vec_id, x: array<long>, as ``fixed_point`` makes them); components are numbered
    from 1 by falling variance, up to ``most`` or the number of dimensions.  Rows with a null x are
    dropped, as are empty vectors and those of another length than the commonest.  Rows with a null
    or repeated vec_id each count and give rows.  A component without variance has whitened 0.  One
    row alone, or equal rows, have no variance: whitened, explained and identity_error are 0.  Equal
    variances leave their components' order open, but it is one for all rows.  Where ``deviation``
    exceeds a long it is null.  Vectors of any length are read whole; an empty table gives no rows;
    other columns are not read.
    """
    model = fit(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {ROWS}")
    made = transform(vectors, model, most)
    error = identity_error(made, model.eigenvalues[:most])
    explained = F.array(*[F.lit(e) for e in model.explained(most)])
    rows = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
