"""Whitening against a plain decomposition of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import queries, whitening
from agora.llm.common import table

INF, NAN = float("inf"), float("nan")


def plain(x, most):
    """(components as columns, eigenvalues, whitened, deviation) of a matrix of integers."""
    n, sums = len(x), [sum(int(v) for v in c) for c in x.T]
    centred = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return values, centred @ vectors / np.sqrt(values), [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def check(found, ids, x, most):
    values, white, deviation = plain(x, most)
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8
    assert found[found.component == 1].set_index("vec_id").deviation.loc[ids].tolist() == deviation
    assert set(found.n) == {len(x)} and found.identity_error.max() < 1e-9 and found.identity_error.nunique() == 1
    total = plain(x, x.shape[1])[0].sum()
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, values / total, rtol=1e-9)


@pytest.mark.parametrize(("parts", "dim", "scale"), [(1, 5, 100), (7, 5, 100), (40, 12, 1 << 45), (3, 40, 1000)])
def test_matches_a_decomposition_of_all(spark, parts, dim, scale):
    draw = np.random.default_rng(dim + parts)
    x = (draw.normal(size=(300, dim)) * np.linspace(1, 3, dim) * scale).astype(np.int64) + 1_000_000
    vectors = spark.createDataFrame([(k, row.tolist(), 1, 2, 3) for k, row in enumerate(x)], "vec_id long, x array<long>, part int, n int, whitened int").repartition(parts)
    found = whitening.whiten(vectors, 32).toPandas()
    assert found.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if scale < 1 << 40:
        check(found, list(range(300)), x, min(32, dim))
    else:
        exact = plain(x, dim)[2]
        got = found[found.component == 1].set_index("vec_id").deviation.loc[list(range(300))].tolist()
        assert all(math.isnan(g) if e >= 1 << 63 else g == e for g, e in zip(got, exact)) and found.identity_error.max() < 1e-9


def test_merging_keeps_everything():
    draw = np.random.default_rng(1)
    x = draw.integers(-50, 50, (90, 6)) + 10**9
    whole, joined = whitening.summary(x), whitening.summary(x[:2])
    for at in range(2, 90, 11):
        joined = whitening.merged(joined, whitening.summary(x[at : at + 11]))
    assert joined.n == 90 and (joined.sums == whole.sums).all()
    assert np.allclose(joined.spread, whole.spread, rtol=1e-12)
    both = [(s.spread[:, None] * s.directions).T @ (s.spread[:, None] * s.directions) for s in (whole, joined)]
    assert np.allclose(both[0], both[1], atol=1e-6)


def test_fixed_point(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [-INF, 1.0]), (7, []), (8, [1e300, -1e300])]
    found = spark.createDataFrame(rows, "vec_id int, embedding array<double>").select("vec_id", whitening.fixed_point(F.col("embedding"), 64, 10).alias("x")).collect()
    got = {r.vec_id: r.x for r in found}
    assert got[1] == [42, 9] and got[7] == [] and all(got[k] is None for k in (2, 3, 4, 5, 6)) and got[8] == [(1 << 62) + 10, 10 - (1 << 62)]


def test_odd_rows(spark):
    draw = random.Random(2)
    rows = [(k % 50, [draw.randrange(100) for _ in range(3)]) for k in range(60)] + [(None, [1, 2, 3]), (70, None), (71, []), (72, [1, 2]), (73, [5])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(5), 32).toPandas()
    assert len(found) == 61 * 3 and set(found.n) == {61} and found.vec_id.isna().sum() == 3
    assert found.vec_id.isin([70, 71, 72, 73]).sum() == 0


@pytest.mark.parametrize("rows", [[(1, [4, 4])], [(k, [7, 8]) for k in range(20)]])
def test_no_variance(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>"), 32).toPandas()
    assert len(found) == 2 * len(rows) and (found[["deviation", "whitened", "explained", "identity_error"]] == 0).all().all()


def test_fewer_rows_than_dimensions(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [1, 0, 0, 0]), (2, [0, 2, 0, 0]), (3, [0, 0, 4, 0])], "vec_id long, x array<long>"), 32).toPandas()
    white = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert white.shape == (3, 4) and (white[:, 2:] == 0).all() and np.allclose(white[:, :2].T @ white[:, :2] / 3, np.eye(2)) and found.identity_error.max() < 1e-12


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, x array<long>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, x array<long>")).count() == 0


def test_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in vectors])
    check(queries.op11_whitening(spark, sf_dir).toPandas(), [r.vec_id for r in vectors], x, 32)
