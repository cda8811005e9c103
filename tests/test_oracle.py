"""Every registered query with an oracle agrees with DuckDB; those without run."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from agora.plans.reference import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    made = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert [names[k] for k in order] == columns
    assert rows == sorted((tuple(shown(r[k]) for k in order) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
