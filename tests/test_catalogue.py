"""Every query with SQL against DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    found = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=str)
    got = sorted(map(tuple, df.collect()), key=str)
    assert len(got) == len(want) and all(near(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() == 400

