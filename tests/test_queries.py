"""Every registered conversation query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import turnweave.file_queries  # noqa: F401  registers its queries too
from turnweave.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v)


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


def by_rounded(row):
    return repr(tuple(f"{v:.8g}" if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=by_rounded)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=by_rounded)
    assert len(got) == len(want)
    assert all(map(near, got, want))
