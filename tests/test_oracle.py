"""Every registered query with SQL against DuckDB on the same files."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set threads = 4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
    a, b = Counter(got), Counter(want)
    assert len(got) == len(want), (len(got), len(want))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    assert want, "an empty comparison shows nothing"


def test_queries_without_sql_run(spark):
    for name in sorted(set(entry.queries()) - set(SQL) - {"pipeline"}):
        if not name.startswith("op"):
            assert entry.queries()[name](spark, SF).limit(5).collect() is not None, name


def test_entry(spark):
    assert entry.entry(spark).count() == 10
