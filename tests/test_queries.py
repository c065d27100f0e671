"""Every registered query against its DuckDB statement at the smallest scale."""

import datetime
import math
import re

import duckdb
import pytest

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# Those of the training-data operators have tests of their own.
QUERIES = {n: q for n, q in spark_entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = canonical(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for mine, theirs in zip(got, want):
        assert mine == theirs
    assert got


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["doc_stem", "block_no", "markdown"] and df.count() == 4
