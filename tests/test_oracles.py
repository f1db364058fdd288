"""Every registered query against the SQL that states the same result, at the smallest scale."""

import datetime
import decimal
import math
import os

import pytest

from siltstone.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = oracle.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = {c: i for i, c in enumerate(want.columns)}
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[place[c]]) for c in columns]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1
