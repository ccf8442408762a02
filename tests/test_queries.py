"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import load

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = load()  # those of the training-data operators have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return tuple(v) if isinstance(v, list) else v


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    given = [c[0] for c in result.description]
    assert columns == sorted(given)
    order = [given.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    actual = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(actual, key=key) == sorted(expected, key=key)


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "domain", "timeperiod", "number_of_visits", "number_of_pageviews", "total_duration",
    ]
