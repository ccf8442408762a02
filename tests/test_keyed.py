"""Keyed tables against plain dictionaries, and how little a change rewrites."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.keyed import MAX_LISTED, MAX_RANGES, KeyedTable
from tidemark.sources.shared import fresh_dir

SCHEMA = "id long, v string, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, table, version=None):
    rows = table.read(spark, SCHEMA, version).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.v, r.n) for r in rows}


def files(spark, table):
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{table.base}/data")
    return {r.path: r.modificationTime for r in found.select("path", "modificationTime").collect()}


def test_changes_against_a_dictionary(spark):
    rng = random.Random(2)
    table, plain, kept = KeyedTable(fresh_dir(spark, "keyed"), "id", 50), {}, []
    for step in range(4):
        changes = [(rng.randrange(-120, 400), f"s{step}i{i}", i) for i in range(60)]
        table.upsert(frame(spark, [*changes, (None, "x", 0)]), ["n"])
        plain |= {k: (v, n) for k, v, n in changes}
        gone = rng.sample(sorted(plain), 15)
        table.delete(frame(spark, [(k, None, None) for k in [*gone, 9999]]), SCHEMA)
        plain = {k: v for k, v in plain.items() if k not in gone}
        assert held(spark, table) == plain
        kept.append((table.versions(spark)[-1], dict(plain)))
    assert all(held(spark, table, v) == want for v, want in kept)  # older versions stand until they are removed
    assert table.vacuum(spark) > 0 and held(spark, table) == plain and len(table.versions(spark)) == 1
    table.delete(frame(spark, [(k, None, None) for k in plain]), SCHEMA)
    assert held(spark, table) == {} and table.index(spark).count() == 0


def test_a_change_in_one_range_rewrites_that_range(spark):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 100)
    table.upsert(spark.range(10_000).selectExpr("id", "'a' as v", "id as n"))
    before = files(spark, table)
    table.upsert(spark.range(4210, 4220).selectExpr("id", "'b' as v", "id as n"))  # a thousandth of the keys
    after = files(spark, table)
    fresh = after.keys() - before.keys()
    assert before.items() <= after.items() and len(fresh) / len(before) <= 0.02 and all("range=42/" in f for f in fresh)
    assert spark.read.parquet(*fresh).count() == 100 and table.read(spark, SCHEMA).where("v = 'b'").count() == 10


def test_a_write_that_stopped_half_way_is_not_seen(spark):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 10)
    table.upsert(frame(spark, [(i, "a", i) for i in range(40)]))
    spark.range(5).selectExpr("id", "'half' as v", "id as n", "'0' as range").write.partitionBy("range").parquet(f"{table.base}/data/version=1")
    assert set(held(spark, table).values()) == {("a", i) for i in range(40)}
    table.upsert(frame(spark, [(35, "b", 0)]))
    assert held(spark, table) == {i: ("a", i) for i in range(40)} | {35: ("b", 0)}


@pytest.mark.parametrize("order", [["n"], None])
def test_unique_keys_are_enforced(spark, order):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 10)
    table.upsert(frame(spark, [(i, "held", 0) for i in range(0, 100, 2)]))
    new = [(1, "b", 2), (1, "a", 1), (2, "c", 3), (3, "d", 4), (3, "d", 4), (None, "e", 5), (205, "f", 6), (4, "g", 7), (4, "g", 8)]
    refused = sorted((r.id is None, r.id, r.v, r.reason) for r in table.insert(frame(spark, new), order).collect())
    lost = ("b", "a") if order is None else ("b",)
    assert [x for x in refused if x[1] != 1] == [(False, 2, "c", "held"), (False, 3, "d", "repeated"), (False, 4, "g", "held"), (False, 4, "g", "held"), (True, None, "e", "null")]
    assert len([x for x in refused if x[1] == 1]) == 1 and next(x for x in refused if x[1] == 1)[2] in lost
    got = held(spark, table)
    assert len(got) == 50 + 3 and got[2] == ("held", 0) and got[3] == ("d", 4) and got[205] == ("f", 6)
    again = table.insert(frame(spark, [(3, "z", 0)]))
    assert [r.reason for r in again.collect()] == ["held"] and held(spark, table) == got


def test_the_check_reads_its_own_ranges(spark):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 100)
    table.upsert(spark.range(5000).selectExpr("id", "'a' as v", "id as n"))
    rows = table._held(spark, table._touched(spark.range(4210, 4215)), SCHEMA)
    assert len(rows.inputFiles()) == 1 and "range=42" in rows.inputFiles()[0]


@pytest.mark.parametrize("n", [3, MAX_LISTED + 50])
def test_lookup_reads_few_files_and_rows(spark, n):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 1000)
    table.upsert(spark.range(0, 40_000, 2).selectExpr("id", "'a' as v", "id as n"))
    keys = spark.range(12_000, 12_000 + n).unionByName(spark.range(12_000, 12_002)).unionByName(spark.sql("select cast(null as long) as id"))
    found = table.lookup(keys, SCHEMA)
    assert {r.id for r in found.collect()} == {k for k in range(12_000, 12_000 + n) if k % 2 == 0}
    assert all("range=12" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("In(id, [12000" in plan) if n == 3 else ("GreaterThanOrEqual(id,12000)" in plan and "LessThanOrEqual(id,12249)" in plan)
    assert table.lookup(keys.where("false"), SCHEMA).count() == 0


def test_absent_keys_are_answered_by_the_bloom_filter(spark):
    """Keys between the bounds of a file that it doesn't hold: no row group is read."""
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 100_000)
    table.upsert(spark.range(0, 100_000, 2).selectExpr("id", "'a' as v", "id as n"))
    found = table.lookup(spark.range(50_001, 50_002), SCHEMA)
    assert found.count() == 0
    found.collect()
    node = found._jdf.queryExecution().executedPlan()
    leaves = node.collectLeaves()
    read = [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size())]
    assert sum(read) == 0


def test_a_large_first_write_widens_its_ranges(spark):
    """Narrow ranges of many keys: folders stay few, and later changes go by the width that was chosen."""
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 2)
    table.upsert(spark.range(-500, 9_500).selectExpr("id", "'a' as v", "id as n"))  # 5 000 ranges of two
    index = table.index(spark).collect()
    assert 50 < len(index) <= MAX_RANGES * 1.1 and len({r.width for r in index}) == 1 and index[0].width % 2 == 0
    before = files(spark, table)
    table.upsert(spark.range(4210, 4212).selectExpr("id", "'b' as v", "id as n"))
    assert 1 <= len(files(spark, table).keys() - before.keys()) <= 2  # the ranges of two keys only
    assert [r.reason for r in table.insert(frame(spark, [(-500, "c", 0), (20_000, "c", 0)])).collect()] == ["held"]
    table.delete(frame(spark, [(9_499, None, None)]), SCHEMA)
    want = {i: ("b" if i in (4210, 4211) else "a", i) for i in range(-500, 9_499)} | {20_000: ("c", 0)}
    assert held(spark, table) == want
    found = table.lookup(spark.range(4211, 4213), SCHEMA)
    assert {(r.id, r.v) for r in found.collect()} == {(4211, "b"), (4212, "a")} and len(found.inputFiles()) <= 2


def test_an_index_without_widths_goes_by_the_tables_own(spark):
    table = KeyedTable(fresh_dir(spark, "keyed"), "id", 10)
    frame(spark, [(3, "a", 0), (14, "a", 0)]).selectExpr("*", "cast(id div 10 as string) as range").write.partitionBy("range").parquet(f"{table.base}/data/version=0")
    spark.createDataFrame([("0", 0), ("1", 0)], "range string, version long").write.parquet(f"{table.base}/index/version=0")
    table.upsert(frame(spark, [(14, "b", 1), (25, "b", 1)]))
    assert held(spark, table) == {3: ("a", 0), 14: ("b", 1), 25: ("b", 1)}
