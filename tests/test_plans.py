"""The physical plans stay in the shape that scales."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.functions import period as P
from tidemark.operators import rollup
from tidemark.plans import load
from tidemark.plans import views as V
from tidemark.plans.catalog import SITE_SUITE
from tidemark.sources import scans, writes
from tidemark.sources.shared import fresh_dir
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in load()[0] if not n.startswith("stream_")))
def test_no_cross_join_and_no_python_worker(spark, name):
    plan = physical(entry.queries()[name](spark, SF))
    for node in FORBIDDEN:
        assert node not in plan, node


@needs_tables
def test_scan_reads_only_what_is_used(spark):
    orders = V.table(spark, SF, "orders").where("o_orderstatus = 'F'")
    plan = physical(orders.groupBy(P.to_period(P.MONTHLY, "o_orderdate")).count())
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    assert "EqualTo(o_orderstatus,F)" in plan


def test_bucket_range_prunes_partitions(spark):
    rows = spark.createDataFrame([(i, f"200101{i:02d}00") for i in range(1, 11)], "id int, timeperiod string")
    path = fresh_dir(spark, "pruned")
    writes.write_buckets(rows, path)
    table = spark.read.schema("id int, timeperiod string").parquet(path)
    plan = physical(scans.scan_periods(table, "2001010300", "2001010500"))
    assert "PartitionFilters: [isnotnull(timeperiod" in plan and "2001010300" in plan


def test_rollup_is_one_shuffle_with_map_side_combine(spark):
    hours = spark.createDataFrame([("a", "2001010101", 1, 1, 1)], "domain string, timeperiod string, number_of_visits long, number_of_pageviews long, total_duration long")
    for df in (rollup.rollup_periods(hours, "yearly"), rollup.rollup_levels(hours, ["daily", "monthly", "yearly"])):
        plan = physical(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert "partial_sum" in plan


def test_catalog_joins_are_planned_with_known_size(spark):
    rows = spark.range(10).selectExpr("concat('process_', id) as process_name")
    plan = physical(rows.join(SITE_SUITE.process_dim(spark), "process_name"))
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan


@needs_tables
@pytest.mark.parametrize("name, column", [("scan_periods", "o_orderdate"), ("scan_keys", "o_orderdate"), ("key_bounds", "o_orderdate"), ("scan_since", "o_orderdate"), ("missed_runs", "ts")])
def test_bucket_bounds_reach_the_files(spark, name, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = physical(entry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and f"GreaterThanOrEqual({column}" in line]
    assert pushed, plan


@needs_tables
@pytest.mark.parametrize("in_order", [False, True])
def test_a_micro_batch_of_a_large_table_is_read_by_many_tasks(spark, monkeypatch, in_order):
    monkeypatch.setattr(V, "_FILE_BYTES", V.stored_bytes(spark, f"{SF}/events.parquet") // 30)
    monkeypatch.setattr(V, "_STREAM_FILES", {})
    seen = []

    def take(batch, _):
        part = "least((dayofmonth(ts) - 1) div 10, 2)" if in_order else "event_id % 3"
        seen.append((batch.selectExpr("input_file_name()").distinct().count(), batch.count(), [r[0] for r in batch.selectExpr(part).distinct().collect()]))

    live.start(V.event_stream(spark, SF, in_order=in_order), fresh_dir(spark, "dealt"), take).awaitTermination()
    assert len(seen) == 3 and all(n >= 10 for n, _, _ in seen)  # a third of the table, no file above a thirtieth
    assert sum(n for _, n, _ in seen) == V.table(spark, SF, "events").count()
    assert sorted(p for _, _, parts in seen for p in parts) == [0, 1, 2]  # no batch mixes two parts
