from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import states as S
from tidemark.operators.stats import RangeJob, run_with_stats, throughput
from tidemark.sources import scans, writes
from tidemark.sources.shared import fresh_dir, shared_dir


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, f"200101{i:02d}00", f"v{i}") for i in range(1, 11)]
    return spark.createDataFrame(rows, "id long, timeperiod string, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_scans(table):
    assert ids(scans.scan_periods(table, "2001010300", "2001010600")) == [3, 4, 5]
    with pytest.raises(ValueError):
        scans.scan_periods(table, None, "2001010600")
    assert ids(scans.scan_keys(table, 2, 4)) == [2, 3, 4]
    assert ids(scans.scan_keys(table, 2, 9, "2001010300", "2001010500")) == [3, 4]
    assert ids(scans.scan_since(table, "2001010900")) == [9, 10]
    assert scans.scan_since(table, None).count() == 10


def test_key_bounds(table):
    assert tuple(scans.key_bounds(table, "2001010300", "2001010600").first()) == (3, 5)
    with pytest.raises(Exception, match="no rows in"):
        scans.key_bounds(table, "2002010100", "2003010100").collect()


def test_lookup(spark, table):
    wanted = spark.createDataFrame([(2,), (5,), (99,)], "id long")
    assert ids(scans.lookup(table, wanted, ["id"])) == [2, 5]
    assert ids(scans.lookup_misses(table, wanted, ["id"])) == [99]
    with pytest.raises(Exception, match="no row for key: 99"):
        scans.lookup(table, wanted, ["id"], strict=True).collect()
    assert ids(scans.lookup(table, wanted.where("id < 9"), ["id"], strict=True)) == [2, 5]
    with pytest.raises(ValueError):
        scans.lookup(table, wanted, ["id", "v"])


def test_upsert_is_idempotent(spark, table):
    changes = spark.createDataFrame([(3, "2001010300", "new"), (11, "2001011100", "v11")], table.schema)
    once = writes.upsert(table, changes, ["id"])
    twice = writes.upsert(once, changes, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {r.id: r.v for r in once.collect()}[3] == "new" and once.count() == 11


def test_several_changes_of_a_key(spark, table):
    schema = "id long, timeperiod string, v string, seq int"
    held = table.selectExpr("cast(id as long) as id", "timeperiod", "v", "0 as seq")
    rows = spark.createDataFrame([(3, "p", "a", 2), (3, "p", "b", 9), (3, "p", "c", 5), (20, "p", "d", 4), (20, "p", "e", 1)], schema)
    out = {r.id: r.v for r in writes.upsert(held, rows, ["id"], ["seq"]).collect()}
    assert len(out) == 11 and out[3] == "b" and out[20] == "d"
    inserted, existing = writes.insert_new(held, rows, ["id"], ["seq"])
    assert [(r.id, r.v) for r in inserted.collect()] == [(20, "e")]
    assert sorted((r.id, r.v) for r in existing.collect()) == [(3, "v3"), (20, "e")]


def test_insert_and_delete(spark, table):
    rows = spark.createDataFrame([(3, "2001010300", "clash"), (12, "2001011200", "v12")], table.schema)
    inserted, existing = writes.insert_new(table, rows, ["id"])
    assert ids(inserted) == [12]
    assert [(r.id, r.v) for r in existing.collect()] == [(3, "v3")]
    assert ids(writes.delete_keys(table, rows, ["id"])) == [1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_buckets_are_replaced_whole(spark, table):
    path = fresh_dir(spark, "buckets")
    writes.write_buckets(table, path)
    writes.write_buckets(table, path)
    assert spark.read.parquet(path).count() == 10
    change = spark.createDataFrame([(31, "2001010300", "x"), (32, "2001010300", "y")], table.schema)
    writes.write_buckets(change, path)
    assert ids(spark.read.parquet(path)) == [1, 2, 4, 5, 6, 7, 8, 9, 10, 31, 32]
    # a bucket that was computed anew and has no rows left goes
    again = spark.createDataFrame([("2001010300",), ("2001010400",), ("2001010500",)], "timeperiod string")
    writes.write_buckets(change.where("id = 31"), path, recomputed=again)
    back = writes.read_buckets(spark, path, "id long, v string, timeperiod string")
    assert ids(back) == [1, 2, 6, 7, 8, 9, 10, 31]
    assert {r.timeperiod for r in back.where("id = 31").collect()} == {"2001010300"}


def test_versions(spark, table):
    base = fresh_dir(spark, "versions")
    writes.replace_table(table, base, "1")
    writes.replace_table(table.where("id < 3"), base, "2")
    assert ids(writes.read_version(spark, base, "2")) == [1, 2]
    assert writes.read_version(spark, base, "1").count() == 10


def test_shared_dir_is_one_that_all_see(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    def session(master, folder=None):
        given = SimpleNamespace(isDefined=lambda: folder is not None, get=lambda: folder)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: given)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, *d: d[0] if d else "file:/warehouse/"), sparkContext=context)

    assert shared_dir(session("yarn", "hdfs:/given/")) == "hdfs:/given"
    assert shared_dir(session("local[4]")) == "file:/warehouse/_shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"))


def test_retention_and_duplicates(spark, table):
    dated = table.withColumn("created_at", F.to_timestamp_ntz("timeperiod", F.lit("yyyyMMddHH")))
    assert ids(scans.expire(dated, "created_at", 3, datetime(2001, 1, 10))) == [7, 8, 9, 10]
    doubled = table.unionByName(table.where("id = 4"))
    assert [tuple(r) for r in scans.duplicate_keys(doubled, ["id"]).collect()] == [(4, 2)]


def test_logs(spark):
    log = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "parent_object_id int, seq int, message string")
    new = spark.createDataFrame([(1, 1, "c"), (3, 0, "d")], log.schema)
    assert writes.append_log(log, new).count() == 4
    left = writes.attach_log(log, new.where("parent_object_id = 1"))
    assert [tuple(r) for r in left.collect()] == [(2, 0, "b")]


def test_run_statistics(spark, table):
    sink = fresh_dir(spark, "out")
    job = RangeJob(lambda rows, *_: rows.groupBy("v").count(), lambda df: df.write.parquet(sink))
    done = job.run(table, "2001010300", "2001010600")
    assert (done.rows_read, done.groups_written, done.state) == (3, 3, S.PROCESSED)
    assert spark.read.parquet(sink).count() == 3
    failed = job.run(table, "2001010300", "2001010600")  # the sink exists by now
    assert failed.state == S.INVALID and failed.error
    nothing = RangeJob(lambda *_: None, lambda df: None).run(table, "2001010100", "2001010200")
    assert (nothing.groups_written, nothing.state) == (0, S.PROCESSED)
    everything = run_with_stats(table, lambda df: df.where("id > 4"), lambda df: df.write.format("noop").mode("overwrite").save())
    assert (everything.rows_read, everything.groups_written) == (10, 6)


def test_throughput(spark):
    events = spark.sql("select timestamp_seconds(id * 20) as ts, id % 4 <> 0 as ok from range(12)")
    out = [(r.success, r.failure) for r in throughput(events).orderBy("tick").collect()]
    assert out == [(2, 1), (2, 1), (2, 1), (3, 0)]
    assert [(r.success, r.failure) for r in throughput(events, "24 hours").collect()] == [(9, 3)]


def test_range_job_reads_its_range_only(spark):
    """Bounds on the time that a bucket is derived from reach the files."""
    path, sink = fresh_dir(spark, "by-time"), fresh_dir(spark, "out")
    rows = spark.sql("select id, timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast(id div 10 as int)) as at from range(1000)")
    rows.repartitionByRange(10, "at").sortWithinPartitions("at").write.parquet(path)
    table = spark.read.parquet(path).withColumn("timeperiod", F.date_format("at", "yyyyMMdd'00'"))
    plans = []
    job = RangeJob(lambda rows, *_: plans.append(rows) or rows, lambda df: df.write.parquet(sink), ts="at")
    assert job.run(table, "2001011100", "2001012100").rows_read == 100
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,2001-01-11" in plan and "LessThan(at,2001-01-21" in plan


def test_bucket_writes_compute_their_rows_once(spark):
    path, calls = fresh_dir(spark, "once"), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, f"2001010{i % 4 + 1}00") for i in range(40)], "id int, timeperiod string")
    writes.write_buckets(rows, path)
    count = F.udf(lambda x: calls.add(1) or x, "int")
    again = rows.where("timeperiod < '2001010300'").withColumn("id", count("id")).where("timeperiod <> '2001010100'")
    listed = spark.createDataFrame([("2001010100",), ("2001010200",)], "timeperiod string")
    writes.write_buckets(again, path, recomputed=listed)
    assert calls.value == 10
    left = spark.read.schema("id int, timeperiod string").parquet(path)
    assert {r[0] for r in left.select("timeperiod").distinct().collect()} == {"2001010200", "2001010300", "2001010400"}
