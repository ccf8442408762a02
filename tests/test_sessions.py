"""Sessions in batch and as a stream against a plain fold over the hits in time order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import sessions as S
from tidemark.sources import envelope
from tidemark.sources.shared import fresh_dir
from tidemark.streaming import buckets, live
from tidemark.streaming import sessions as SS

START = datetime(2024, 1, 1, 10, 59, 30)


def make_hits(n=400, hot_share=3):
    """Deterministic hits; one session holds about a third of them, some hits share a time."""
    rows = []
    for i in range(n):
        hot = i % hot_share == 0
        rows.append(
            (
                i,
                START + timedelta(seconds=(i // 2) * 7, microseconds=(i // 2) % 3),
                "site_0" if hot else f"site_{i % 5}",
                "hot" if hot else f"s{i % 40}",
                f"10.0.0.{i % 9}",
                None if i % 4 == 0 else 100 + i % 3,
                None if i % 6 == 0 else 200 + i % 3,
                None if i % 3 == 1 else f"os_{i % 7}",
                None if i % 5 else f"browser_{i}",
                f"lang_{i % 2}",
                None if i % 2 else "c",
                i % 3 == 0,
            )
        )
    return rows


def fold(rows):
    """What a single worker reading the hits in order would hold per session."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        _, ts, domain, sid, ip, x, y, os_, browser, lang, country, view = r
        s = out.setdefault(
            (domain, sid),
            dict(timeperiod=ts.strftime("%Y%m%d%H"), ip=ip, first=ts, os=None, browser=None, language=None,
                 country=None, screen_x=None, screen_y=None, number_of_pageviews=0, entries=[]),
        )
        for name, value in (("os", os_), ("browser", browser), ("language", lang), ("country", country)):
            if value is not None:
                s[name] = value
        if x is not None and y is not None:
            s["screen_x"], s["screen_y"] = x, y
        s["number_of_pageviews"] += view
        s["entries"].append(ts.strftime("%Y%m%d%H%M%S"))
        s["total_duration"] = int(ts.timestamp() // 1) - int(s["first"].timestamp() // 1)
    return out


def same(actual, rows):
    expected = fold(rows)
    got = {(r.domain, r.session_id): r.asDict() for r in actual.collect()}
    assert got.keys() == expected.keys()
    for key, e in expected.items():
        for name in ("timeperiod", "ip", "os", "browser", "language", "country", "screen_x", "screen_y",
                     "number_of_pageviews", "total_duration"):
            assert got[key][name] == e[name], (key, name)
        assert got[key]["number_of_entries"] == len(e["entries"])


@pytest.fixture(scope="module")
def rows():
    return make_hits()


@pytest.fixture(scope="module")
def hits(spark, rows):
    return spark.createDataFrame(rows, envelope.HIT_SCHEMA)


def test_build(hits, rows):
    same(S.build_sessions(hits), rows)


def test_order_of_arrival_does_not_matter(hits, rows):
    same(S.build_sessions(hits.orderBy(F.desc("event_id")).repartition(7)), rows)


def test_partials_merge_in_any_grouping(hits, rows):
    odd = S.partial_sessions(hits.where("event_id % 3 = 1"))
    even = S.partial_sessions(hits.where("event_id % 3 <> 1"))
    same(S.finish_sessions(S.merge_sessions(S.merge_sessions(even).unionByName(odd))), rows)


def test_entries(hits, rows):
    expected = {(d, s, i, t) for (d, s), v in fold(rows).items() for i, t in enumerate(v["entries"])}
    out = S.session_entries(hits).collect()
    assert len(out) == len(rows)
    assert {(r.domain, r.session_id, r.entry_index, r.entry_timestamp) for r in out} == expected


def test_nested_shape(hits):
    row = S.nest_sessions(S.build_sessions(hits)).where("session_id = 'hot'").first()
    assert row.user_profile.ip == "10.0.0.0"
    assert row.browsing_history.number_of_entries > 100


def test_write_stats(hits, rows):
    batch, target = hits.where("event_id >= 200"), hits.where("event_id < 200")
    known = {(r[2], r[3]) for r in rows if r[0] < 200}
    later = [(r[2], r[3]) for r in rows if r[0] >= 200]
    inserts = len({k for k in later if k not in known})
    out = S.session_write_stats(batch, target).first()
    assert (out.inserts, out.updates) == (inserts, len(later) - inserts)


def write_files(spark, hits, path, parts=4):
    """Message files in time order, each with one line that is no message and one without a key."""
    bad = spark.createDataFrame([("{broken",), ('{"data":{"domain":"x"}}',)], "value string")
    for i in range(parts):
        part = hits.where(f"event_id div {400 // parts} = {i}")
        envelope.to_envelope(part).unionByName(bad).coalesce(1).write.mode("append").text(path)


def test_stream_equals_batch(spark, hits, rows):
    path, base = fresh_dir(spark, "messages"), fresh_dir(spark, "sessions")
    write_files(spark, hits, path)
    SS.stream_messages(envelope.read_messages(spark, path, max_files=1), base).awaitTermination()
    assert spark.read.parquet(f"{base}/state").select("batch").distinct().count() == 4
    same(SS.read_sessions(spark, base), rows)
    assert SS.read_dead_letters(spark, base).count() == 8
    # a batch that is replayed changes nothing
    first = spark.read.parquet(f"{base}/state/batch=0")
    first_rows = first.collect()
    spark.createDataFrame(first_rows, first.schema).write.mode("overwrite").parquet(f"{base}/state/batch=0")
    same(SS.read_sessions(spark, base), rows)
    # compaction keeps the result, once and again
    SS.compact_sessions(spark, base, 1)
    same(SS.read_sessions(spark, base, compacted=1), rows)
    SS.compact_sessions(spark, base, 3, previous=1)
    same(SS.read_sessions(spark, base, compacted=3), rows)


def test_stream_resumes_with_new_files(spark, hits, rows):
    path, base = fresh_dir(spark, "messages"), fresh_dir(spark, "sessions")
    envelope.to_envelope(hits.where("event_id < 150")).write.mode("append").text(path)
    SS.stream_sessions(envelope.read_hits(spark, path), base).awaitTermination()
    envelope.to_envelope(hits.where("event_id >= 150")).write.mode("append").text(path)
    SS.stream_sessions(envelope.read_hits(spark, path), base).awaitTermination()
    same(SS.read_sessions(spark, base), rows)


def test_live_and_final_buckets(spark, hits):
    """Batches whose rows are mostly late, and months as well as hours: nothing is lost."""
    path = fresh_dir(spark, "messages")
    for i in range(4):
        envelope.to_envelope(hits.where(f"event_id % 4 = {i}")).coalesce(1).write.mode("append").text(path)
    measures = {"hits": F.count(F.lit(1))}
    keys = ["domain", "timeperiod"]
    for q, pattern in (("hourly", "yyyyMMddHH"), ("monthly", "yyyyMM'0000'")):
        base = fresh_dir(spark, "live")
        buckets.stream_rollup(envelope.read_hits(spark, path, max_files=1), q, base, measures=measures).awaitTermination()
        batch = hits.groupBy("domain", F.date_format("ts", pattern).alias("timeperiod")).agg(measures["hits"].alias("hits"))
        expected = {tuple(r) for r in batch.collect()}
        assert spark.read.parquet(f"{base}/rows").select("batch").distinct().count() == 4
        assert {tuple(r) for r in live.read_live(spark, base, keys).collect()} == expected
        last = max(e[1] for e in expected)
        assert {tuple(r) for r in buckets.read_final(spark, q, base).collect()} == {e for e in expected if e[1] < last}
        live.compact(spark, base, keys, 1)
        live.compact(spark, base, keys, 2, previous=1)
        assert {tuple(r) for r in live.read_live(spark, base, keys, compacted=2).collect()} == expected


def test_late_hits_recompute_their_buckets_only(spark, hits):
    """Stored days plus late hits: redoing the touched days equals redoing everything."""
    from tidemark.functions import period as P
    from tidemark.sources.writes import write_buckets

    def per_hour(df):
        return df.groupBy("domain", P.to_period("hourly", "ts").alias("timeperiod")).agg(F.count(F.lit(1)).alias("n"))

    path = fresh_dir(spark, "hours")
    late = F.col("event_id").isin(150, 390)
    write_buckets(per_hour(hits.where(~late)), path)
    touched = hits.where(late).select(P.to_period("hourly", "ts").alias("timeperiod"))
    redone = buckets.recompute_buckets(hits, touched, per_hour, by=(), period=P.to_period("hourly", "ts"))
    assert 0 < redone.count() < per_hour(hits).count()
    write_buckets(redone, path)
    stored = spark.read.schema("domain string, n long, timeperiod string").parquet(path)
    assert {(r.domain, r.timeperiod, r.n) for r in stored.collect()} == {(r.domain, r.timeperiod, r.n) for r in per_hour(hits).collect()}


def test_repeated_requests_run_once(spark):
    """However long ago it was delivered, and whatever the message says: the store decides."""
    path, base = fresh_dir(spark, "requests"), fresh_dir(spark, "once")
    rows = spark.sql("select id % 10 as attempt_id, timestamp_seconds(1000 + 86400 * id) as ts, 'state_requested' as state from range(40)")
    for i in range(4):
        rows.where(f"(unix_seconds(ts) - 1000) div 864000 = {3 - i}").coalesce(1).write.mode("append").parquet(path)
    stored = spark.sql("select id as attempt_id, if(id = 3, 'state_processed', 'state_requested') as state from range(9)")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    buckets.deliver_requests(stream, lambda: stored, base).awaitTermination()
    sent = spark.read.parquet(f"{base}/rows")
    assert sorted(r.attempt_id for r in sent.collect()) == [0, 1, 2, 4, 5, 6, 7, 8]


def test_idle_sessions_close_once(spark, hits, rows):
    """Batches in time order with late hits, each of them replayed: open and closed sessions, and state that doesn't grow."""
    base, timeout = fresh_dir(spark, "closing"), 1
    ordered = [hits.where(f"event_id div 100 = {b} and event_id % 25 <> 7 or event_id div 100 = {b - 1} and event_id % 25 = 7") for b in range(5)]
    seen = None
    for b, part in enumerate(ordered):
        for _ in range(2 if b in (1, 3) else 1):
            SS._write_and_close(part, base, b, timeout)
        seen = part if seen is None else seen.unionByName(part)
        clock = seen.agg(F.max("ts")).scalar()
        last = seen.groupBy("domain", "session_id").agg((F.max("ts") + F.expr(f"make_dt_interval(0, 0, {timeout})") <= clock).alias("idle"))
        idle = {tuple(r[:2]) for r in last.collect() if r.idle}
        whole = {(r.domain, r.session_id): tuple(r) for r in S.build_sessions(seen).collect()}
        closed = {(r.domain, r.session_id): tuple(r) for r in SS.read_closed_sessions(spark, base).collect()}
        assert closed == {k: v for k, v in whole.items() if k in idle}
        open_keys = {(r.domain, r.session_id) for r in SS.read_open_sessions(spark, base).collect()}
        assert open_keys == whole.keys() - idle and len(live.batches(spark, f"{base}/open")) <= 2
    assert closed


def test_messages_of_a_replayed_batch_are_read_once(spark, hits, rows):
    """A batch whose commit was lost runs again; the sink's manifest has it already."""
    given, base = fresh_dir(spark, "given"), fresh_dir(spark, "out")
    for i in range(3):
        hits.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(given)
    stream = lambda: spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(given)
    envelope.write_messages(stream(), f"{base}/messages", f"{base}/sent").awaitTermination()
    at, fs = live.folder(spark, f"{base}/sent/commits/2")
    assert fs.delete(at, False)
    envelope.write_messages(stream(), f"{base}/messages", f"{base}/sent").awaitTermination()
    # files that no manifest lists, as a failed batch leaves them
    extra, fs = live.folder(spark, f"{base}/messages/part-left.txt")
    fs.create(extra).close()
    SS.stream_sessions(envelope.read_hits(spark, f"{base}/messages", max_files=1), f"{base}/sessions").awaitTermination()
    same(SS.read_sessions(spark, f"{base}/sessions"), rows)


def test_newest_events_fold(spark):
    """Sets of several batches, one of them replayed, before and after a compaction."""
    base, by = fresh_dir(spark, "newest"), (["key"], "ts", "tie", 4)
    events = spark.sql("select id % 3 as key, (id * 37) % 101 as ts, id as tie from range(300)")
    parts = [events.where(f"tie % 4 = {i}") for i in range(4)]
    write = lambda b: L.cap_events(parts[b], *by).write.mode("overwrite").parquet(f"{base}/rows/batch={b}")
    for b in (0, 1, 1, 2):
        write(b)
    buckets.compact_cap_events(spark, base, *by)
    write(2)  # replayed after the compaction that holds it
    write(3)
    want = {tuple(r) for r in L.cap_events(events, *by).collect()}
    assert {tuple(r) for r in buckets.read_cap_events(spark, base, *by).select("key", "ts", "tie").collect()} == want
    buckets.compact_cap_events(spark, base, *by)
    assert {tuple(r) for r in buckets.read_cap_events(spark, base, *by).select("key", "ts", "tie").collect()} == want
    assert len(live.batches(spark, f"{base}/compacted")) == 1


def test_deliveries_cost_what_a_batch_touches(spark):
    """A steady stream of new requests, each asked for again in the next batch; a late batch reads no more than an early one."""
    base = fresh_dir(spark, "steady")
    stored = lambda: spark.sql("select id as attempt_id, 'state_requested' as state from range(10000)")
    read = []
    for b in range(14):
        rows = spark.range(max(b - 1, 0) * 100, b * 100 + 100).selectExpr("id as attempt_id", "'x' as payload")
        table = buckets.KeyedTable(f"{base}/delivered", "attempt_id", 100)
        read.append(len(table._held(spark, table._touched(rows), "attempt_id long, batch long").inputFiles()))
        for _ in range(2 if b in (5, 9, 10) else 1):  # some batches are replayed
            buckets._deliver(rows, b, stored, base, "attempt_id", 100)
    sent = spark.read.parquet(f"{base}/rows")
    assert sorted((r.batch, r.attempt_id) for r in sent.collect()) == [(i // 100, i) for i in range(1400)]
    assert read[13] <= read[3] <= 1 and len(live.batches(spark, f"{base}/asked")) == 1
