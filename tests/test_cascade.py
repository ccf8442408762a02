"""Levels of a stream against plain counts, with late rows and replayed batches."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.sources.shared import fresh_dir
from tidemark.streaming import cascade

CUT = {P.HOURLY: 10, P.DAILY: 8, P.MONTHLY: 6, P.YEARLY: 4}
SCHEMA = "domain string, hits long, heavy long, timeperiod string"
def job_at(base):
    return cascade.Cascade(base, ("domain",), {"hits": F.count(F.lit(1)), "heavy": F.sum("weight")}, "ts", 5)


def make_batches(seed=3):
    """Four batches that move on through a new year; the later ones bring late rows too, the last nothing but those."""
    rng = random.Random(seed)
    start, out = datetime(2011, 12, 30, 22), []
    for b in range(4):
        at = [start + timedelta(minutes=rng.randrange(60 * 30) + b * 60 * 30) for _ in range(60 if b < 3 else 0)]
        at += [start + timedelta(minutes=rng.randrange(60 * 20)) for _ in range(5 * b)]
        out.append([(f"d{rng.randrange(3)}", t, rng.randrange(9)) for t in at])
    return out


def counts(rows, level):
    hits, heavy = Counter(), Counter()
    for domain, at, weight in rows:
        key = domain, at.strftime("%Y%m%d%H")[: CUT[level]].ljust(10, "0")
        hits[key] += 1
        heavy[key] += weight
    return {(d, hits[d, tp], heavy[d, tp], tp) for d, tp in hits}


def end_of(level, tp):
    at = P.moment(tp)
    return {P.HOURLY: lambda: at + timedelta(hours=1), P.DAILY: lambda: at + timedelta(days=1),
            P.MONTHLY: lambda: datetime(at.year + at.month // 12, at.month % 12 + 1, 1), P.YEARLY: lambda: datetime(at.year + 1, 1, 1)}[level]()


def as_table(spark, rows):
    return spark.createDataFrame(rows, "domain string, ts timestamp_ntz, weight long")


def level(spark, base, q):
    return {tuple(r) for r in cascade.read_level(spark, base, q, SCHEMA).collect()}


def files(spark, base):
    return {r[0]: r[1] for q in cascade.LEVELS for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{base}/{q}").select("path", "modificationTime").collect()}


@pytest.fixture(scope="module")
def steps(spark):
    """The tables after each batch; some run again, as after a failure."""
    base, out, given = fresh_dir(spark, "cascade"), [], []
    job = job_at(base)
    for b, rows in enumerate(make_batches()):
        given += rows
        job.write(as_table(spark, rows), b)
        once = {q: level(spark, base, q) for q in cascade.LEVELS}
        emitted = sorted(map(tuple, cascade.read_emitted(spark, base).collect()))
        if b % 2:
            job.write(as_table(spark, rows), b)
            assert {q: level(spark, base, q) for q in cascade.LEVELS} == once
            assert sorted(map(tuple, cascade.read_emitted(spark, base).collect())) == emitted
        out.append((list(given), once, files(spark, base)))
    return base, out


def test_every_level_equals_a_count_after_each_batch(steps):
    for given, levels, _ in steps[1]:
        for q in cascade.LEVELS:
            assert levels[q] == counts(given, q)


def test_untouched_folders_keep_their_files(steps):
    _, out = steps
    for (_, _, before), (_, _, after) in zip(out, out[1:]):
        assert before.items() <= after.items()
    touched = {(q, tp) for q in cascade.LEVELS for *_, tp in counts(make_batches()[3], cascade.FOLDERS[q])}
    fresh = {p for p in out[3][2] if "batch=3/" in p}
    assert {(q, p.split("folder=")[1].split("/")[0]) for p in fresh for q in cascade.LEVELS if f"/{q}/" in p} == touched


def test_buckets_close_once(spark, steps):
    base, _ = steps
    seen, closed, want, late = [], {}, set(), set()
    for b, rows in enumerate(make_batches()):
        seen += rows
        newest = max(t for _, t, _ in seen)
        for q in cascade.LEVELS:
            now = counts(seen, q)
            for tp in {c[3] for c in now}:
                if (q, tp) in closed and any(c[3] == tp for c in counts(rows, q)):
                    late.add((q, tp, b))
                if (q, tp) not in closed and end_of(q, tp) + timedelta(minutes=5) <= newest:
                    closed[q, tp] = b
                    want |= {(*c, q, b) for c in now if c[3] == tp}
    got = [tuple(r[c] for c in ("domain", "hits", "heavy", "timeperiod", "time_qualifier", "batch")) for r in cascade.read_emitted(spark, base).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {q for q, _ in closed} == set(cascade.LEVELS)
    assert {(r.time_qualifier, r.timeperiod, r.batch) for r in cascade.read_corrected(spark, base).collect()} == late and late


def test_a_batch_that_stopped_half_way(spark):
    """Level folders without a ledger are written again; the sums don't count them twice."""
    base = fresh_dir(spark, "cascade-half")
    first, second = make_batches()[:2]
    job = job_at(base)
    job.write(as_table(spark, first), 0)
    broken = job_at(base)
    broken._close = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.write(as_table(spark, second), 1)
    assert level(spark, base, P.DAILY) == counts(first, P.DAILY)  # readers still see the batch before
    job.write(as_table(spark, second), 1)
    assert all(level(spark, base, q) == counts(first + second, q) for q in cascade.LEVELS)


def test_reading_stays_with_what_a_batch_touches(spark, steps):
    """A late row reads the hours of its day, the days of its month and the months of its year."""
    base, _ = steps
    ledger = cascade._ledger(spark, base)
    held = cascade._folders(ledger)[P.HOURLY]
    hours = cascade._some(held, ["2011123100", "2020010100"])
    assert [f for f, _ in hours] == ["2011123100"] and len(held) > 4
    schema = spark.createDataFrame([], SCHEMA).schema
    assert all("folder=2011123100" in f for f in cascade._held(spark, base, P.HOURLY, hours, schema).inputFiles())


def test_vacuum_and_empty_batches(spark):
    base = fresh_dir(spark, "cascade-vacuum")
    job = job_at(base)
    given = []
    for b, rows in enumerate([[], *make_batches()[2:], []]):
        given += rows
        job.write(as_table(spark, rows), b)
    before = len(files(spark, base))
    assert cascade.vacuum(spark, base) > 0 and len(files(spark, base)) < before
    assert all(level(spark, base, q) == counts(given, q) for q in cascade.LEVELS)
    job.write(as_table(spark, []), 3)  # the last batch again
    assert all(level(spark, base, q) == counts(given, q) for q in cascade.LEVELS)
