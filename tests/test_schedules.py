from datetime import datetime, timedelta

import pytest

from tidemark.operators import schedules as X

LO, HI = datetime(2024, 1, 1), datetime(2024, 1, 10)  # the first is a Monday
TEXTS = ["at 6:05", "at 2-11:10,*-23:59", "at 6-00:00 ,  3-07:45,0-21:30", "every 5400", "every 50", "at *-12:34,12:34"]


def brute(text):
    """All minutes in the interval, tested one by one."""
    text = " ".join(text.split())
    out = set()
    if text.startswith("every "):
        at = LO + timedelta(seconds=int(text[6:]))
        while at < HI:
            out.add(at.replace(second=0))
            at += timedelta(seconds=int(text[6:]))
        return out
    entries = [e.split("-") if "-" in e else ["*", e] for e in text[3:].replace(" ", "").split(",")]
    at = LO
    while at < HI:
        for day, clock in entries:
            hour, minute = map(int, clock.split(":"))
            if (hour, minute) == (at.hour, at.minute) and day in ("*", str(at.weekday())):
                out.add(at)
        at += timedelta(minutes=1)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, schedule string")


def test_expected_runs(table):
    out = X.expected_runs(table, "schedule", LO, HI).collect()
    for i, text in enumerate(TEXTS):
        got = [r.expected_at for r in out if r.id == i]
        assert len(got) == len(set(got)) and set(got) == brute(text), text


def test_missed_runs(spark, table):
    expected = X.expected_runs(table, "schedule", LO, HI)
    happened = sorted(brute(TEXTS[0]))[::2]
    seen = spark.createDataFrame([(0, t + timedelta(seconds=41)) for t in happened], "id int, ts timestamp_ntz")
    missed = X.missed_runs(expected, seen, ["id"], "ts", LO, HI).where("id = 0").collect()
    assert {r.expected_at for r in missed} == brute(TEXTS[0]) - set(happened)


def test_entries(table):
    rows = X.parse_schedule(table, "schedule").where("id in (1, 3)").collect()
    assert {(r.id, r.kind, r.every_seconds, r.day, r.hour, r.minute) for r in rows} == {
        (1, "at", None, "2", 11, 10), (1, "at", None, "*", 23, 59), (3, "every", 5400, None, None, None),
    }


def test_unknown_form_fails(spark):
    df = spark.createDataFrame([("sometimes",)], "schedule string")
    with pytest.raises(Exception, match="unknown schedule"):
        X.parse_schedule(df, "schedule").collect()


def test_next_trigger_against_minutes(spark):
    """The next run found by stepping through the minutes after many moments."""
    moments = [LO + timedelta(hours=7 * i, minutes=13 * i, seconds=i % 3) for i in range(40)]
    texts = [t for t in TEXTS if t.startswith("at")]
    df = spark.createDataFrame([(m, t) for m in moments for t in texts], "ts timestamp_ntz, schedule string")
    for r in X.next_trigger(df, "ts", "schedule").collect():
        entries = [e.split("-") if "-" in e else ["*", e] for e in r.schedule[3:].replace(" ", "").split(",")]
        at = r.ts.replace(second=0) + (timedelta(minutes=1) if r.ts.second else timedelta(0))
        while not any((at.hour, at.minute) == tuple(map(int, c.split(":"))) and d in ("*", str(at.weekday())) for d, c in entries):
            at += timedelta(minutes=1)
        assert r.next_trigger == at, (r.ts, r.schedule)


def test_long_intervals(spark):
    """An interval longer than a day fires on some days only."""
    df = spark.createDataFrame([(200_000, "every 200000"), (86_400, "every 86400")], "n int, schedule string")
    out = X.expected_runs(df, "schedule", LO, HI).collect()
    for n in (200_000, 86_400):
        assert {r.expected_at for r in out if r.n == n} == brute(f"every {n}")


@pytest.mark.parametrize("lo", [LO, LO + timedelta(hours=5, minutes=7, seconds=42)])
def test_runs_are_made_distinct_on_their_row(spark, lo):
    """No run meets another in a shuffle: rows are few, runs are many. Repeated rows and entries count once."""
    texts = ["every 7", "every 60", "every 61", "every 90", "at 3-10:00, *-10:00, 10:00", "at 25:30, 01:30"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(9, None)]
    df = spark.createDataFrame(rows, "id int, schedule string")
    hi = lo + timedelta(days=2, seconds=30)
    found = X.expected_runs(df, "schedule", lo, hi)
    out = found.collect()
    assert len(out) == len(set(out)) and {r.id for r in out} == set(range(6))
    for i, n in enumerate((7, 60, 61, 90)):
        want = {(lo + timedelta(seconds=k * n)).replace(second=0) for k in range(1, 2 * 86_400 // n + 9) if lo + timedelta(seconds=k * n) < hi}
        assert {r.expected_at for r in out if r.id == i} == want
    for i, (hour, minute) in ((4, (10, 0)), (5, (1, 30))):
        days = [lo.replace(hour=0, minute=0, second=0) + timedelta(days=d, hours=hour, minutes=minute) for d in range(4)]
        assert {r.expected_at for r in out if r.id == i} == {t for t in days if lo <= t < hi}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3
    assert plan.index("Generate explode") < plan.index("Aggregate [")  # the only aggregations lie under the generators
