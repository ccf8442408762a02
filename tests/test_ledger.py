"""Ledger operators against plain walks over small trees."""

import random
from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.operators import ledger as L
from tidemark.operators import spine
from tidemark.plans import catalog as C
from tidemark.plans.catalog import SITE_SUITE
from tidemark.streaming.buckets import late_to_dirty

NOW = datetime(2010, 2, 2, 5, 30)
COLUMNS = "site string, process_name string, timeperiod string, state string, number_of_failures long"
BY = ("site",)
CUT = {P.HOURLY: 10, P.DAILY: 8, P.MONTHLY: 6, P.YEARLY: 4}


def coarsen(q, tp):
    return tp[: CUT[q]].ljust(10, "0")


def qualifier(p):
    return SITE_SUITE.processes[p].qualifier


def make_ledger(seed, sites=3):
    """Random states for every bucket of a few days; some buckets have no record."""
    rng = random.Random(seed)
    hours = [datetime(2010, 1, 31) + timedelta(hours=h) for h in range(60)]
    states = [S.EMBRYO, S.IN_PROGRESS, S.FINAL_RUN, S.PROCESSED, S.SKIPPED, S.NOOP, None]
    rows = {}
    for site in range(sites):
        weights = rng.choice([[1, 1, 1, 9, 9, 9, 1], [1, 1, 1, 3, 3, 3, 1], [0, 0, 0, 1, 1, 1, 0], [1, 1, 0, 0, 20, 0, 0]])
        for p in SITE_SUITE.tree_of:
            for tp in sorted({coarsen(qualifier(p), h.strftime("%Y%m%d%H")) for h in hours}):
                state = rng.choices(states, weights)[0]
                rows[f"s{site}", p, tp] = (state, None if state is None else rng.choice([0, 0, 0, 4, 9]))
    return rows


@pytest.fixture(scope="module", params=[1, 2, 3])
def plain(request):
    return make_ledger(request.param)


@pytest.fixture(scope="module")
def ledger(spark, plain):
    return spark.createDataFrame([(*k, *v) for k, v in plain.items()], COLUMNS)


def children(plain, site, p, tp):
    child = SITE_SUITE.child(p)
    return {
        k: v for k, v in plain.items()
        if child and k[0] == site and k[1] == child and coarsen(qualifier(p), k[2]) == tp
    }


def skippable(plain, site, p, tp):
    state, failures = plain[site, p, tp]
    if state is None:
        return False
    if state in S.JOB_FINISHED:
        return True
    if SITE_SUITE.child(p) is None:
        return failures > 3
    return all(s is not None and (f > 3 or s == S.SKIPPED) for s, f in children(plain, site, p, tp).values())


def test_should_skip(ledger, plain):
    out = {tuple(r[:3]): r[3] for r in L.should_skip(ledger, SITE_SUITE, by=BY).select("site", "process_name", "timeperiod", "skippable").collect()}
    assert out == {k: skippable(plain, *k) for k in plain}


def walk_next(plain, site, tree):
    """Pick a bucket per level from the top, looking on among the parent's later siblings."""
    picks, chosen = {}, None
    for p in SITE_SUITE.levels(tree):
        q, parent = qualifier(p), SITE_SUITE.parent(p)
        candidates = []
        for s, name, tp in sorted(plain):
            if (s, name) != (site, p):
                continue
            if parent is not None:
                above = coarsen(qualifier(parent), tp)
                grand = SITE_SUITE.parent(parent)
                same = grand is None or coarsen(qualifier(grand), above) == coarsen(qualifier(grand), chosen)
                if above < chosen or not same:
                    continue
            state, _ = plain[s, name, tp]
            if state is None or (state in S.JOB_ACTIVE and not skippable(plain, s, name, tp)):
                candidates.append(tp)
        chosen = min(candidates) if candidates else coarsen(q, NOW.strftime("%Y%m%d%H"))
        picks[p] = chosen
    return picks


def test_next_period(ledger, plain):
    expected = {
        (site, p): tp
        for site in {k[0] for k in plain}
        for tree in SITE_SUITE.trees.values()
        for p, tp in walk_next(plain, site, tree).items()
    }
    out = {(r.site, r.process_name): r.timeperiod for r in L.next_period(ledger, SITE_SUITE, NOW, by=BY).collect()}
    assert out == expected


def test_next_period_without_scope(ledger, plain):
    one = {k[1:]: v for k, v in plain.items() if k[0] == "s0"}
    out = {r.process_name: r.timeperiod for r in L.next_period(ledger.where("site = 's0'").drop("site"), SITE_SUITE, NOW).collect()}
    as_site = {("s0", *k): v for k, v in one.items()}
    expected = {}
    for tree in SITE_SUITE.trees.values():
        expected |= walk_next(as_site, "s0", tree)
    assert out == expected


def test_next_period_of_a_new_ledger(spark, ledger):
    """One row, or none: every declared process has a next bucket."""
    row = ledger.where("process_name = 'site_hourly'").limit(1)
    now = NOW.strftime("%Y%m%d%H")
    current = {p: coarsen(qualifier(p), now) for p in SITE_SUITE.tree_of}
    out = {r.process_name: r.timeperiod for r in L.next_period(row, SITE_SUITE, NOW, by=BY).collect()}
    assert out.keys() == current.keys() and all(out[p] == current[p] for p in out if p != "site_hourly")
    out = {r.process_name: r.timeperiod for r in L.next_period(ledger.where("false").drop("site"), SITE_SUITE, NOW).collect()}
    assert out == current


def state_of(plain, key):
    return (plain.get(key) or (None,))[0] or S.EMBRYO


def test_readiness_and_gate(ledger, plain):
    out = {tuple(r[:3]): r for r in L.gate(ledger, SITE_SUITE, by=BY).select("site", "process_name", "timeperiod", "ready", "decision").collect()}
    assert out.keys() == plain.keys()
    for (site, p, tp), r in out.items():
        waits = [state_of(plain, (site, d, tp)) for d in SITE_SUITE.dependencies(p)]
        kids = [s or S.EMBRYO for s, _ in children(plain, site, p, tp).values()]
        mine = state_of(plain, (site, p, tp))
        ready = all(s in S.JOB_FINISHED for s in waits + kids) and mine in S.JOB_ACTIVE
        assert r.ready == ready
        blocking = SITE_SUITE.processes[p].blocking
        if mine in S.JOB_FINISHED:
            expected = "done"
        elif blocking == C.BLOCKING_NORMAL:
            expected = "run"
        elif blocking == C.BLOCKING_CHILDREN:
            expected = "run" if ready else "wait"
        elif all(s in (S.PROCESSED, S.NOOP) for s in waits):
            expected = "run"
        else:
            expected = "skip" if S.SKIPPED in waits else "wait"
        assert r.decision == expected


def test_bucket_status(ledger, plain):
    ready = {tuple(r[:3]): r[3] for r in L.readiness(ledger, SITE_SUITE, by=BY).select("site", "process_name", "timeperiod", "ready").collect()}
    for r in L.bucket_status(ledger, SITE_SUITE, NOW, by=BY).collect():
        key = (r.site, r.process_name, r.timeperiod)
        current = coarsen(qualifier(r.process_name), NOW.strftime("%Y%m%d%H"))
        if state_of(plain, key) in S.JOB_FINISHED:
            assert r.status == "done"
        elif r.timeperiod == current or not ready[key]:
            assert r.status == "open"
        else:
            assert r.status == ("ready" if r.timeperiod < current else "future")


def test_audit(ledger, plain):
    expected = set()
    for (site, p, tp), _ in plain.items():
        kids = [s or S.EMBRYO for s, _ in children(plain, site, p, tp).values()]
        if not kids:
            continue
        mine = state_of(plain, (site, p, tp))
        q, parent = qualifier(p), SITE_SUITE.parent(p)
        later = sorted(k[2] for k in plain if k[:2] == (site, p) and k[2] > tp)
        following = {P.DAILY: lambda t: (datetime.strptime(t, "%Y%m%d00") + timedelta(days=1)).strftime("%Y%m%d00"),
                     P.MONTHLY: lambda t: f"{t[:4]}{int(t[4:6]) + 1:02d}0000", P.YEARLY: lambda t: f"{int(t[:4]) + 1}000000"}[q](tp)
        younger = following in later and (parent is None or coarsen(qualifier(parent), following) == coarsen(qualifier(parent), tp))
        if mine in S.JOB_FINISHED and any(s in S.JOB_ACTIVE for s in kids):
            expected.add((site, p, tp, "reprocess"))
        elif all(s == S.SKIPPED for s in kids) and younger and mine != S.SKIPPED:
            expected.add((site, p, tp, "skip"))
    out = L.audit(ledger, SITE_SUITE, by=BY).select("site", "process_name", "timeperiod", "action")
    assert {tuple(r) for r in out.collect()} == expected


def spread(plain, start, up):
    """Walk the graph bucket by bucket, as a recursive propagation does."""
    seen, todo = set(), list(start)
    while todo:
        site, p, tp = todo.pop()
        if (site, p, tp) in seen:
            continue
        seen.add((site, p, tp))
        todo += [(site, d, tp) for d in SITE_SUITE.dependents(p)]
        if up and SITE_SUITE.parent(p):
            todo.append((site, SITE_SUITE.parent(p), coarsen(qualifier(SITE_SUITE.parent(p)), tp)))
        if not up:
            todo += children(plain, site, p, tp)
    return seen


def test_propagation(spark, ledger, plain):
    start = [k for i, k in enumerate(sorted(plain)) if i % 29 == 0]
    changes = spark.createDataFrame(start, "site string, process_name string, timeperiod string")
    dirty = L.propagate_dirty(changes, SITE_SUITE, ledger, by=BY).collect()
    assert len(dirty) == len({tuple(r[:3]) for r in dirty})
    assert {tuple(r[:3]) for r in dirty} == spread(plain, start, True)
    for r in dirty:
        assert r.action == ("none" if state_of(plain, tuple(r[:3])) == S.EMBRYO else "reprocess")
    skip = L.propagate_skip(changes, SITE_SUITE, ledger, by=BY).collect()
    assert {tuple(r[:3]) for r in skip} == {k for k in spread(plain, start, False) if k in plain}
    unknown = spark.createDataFrame([("s0", "site_daily", "2009020300")], "site string, process_name string, timeperiod string")
    assert {tuple(r) for r in L.propagate_skip(unknown, SITE_SUITE, ledger, by=BY).collect()} == {
        ("s0", p, "2009020300", S.EMBRYO, "skip") for p in ("site_daily", "client_daily")
    }
    for r in skip:
        assert r.action == ("none" if state_of(plain, tuple(r[:3])) in S.JOB_FINISHED else "skip")
    late = late_to_dirty(changes, SITE_SUITE, ledger, by=BY).select("site", "process_name", "timeperiod")
    closed = [k for k in start if state_of(plain, k) in S.JOB_FINISHED]
    assert {tuple(r) for r in late.collect()} == spread(plain, closed, True)


def test_spine_and_gaps(spark, ledger, plain):
    sites = spark.createDataFrame([("s0",), ("s1",)], "site string")
    out = spine.period_spine(sites, SITE_SUITE, "2010013100", NOW)
    buckets = defaultdict(set)
    for r in out.collect():
        buckets[r.site, r.process_name].add(r.timeperiod)
    hours = [datetime(2010, 1, 31) + timedelta(hours=h) for h in range(54)]
    for (_, p), got in buckets.items():
        assert got == {coarsen(qualifier(p), h.strftime("%Y%m%d%H")) for h in hours}
    assert len(buckets) == 16
    resumed = spine.period_spine(sites, SITE_SUITE, "2010013100", NOW, resume="2010020204")
    assert resumed.where("site = 's0' and process_name = 'site_hourly'").count() == 2
    gaps = spine.missing_periods(out, ledger.where("timeperiod <> '2010013100'"), by=BY)
    assert {tuple(r[1:4]) for r in gaps.where("site = 's0'").collect()} == {
        (p, qualifier(p), "2010013100") for p in SITE_SUITE.tree_of if (p == "site_hourly") or qualifier(p) == P.DAILY
    }


def test_ancestors(spark):
    df = spark.createDataFrame([("2010013105",), ("2010013106",), ("2010020100",)], "timeperiod string")
    out = {tuple(r) for r in spine.with_ancestors(df, ["hourly", "daily", "yearly"]).collect()}
    assert out == {
        (P.HOURLY, "2010013105"), (P.HOURLY, "2010013106"), (P.HOURLY, "2010020100"),
        (P.DAILY, "2010013100"), (P.DAILY, "2010020100"), (P.YEARLY, "2010000000"),
    }


def test_catalog():
    assert SITE_SUITE.levels(SITE_SUITE.trees["tree_site"]) == ["site_yearly", "site_monthly", "site_daily", "site_hourly"]
    assert SITE_SUITE.dependents("site_daily") == ["client_daily"] and SITE_SUITE.dependents("site_hourly") == []
    assert set(SITE_SUITE.reach_up("site_daily")) == {
        "site_daily", "site_monthly", "site_yearly", "client_daily", "client_monthly", "client_yearly",
    }
    with pytest.raises(ValueError):
        C.Catalog([C.Process("a", P.DAILY), C.Process("b", P.DAILY)], [C.Tree("t", ("a", "b"))])


ATTEMPT = (
    "attempt_id int, process_name string, timeperiod string, start_timeperiod string, state string, created_at timestamp_ntz, "
    "submitted_at timestamp_ntz, number_of_retries int, unit_of_work_type string"
)


def attempt(i, state, age_hours=2.0, idle_hours=0.5, p="site_hourly", tp="2010020203", kind=S.MANAGED):
    return (i, p, tp, tp, state, NOW - timedelta(hours=age_hours), NOW - timedelta(hours=idle_hours), 1, kind)


def test_triage(spark):
    rows = [
        attempt(1, S.REQUESTED),
        attempt(2, S.INVALID),
        attempt(3, S.IN_PROGRESS, idle_hours=1.5),
        attempt(4, S.INVALID, age_hours=49),
        attempt(5, S.REQUESTED, age_hours=48, idle_hours=1),
        attempt(6, S.PROCESSED, age_hours=900, idle_hours=800),  # finished ones are never reopened
        attempt(7, S.CANCELED, idle_hours=30),
        attempt(8, S.INVALID, kind=S.FREERUN),
        attempt(9, S.INVALID, p="retired"),
    ]
    out = L.triage(spark.createDataFrame(rows, ATTEMPT), SITE_SUITE, NOW).orderBy("attempt_id").collect()
    assert [(r.action, r.state, r.number_of_retries) for r in out] == [
        ("keep", S.REQUESTED, 1),
        ("resubmit", S.REQUESTED, 2),
        ("resubmit", S.REQUESTED, 1),
        ("cancel", S.CANCELED, 1),
        ("keep", S.REQUESTED, 1),
        ("keep", S.PROCESSED, 1),
        ("keep", S.CANCELED, 1),
        ("keep", S.INVALID, 1),
        ("keep", S.INVALID, 1),
    ]
    assert out[1].submitted_at == NOW


def test_candidates(spark):
    rows = [
        attempt(1, S.REQUESTED, tp="2010020203"),
        attempt(2, S.REQUESTED, tp="2010020202"),  # before the hour
        attempt(3, S.INVALID, p="site_daily", tp="2010020200"),
        attempt(4, S.INVALID, p="site_daily", tp="2010020100"),  # before the day
        attempt(5, S.IN_PROGRESS, p="site_monthly", tp="2010020000"),
        attempt(6, S.IN_PROGRESS, p="site_yearly", tp="2010000000"),
        attempt(7, S.IN_PROGRESS, p="site_yearly", tp="2009000000"),  # before the year
        attempt(8, S.PROCESSED, tp="2010020203"),  # finished
        attempt(9, S.REQUESTED, tp="2010020203", kind=S.FREERUN),
        attempt(10, S.REQUESTED, p="retired", tp="2010020203"),
    ]
    df = spark.createDataFrame(rows, ATTEMPT)
    assert sorted(r.attempt_id for r in L.reprocess_candidates(df, SITE_SUITE, "2010020203").collect()) == [1, 3, 5, 6]
    assert sorted(r.attempt_id for r in L.reprocess_candidates(df, SITE_SUITE).collect()) == [1, 2, 3, 4, 5, 6, 7]
    off = C.Catalog([replace(p, is_on=p.name != "site_daily") for p in SITE_SUITE.processes.values()], list(SITE_SUITE.trees.values()))
    assert sorted(r.attempt_id for r in L.reprocess_candidates(df, off).collect()) == [1, 2, 5, 6, 7]


def test_caps(spark):
    events = spark.sql("select id % 2 as key, id as ts, id as tie from range(600)")
    out = L.cap_events(events, ["key"], "ts", "tie", 128).collect()
    assert len(out) == 2 * 129 and min(r.ts for r in out) == 600 - 2 * 129
    assert L.newest(events, ["key"], [F.desc("ts")], 168).count() == 2 * 168
    plan = L.newest(events, ["key"], [F.desc("ts")], 168)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # map tasks forward at most the cap per key


def test_closed_buckets(spark):
    df = spark.createDataFrame(
        [("site_hourly", "2010020205"), ("client_daily", "2010020100"), ("client_daily", "2010020200"), ("client_daily", "2010013100")],
        "process_name string, timeperiod string",
    )
    ledger = df.withColumn("state", F.lit(S.EMBRYO))

    def may_start(now):
        out = L.closed_buckets(ledger, SITE_SUITE, now).collect()
        return {(r.process_name, r.timeperiod) for r in out if r.may_start}

    live = {("site_hourly", "2010020205")}
    assert may_start(datetime(2010, 2, 2, 0, 5)) == live | {("client_daily", "2010013100")}
    assert may_start(datetime(2010, 2, 2, 0, 5, 1)) == live | {("client_daily", "2010013100"), ("client_daily", "2010020100")}


def test_reports(spark, ledger, plain):
    matrix = {(r.site, r.process_name, r.timeperiod): r.state for r in L.state_matrix(ledger, SITE_SUITE, "2010013100", NOW, by=BY).collect()}
    hours = [(datetime(2010, 1, 31) + timedelta(hours=h)).strftime("%Y%m%d%H") for h in range(54)]
    assert matrix.keys() == {(s, p, coarsen(qualifier(p), h)) for s in {k[0] for k in plain} for p in SITE_SUITE.tree_of for h in hours}
    assert all(v == (plain.get(k) or (None,))[0] for k, v in matrix.items())
    for r in L.node_details(ledger, SITE_SUITE, by=BY).collect():
        state, failures = plain[r.site, r.process_name, r.timeperiod]
        assert r.state == (state or "NA")
        assert r.number_of_failures == ("NA" if failures is None else str(failures))
        assert r.number_of_children == len(children(plain, r.site, r.process_name, r.timeperiod)) == len(r.children or [])


def test_inline_tables(spark):
    rows = [("it's", None, True), ("back\\slash", 2, False)]
    out = C.inline(spark, "a string, n int, b boolean", rows)
    assert [tuple(r) for r in out.collect()] == rows
    assert C.inline(spark, "a string, n int", []).count() == 0


# ---- ledgers with gaps, over a calendar that crosses months and years ----------------------

START, CLOCK = "2009123105", datetime(2010, 2, 3, 7, 20)


def make_gappy(seed):
    """Random rows for part of the calendar from START to CLOCK, and a few beyond either end."""
    rng = random.Random(seed)
    hours = [datetime(2009, 12, 31, 5) + timedelta(hours=h) for h in range(int((CLOCK - datetime(2009, 12, 31, 5)).total_seconds() // 3600) + 1)]
    states = [S.EMBRYO, S.IN_PROGRESS, S.PROCESSED, S.SKIPPED, S.NOOP, None]
    rows, calendar = {}, {p: sorted({coarsen(qualifier(p), h.strftime("%Y%m%d%H")) for h in hours}) for p in SITE_SUITE.tree_of}
    for site, (held, weights) in enumerate([(1, [0, 0, 1, 0, 0, 0]), (0.999, [0, 0, 9, 1, 9, 0]), (0.9, [1, 1, 40, 40, 40, 1]), (0.2, [1, 1, 9, 9, 9, 1]), (1, [0, 0, 0, 1, 0, 0]), (0.997, [0, 0, 0, 1, 0, 0])]):
        for p, periods in calendar.items():
            beyond = {P.HOURLY: ["2009123104", "2010020309"], P.DAILY: ["2009123000", "2010020500"], P.MONTHLY: ["2010030000"], P.YEARLY: ["2011000000"]}[qualifier(p)]
            for tp in periods + rng.sample(beyond, rng.randrange(len(beyond) + 1)):
                if rng.random() < held:
                    state = rng.choices(states, weights)[0]
                    rows[f"s{site}", p, tp] = (state, None if state is None else rng.choice([0, 0, 4]))
    return rows, calendar


@pytest.fixture(scope="module", params=[4, 5])
def gappy(request):
    return make_gappy(request.param)


@pytest.fixture(scope="module")
def gappy_ledger(spark, gappy):
    return spark.createDataFrame([(*k, *v) for k, v in gappy[0].items()], COLUMNS)


def all_children(rows, calendar, site, p, tp):
    """States of every child that has a row or that the calendar has; None for one without a row."""
    child = SITE_SUITE.child(p)
    if not child:
        return {}
    held = {t: rows[s, c, t] for s, c, t in rows if (s, c) == (site, child) and coarsen(qualifier(p), t) == tp}
    return {t: (None, None) for t in calendar[child] if coarsen(qualifier(p), t) == tp} | held


def worth_skipping(rows, calendar, site, p, tp):
    state, failures = rows[site, p, tp]
    if state is None:
        return False
    if state in S.JOB_FINISHED:
        return True
    if SITE_SUITE.child(p) is None:
        return failures > 3
    return all(s is not None and (f > 3 or s == S.SKIPPED) for s, f in all_children(rows, calendar, site, p, tp).values())


SPAN = (START, CLOCK)


def test_gaps_keep_parents_open(gappy_ledger, gappy):
    rows, calendar = gappy
    out = {tuple(r[:3]): r for r in L.readiness(gappy_ledger, SITE_SUITE, by=BY, span=SPAN).select("site", "process_name", "timeperiod", "children_finished", "ready").collect()}
    assert out.keys() == rows.keys()
    for (site, p, tp), r in out.items():
        kids = [s or S.EMBRYO for s, _ in all_children(rows, calendar, site, p, tp).values()]
        assert r.children_finished == all(s in S.JOB_FINISHED for s in kids)
        waits = [state_of(rows, (site, d, tp)) for d in SITE_SUITE.dependencies(p)]
        assert r.ready == (r.children_finished and all(s in S.JOB_FINISHED for s in waits) and state_of(rows, (site, p, tp)) in S.JOB_ACTIVE)
    skip = L.should_skip(gappy_ledger, SITE_SUITE, by=BY, span=SPAN).select("site", "process_name", "timeperiod", "skippable")
    assert {tuple(r[:3]): r[3] for r in skip.collect()} == {k: worth_skipping(rows, calendar, *k) for k in rows}
    details = L.node_details(gappy_ledger, SITE_SUITE, by=BY, span=SPAN).collect()
    for r in details:
        kids = all_children(rows, calendar, r.site, r.process_name, r.timeperiod)
        assert r.number_of_children == len(kids)
        assert [(c.timeperiod, c.state) for c in r.children or []] == [(t, kids[t][0] or "NA") for t in sorted(kids)]


def test_gaps_come_next(gappy_ledger, gappy):
    rows, calendar = gappy
    expected = {}
    for site in {k[0] for k in rows}:
        for tree in SITE_SUITE.trees.values():
            chosen = None
            for p in SITE_SUITE.levels(tree):
                parent = SITE_SUITE.parent(p)
                grand = parent and SITE_SUITE.parent(parent)
                found = []
                for tp in set(calendar[p]) | {t for s, name, t in rows if (s, name) == (site, p)}:
                    if parent:
                        above = coarsen(qualifier(parent), tp)
                        if above < chosen or grand and coarsen(qualifier(grand), above) != coarsen(qualifier(grand), chosen):
                            continue
                    state, _ = rows.get((site, p, tp), (None, None))
                    if state is None or state in S.JOB_ACTIVE and not worth_skipping(rows, calendar, site, p, tp):
                        found.append(tp)
                chosen = min(found, default=coarsen(qualifier(p), CLOCK.strftime("%Y%m%d%H")))
                expected[site, p] = chosen
    out = L.next_period(gappy_ledger, SITE_SUITE, CLOCK, by=BY, start=START)
    assert {(r.site, r.process_name): r.timeperiod for r in out.collect()} == expected


def test_gaps_are_audited(gappy_ledger, gappy):
    rows, calendar = gappy
    expected = set()
    following = {P.DAILY: lambda t: (datetime.strptime(t, "%Y%m%d00") + timedelta(days=1)).strftime("%Y%m%d00"),
                 P.MONTHLY: lambda t: f"{int(t[:4]) + int(t[4:6]) // 12}{int(t[4:6]) % 12 + 1:02d}0000", P.YEARLY: lambda t: f"{int(t[:4]) + 1}000000"}
    for site, p, tp in rows:
        kids = [s or S.EMBRYO for s, _ in all_children(rows, calendar, site, p, tp).values()]
        if not kids:
            continue
        mine, parent, after = state_of(rows, (site, p, tp)), SITE_SUITE.parent(p), following[qualifier(p)](tp)
        younger = ((site, p, after) in rows or after in calendar[p]) and (not parent or coarsen(qualifier(parent), after) == coarsen(qualifier(parent), tp))
        if mine in S.JOB_FINISHED and any(s in S.JOB_ACTIVE for s in kids):
            expected.add((site, p, tp, "reprocess"))
        elif all(s == S.SKIPPED for s in kids) and younger and mine != S.SKIPPED:
            expected.add((site, p, tp, "skip"))
    out = L.audit(gappy_ledger, SITE_SUITE, by=BY, span=SPAN).select("site", "process_name", "timeperiod", "action")
    assert {tuple(r) for r in out.collect()} == expected and len(expected) > 3


def test_an_empty_span_expects_nothing(gappy_ledger):
    early = datetime(2009, 12, 30)
    plain = L.should_skip(gappy_ledger, SITE_SUITE, by=BY).select("site", "process_name", "timeperiod", "skippable")
    spanned = L.should_skip(gappy_ledger, SITE_SUITE, by=BY, span=(START, early)).select("site", "process_name", "timeperiod", "skippable")
    assert plain.exceptAll(spanned).count() == 0


def test_running_numbers(spark):
    periods = [("_hourly", "2012022923"), ("_hourly", "1969123123"), ("_daily", "2012022900"), ("_monthly", "2011120000"), ("_yearly", "2012000000")]
    df = spark.createDataFrame(periods, "q string, tp string")
    out = df.select("q", "tp", P.period_number_by("q", "tp").alias("n")).select("q", "tp", "n", P.numbered_period_by("q", F.col("n")).alias("back")).collect()
    assert [(r.q, r.back) for r in out] == periods
    assert [r.n for r in out] == [P.moment_number(q, P.moment(tp)) for q, tp in periods]


def test_event_log_and_wide_matrix(spark, ledger, plain):
    log = spark.sql("select 's0' as site, 'site_daily' as process_name, '2010013100' as timeperiod, timestamp_ntz'2010-01-31 00:00:00' + make_dt_interval(0, 0, id) as logged_at, concat('m', id) as message from range(300)")
    out = {tuple(r[:3]): r.event_log for r in L.node_details(ledger, SITE_SUITE, by=BY, events=log).select("site", "process_name", "timeperiod", "event_log").collect()}
    assert [e.message for e in out.pop(("s0", "site_daily", "2010013100"))] == [f"m{i}" for i in range(299, 170, -1)]
    assert set(map(tuple, out.values())) == {()}
    wide = L.state_matrix_wide(ledger, SITE_SUITE, "daily", "2010013000", NOW, by=BY)
    assert wide.columns == ["site", "process_name", "2010013000", "2010013100", "2010020100", "2010020200"]
    got = {(r.site, r.process_name): r for r in wide.collect()}
    assert got.keys() == {(f"s{i}", p) for i in range(3) for p in ("site_daily", "client_daily", "alert_daily")}
    assert all(r[tp] == (plain.get((*k, tp)) or (None,))[0] for k, r in got.items() for tp in wide.columns[2:])
