"""Roll-ups against plain Python sums over rows drawn by a seeded generator."""

from collections import Counter, defaultdict

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.operators import compare as C
from tidemark.operators import rollup as R

N = 160


def session_rows():
    rng = random.Random(17)
    rows = []
    for i in range(N):
        screen = rng.choice([(1280, 720), (1920, 1080), (390, 844), (None, None)])
        hour = 2023110400 + rng.choice([300, 307, 308, 323, 400])
        rows.append(
            (
                f"shop-{rng.randrange(9)}.test",
                str(hour),
                f"visit-{i:04d}",
                rng.choice(["alpha", "beta", "gamma", None]),
                rng.choice([None, "b 1", "b 2", "b 3"]),
                rng.choice(["aa", "bb"]),
                rng.choice(["xx", "yy", "zz"]),
                *screen,
                2**33 + rng.randrange(1000),
                2**31 + rng.randrange(10**6),
            )
        )
    return rows


SESSION = (
    "domain string, timeperiod string, session_id string, os string, browser string, language string, country string, "
    "screen_x long, screen_y long, number_of_pageviews long, total_duration long"
)


def stat_rows(q):
    """Counters of few sites in random buckets around the end of a month and of a year."""
    rng = random.Random(q)
    rows = []
    for i in range(N):
        day = date(2022, 12, 20) + timedelta(days=rng.randrange(40 if q != "monthly" else 400))
        text = {"hourly": f"{day:%Y%m%d}{rng.randrange(24):02d}", "daily": f"{day:%Y%m%d}00", "monthly": f"{day:%Y%m}0000"}[q]
        rows.append((f"shop-{rng.randrange(7)}.test", text, rng.randrange(50), rng.randrange(90), 10**11 + rng.randrange(1000)))
    return rows


STATS = "domain string, timeperiod string, number_of_visits long, number_of_pageviews long, total_duration long"


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(session_rows(), SESSION)


def test_site_hourly(sessions):
    expected = defaultdict(lambda: [0, 0, 0])
    maps = defaultdict(lambda: defaultdict(Counter))
    for d, tp, _, os_, browser, lang, country, x, y, views, seconds in session_rows():
        e = expected[d, tp]
        e[0] += 1
        e[1] += views
        e[2] += seconds
        for family, key in (("os", os_), ("browser", browser), ("language", lang), ("country", country),
                            ("screen_resolution", f"({x}, {y})")):
            if key is not None:
                maps[d, tp][family][key] += 1
    counters, histograms = R.run_spec(sessions, R.site_hourly_spec())
    out = R.nest_statistics(counters, histograms, ["domain", "timeperiod"]).collect()
    assert len(out) == len(expected)
    for r in out:
        key = (r.domain, r.timeperiod)
        assert [r.stat.number_of_visits, r.stat.number_of_pageviews, r.stat.total_duration] == expected[key]
        for family in R.FAMILIES:
            assert r.stat[family] == dict(maps[key][family])
    packed = R.pack_maps(histograms, ["domain", "timeperiod"])
    for r in packed.select(F.map_keys("browser").alias("k")).collect():
        assert r.k == sorted(r.k)


@pytest.mark.parametrize("given, target, cut", [("hourly", "daily", 8), ("daily", "monthly", 6), ("monthly", "yearly", 4)])
def test_each_level(spark, given, target, cut):
    df = spark.createDataFrame(stat_rows(given), STATS)
    expected = defaultdict(lambda: [0, 0, 0])
    for d, tp, *values in stat_rows(given):
        for i, v in enumerate(values):
            expected[d, tp[:cut].ljust(10, "0")][i] += v
    out = {(r[0], r[1]): list(r[2:]) for r in R.rollup_periods(df, target).collect()}
    assert out == dict(expected)


def test_rollup_law(sessions):
    """Level by level, straight to the year, and all levels at once agree."""
    hours = R.site_hourly(sessions)
    chain = R.rollup_chain(hours, ["hourly", "daily", "monthly", "yearly"])
    assert list(chain) == [P.YEARLY, P.MONTHLY, P.DAILY, P.HOURLY]
    direct = {tuple(r) for r in R.rollup_periods(hours, "yearly").collect()}
    assert {tuple(r) for r in chain[P.YEARLY].collect()} == direct
    both = R.rollup_chain(hours, ["yearly", "hourly"])
    assert {tuple(r) for r in both[P.YEARLY].collect()} == direct
    once = R.rollup_levels(hours, ["yearly", "daily"])
    columns = ["domain", "timeperiod", *R.COUNTERS]
    assert {tuple(r) for r in once.where("time_qualifier = '_yearly'").select(*columns).collect()} == direct
    long = R.site_hourly_histograms(sessions)
    by_day = R.rollup_histograms(R.rollup_histograms(long, "daily"), "monthly")
    assert {tuple(r) for r in by_day.collect()} == {tuple(r) for r in R.rollup_histograms(long, "monthly").collect()}


def test_levels_of_a_mixed_chain():
    levels = ["hourly", "yearly", "daily"]
    assert R.parent_level(levels, "hourly") == "daily"
    assert R.parent_level(levels, "daily") == "yearly"
    assert R.parent_level(levels, "yearly") is None
    assert R.child_level(levels, "yearly") == "daily"
    assert R.child_level(levels, "hourly") is None


def test_map_sums(spark):
    df = spark.createDataFrame(
        [("a", {"x": 1, "y": 2}), ("a", {"y": 3}), ("b", None), ("b", {"z": 1})], "k string, m map<string,bigint>"
    )
    out = {tuple(r) for r in R.sum_maps(df, ["k"], {"m": F.col("m")}).collect()}
    assert out == {("a", "m", "x", 1), ("a", "m", "y", 5), ("b", "m", "z", 1)}
    pair = spark.sql("select map('x', 1L, 'y', 2L) as a, map('y', 3L) as b")
    assert pair.select(R.add_maps(F.col("a"), F.col("b"))).first()[0] == {"x": 1, "y": 5}


def test_spec_finish_hook(sessions):
    spec = R.AggSpec({"domain": F.col("domain")}, {"n": F.count(F.lit(1))}, finish=lambda df: df.where("n > 2"))
    counters, histograms = R.run_spec(sessions, spec)
    assert histograms is None
    assert counters.count() == sum(1 for c in Counter(r[0] for r in session_rows()).values() if c > 2)


def test_owners_and_alerts(spark):
    days = spark.createDataFrame(
        [
            ("a", "2001030100", 10, 100, 1),
            ("a", "2001030800", 10, 121, 1),  # pageviews above the band
            ("b", "2001030100", 10, 100, 1),
            ("b", "2001030800", 8, 120, 1),  # both exactly on the edge: no alert
            ("c", "2001022800", 10, 100, 1),
            ("c", "2001030700", 7, 100, 1),  # visits below the band, over a month's end
            ("d", "2001030100", 10, 0, 1),
            ("d", "2001030800", 5, 50, 1),  # zero baseline
            ("e", "2001030800", 5, 50, 1),  # no baseline
        ],
        STATS,
    )
    assert {tuple(r) for r in C.period_alert(days).collect()} == {("a", "2001030800", 0, 21), ("c", "2001030700", -3, 0)}
    assert [tuple(r) for r in C.alert_rejects(days).collect()] == [("d", "2001030800")]
    owners = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "domain string, client_id string")
    clients = {tuple(r) for r in C.client_daily(days, owners).collect()}
    assert ("x", "2001030800", 18, 241, 2) in clients
    assert ("y", "2001022800", 10, 100, 1) in clients
    assert {r.domain for r in C.assign_owner(days, owners)[1].collect()} == {"d", "e"}


def test_a_stored_chain_reads_its_source_once(spark, sessions):
    from tidemark.sources.shared import fresh_dir

    hours = R.site_hourly(sessions)
    plain = R.rollup_chain(hours, ["hourly", "daily", "yearly"])
    stored = R.rollup_chain(hours, ["hourly", "daily", "yearly"], store=fresh_dir(spark, "chain"))
    for q, df in plain.items():
        assert sorted(map(tuple, stored[q].collect())) == sorted(map(tuple, df.collect()))
        assert "Exchange" not in stored[q]._jdf.queryExecution().executedPlan().toString()
