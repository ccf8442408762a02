from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period as P


def run(spark, values, fn, schema="c string"):
    """Apply a Column function to a list of inputs and return the outputs in order."""
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c")).alias("o")).collect()]


def check(spark, pairs, fn):
    assert run(spark, [a for a, _ in pairs], fn) == [b for _, b in pairs]


SHAPES = {"real_time": "%Y%m%d%H%M%S", "hourly": "%Y%m%d%H", "daily": "%Y%m%d00", "monthly": "%Y%m0000", "yearly": "%Y000000"}
# moments of our own: month and year ends, a leap day, and hours spread by a prime step
MOMENTS = [
    *(datetime(1999, 2, 27, 21, 8, 54) + timedelta(hours=37 * i, seconds=11 * i) for i in range(12)),
    datetime(2024, 2, 29, 23, 59, 59), datetime(2023, 12, 31, 0, 0, 1), datetime(2028, 1, 1, 7, 0, 0), datetime(2031, 11, 30, 15, 1, 2),
]


def label(q, t):
    return t.strftime(SHAPES[q])


def moved(q, t, delta):
    """``t`` moved by whole units, with calendar arithmetic on plain dates."""
    if q == "hourly":
        return t + timedelta(hours=delta)
    if q == "daily":
        return t + timedelta(days=delta)
    months = t.year * 12 + t.month - 1 + delta * (12 if q == "yearly" else 1)
    return datetime(months // 12, months % 12 + 1, 1)


def floor(q, t):
    cut = {"hourly": {}, "daily": {"hour": 0}, "monthly": {"hour": 0, "day": 1}, "yearly": {"hour": 0, "day": 1, "month": 1}}
    return t if q == "real_time" else t.replace(minute=0, second=0, **cut[q])


def test_patterns(spark):
    shown = {"real_time": "%Y%m%d%H%M%S", "hourly": "%Y%m%d%H", "daily": "%Y%m%d00", "monthly": "%Y%m0000", "yearly": "%Y000000"}
    noon = datetime(2017, 8, 14, 12, 30, 5)
    check(spark, [(label(q, noon), p) for q, p in shown.items()], P.period_pattern)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_epoch_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        seconds = [int(t.replace(tzinfo=timezone.utc).timestamp()) for t in MOMENTS] + [1520751600 + 900 * i for i in range(12)]
        texts = [datetime.fromtimestamp(s, timezone.utc).strftime("%Y%m%d%H%M%S") for s in seconds]
        assert run(spark, [s + 0.75 for s in seconds], P.epoch_to_session, "c double") == texts
        assert run(spark, texts, P.session_to_epoch) == seconds
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_step_up(spark):
    steps = [("real_time", "hourly", P.session_to_hour), ("hourly", "daily", P.hour_to_day), ("daily", "monthly", P.day_to_month), ("monthly", "yearly", P.month_to_year)]
    for fine, coarse, fn in steps:
        check(spark, [(label(fine, t), label(coarse, t)) for t in MOMENTS], fn)


@pytest.mark.parametrize(
    "fn, bad",
    [
        (P.session_to_hour, "2017081412"),
        (P.hour_to_day, "2017081424"),
        (P.day_to_month, "2017081407"),
        (P.month_to_year, "2017140000"),
        (P.month_to_year, "2017000000"),
    ],
)
def test_step_up_rejects_other_shapes(spark, fn, bad):
    with pytest.raises(Exception):
        run(spark, [bad], fn)


def test_cast(spark):
    order = list(SHAPES)
    for q in order[1:]:
        for given in order:
            # a coarser period becomes the first of its finer ones
            pairs = [(label(given, t), label(q, floor(given, t))) for t in MOMENTS]
            check(spark, pairs, lambda c, q=q: P.cast_period(q, c))
            check(spark, pairs, lambda c, q=q: P.cast_period_by(F.lit("_" + q), c))
    with pytest.raises(ValueError):
        P.cast_period("weekly", "c")


def test_timestamps(spark):
    for moment in MOMENTS[::5]:
        row = spark.range(1).select(*[P.current_period(q, moment).alias(q) for q in SHAPES]).first().asDict()
        assert row == {q: label(q, moment) for q in SHAPES}
    for q in SHAPES:
        check(spark, [(label(q, t), floor(q, t)) for t in MOMENTS], lambda c, q=q: P.period_start(q, c))


@pytest.mark.parametrize("q, delta", [("hourly", 1), ("hourly", -7), ("daily", 1), ("daily", -31), ("monthly", 1), ("monthly", -14), ("monthly", 30), ("yearly", 2), ("yearly", -9)])
def test_shift(spark, q, delta):
    pairs = [(label(q, t), label(q, moved(q, floor(q, t), delta))) for t in MOMENTS]
    check(spark, pairs, lambda c: P.shift_period(q, c, delta))
    check(spark, pairs, lambda c: P.shift_period_by(F.lit("_" + q), c, F.lit(delta)))


def test_split(spark):
    t = MOMENTS[3]
    parts = [f"{t:%Y}", f"{t:%m}", f"{t:%d}", f"{t:%H}"]
    for keep, q in ((4, "hourly"), (3, "daily"), (2, "monthly"), (1, "yearly")):
        assert tuple(run(spark, [label(q, t)], P.split_period)[0]) == (*parts[:keep], *["00"] * (4 - keep))
    with pytest.raises(Exception):
        run(spark, [label("real_time", t)], P.split_period)


def last_of(n, stem, first, upper):
    """Group label by counting: groups of ``n`` end at multiples of ``n``; the last one may be short."""
    ends = sorted({k for k in range(n, upper + 1, n)} | {upper})
    return next(e for e in ends if e >= max(stem, first))


def start_of(n, stem, upper):
    """First unit of the group by walking back until the label changes, on units from 1."""
    k = stem
    while k > 1 and last_of(n, k - 1, 1, upper) == last_of(n, stem, 1, upper):
        k -= 1
    return k


def days_in(t):
    return (moved("monthly", t, 1) - timedelta(days=1)).day


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_group(spark, n):
    check(spark, [(label("hourly", t), f"{t:%Y%m%d}{last_of(n, t.hour, 1 if n > 1 else 0, 23) if n > 1 else t.hour:02d}") for t in MOMENTS], lambda c: P.group_period("hourly", n, c))
    check(spark, [(label("daily", t), f"{t:%Y%m}{last_of(n, t.day, 1, days_in(t)):02d}00") for t in MOMENTS], lambda c: P.group_period("daily", n, c))
    check(spark, [(label("monthly", t), f"{t:%Y}{last_of(n, t.month, 1, 12):02d}0000") for t in MOMENTS], lambda c: P.group_period("monthly", n, c))


def test_group_of_one_year(spark):
    check(spark, [(label("yearly", t), label("yearly", t)) for t in MOMENTS], lambda c: P.group_period("yearly", 1, c))


def test_group_start(spark):
    check(spark, [(label("daily", t), f"{t:%Y%m}{start_of(4, t.day, days_in(t)):02d}00") for t in MOMENTS], lambda c: P.group_start("daily", 4, c))
    check(spark, [(label("monthly", t), f"{t:%Y}{start_of(5, t.month, 12):02d}0000") for t in MOMENTS], lambda c: P.group_start("monthly", 5, c))


def test_grouping_limits():
    for q, n in [("hourly", 25), ("daily", 30), ("monthly", 14), ("yearly", 3), ("daily", 0)]:
        with pytest.raises(ValueError):
            P.group_period(q, n, "c")


def test_fold_by_group(spark):
    rows = [(f"20170814{h:02d}", h) for h in range(24)]
    df = spark.createDataFrame(rows, "timeperiod string, v int")
    out = P.fold_by_group(df.withColumn("seq", F.col("v")), "hourly", 5, "seq")
    ends = {last_of(5, h, 1, 23) for h in range(24)}
    assert {r.timeperiod[-2:]: r.v for r in out.collect()} == {f"{e:02d}": e for e in ends}
    assert df.select(F.count_if(P.is_between_group("hourly", 5, "timeperiod"))).first()[0] == 24 - len(ends)


def test_closed_form_matches_definition_over_a_year(spark):
    """Every hour and day of a leap year against the definition written with plain integers."""
    def last(n, stem, upper):
        for i in range(1, upper):
            if stem <= i * n <= upper:
                return i * n
        return upper

    start = datetime(2020, 1, 1)
    hours = [start + timedelta(hours=h) for h in range(0, 366 * 24, 5)]
    for n in (2, 7, 12, 23):
        check(
            spark,
            [(t.strftime("%Y%m%d%H"), t.strftime("%Y%m%d") + f"{last(n, t.hour, 23):02d}") for t in hours],
            lambda c, n=n: P.group_period("hourly", n, c),
        )
    days = [start + timedelta(days=d) for d in range(366)]
    for n in (2, 10, 28):
        pairs = []
        for t in days:
            end = (t.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
            pairs.append((t.strftime("%Y%m%d00"), t.strftime("%Y%m") + f"{last(n, t.day, end.day):02d}00"))
        check(spark, pairs, lambda c, n=n: P.group_period("daily", n, c))
