"""Calendar periods as native Column expressions.

A period is a fixed-width text key, so text order equals time order within one
granularity and range filters on a stored period column prune partitions::

    real time  YYYYMMDDHHmmSS      hour   YYYYMMDDHH
    day        YYYYMMDD00          month  YYYYMM0000      year  YYYY000000

Everything here stays inside whole-stage codegen: no UDF, no driver work.
Years are assumed to have four digits.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The granularity names stored in tables.
REAL_TIME = "_real_time"
BY_SCHEDULE = "_by_schedule"
HOURLY = "_hourly"
DAILY = "_daily"
MONTHLY = "_monthly"
YEARLY = "_yearly"

# Coarser granularities rank higher.
RANK = {YEARLY: 1000, MONTHLY: 900, DAILY: 800, HOURLY: 700}

# Largest grouping allowed per granularity.
MAX_GROUPING = {HOURLY: 23, DAILY: 28, MONTHLY: 12, YEARLY: 1}

CALENDAR = (YEARLY, MONTHLY, DAILY, HOURLY)


def qualifier(name: str) -> str:
    """Accept ``'daily'`` as well as the stored form ``'_daily'``."""
    known = (*CALENDAR, REAL_TIME, BY_SCHEDULE)
    q = name if name.startswith("_") else f"_{name}"
    if q not in known:
        raise ValueError(f"unknown granularity: {name}")
    return q


def _calendar(name: str) -> str:
    q = qualifier(name)
    if q not in RANK:
        raise ValueError(f"not a calendar granularity: {name}")
    return q


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(c: Column, start: int, length: int) -> Column:
    return F.substring(c, start, length).cast("int")


def _from_number(n: Column) -> Column:
    return n.cast("bigint").cast("string")


def _parts(c: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day, hour of any period; absent month and day count as 1."""
    return (
        _num(c, 1, 4),
        F.greatest(_num(c, 5, 2), F.lit(1)),
        F.greatest(_num(c, 7, 2), F.lit(1)),
        _num(c, 9, 2),
    )


def moment(period: str) -> datetime:
    """Start of a period given as plain text."""
    at = period.ljust(14, "0")
    return datetime(int(at[:4]), max(int(at[4:6]), 1), max(int(at[6:8]), 1), int(at[8:10]), int(at[10:12]), int(at[12:14]))


def at_start(c: Column | str) -> Column:
    """Start of any period, whatever its granularity."""
    return _at_start(_col(c))


def _at_start(c: Column) -> Column:
    """Start of any period, whatever its granularity."""
    year, month, day, hour = _parts(c)
    fine = F.length(c) > 10
    minute = F.when(fine, _num(c, 11, 2)).otherwise(F.lit(0))
    second = F.when(fine, _num(c, 13, 2)).otherwise(F.lit(0))
    return F.make_timestamp_ntz(year, month, day, hour, minute, second)


def _require(value: Column, ok: Column, source: Column, what: str) -> Column:
    message = F.concat(F.lit(f"not a {what} period: "), source)
    return F.when(ok | source.isNull(), value).otherwise(F.raise_error(message))


def digits(ts: Column) -> Column:
    """Timestamp as fourteen digits; reads the parts of a naive one as they stand."""
    day = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("bigint")
    clock = F.hour(ts) * 10000 + F.minute(ts) * 100 + F.second(ts)
    return F.lpad((day * 1000000 + clock).cast("string"), 14, "0")


def _epoch() -> Column:
    return F.make_timestamp_ntz(*[F.lit(n) for n in (1970, 1, 1, 0, 0, 0)])


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a naive timestamp as it stands."""
    return seconds_between(_epoch(), _col(ts))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one timestamp to another; naive ones are compared as they stand."""
    parts = [F.extract(F.lit(u), end - start).cast("bigint") * n for u, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60))]
    return parts[0] + parts[1] + parts[2] + F.floor(F.extract(F.lit("SECOND"), end - start)).cast("bigint")


def period_pattern(c: Column | str) -> Column:
    """Name the parts a period carries, as a date pattern with zeros for absent parts."""
    c = _col(c)

    def part(start: int, length: int, pattern: str) -> Column:
        piece = F.substring(c, start, length)
        return F.when(piece.rlike("[^0]"), F.lit(pattern)).otherwise(F.lit("0" * length))

    parts = F.concat(part(1, 4, "%Y"), part(5, 2, "%m"), part(7, 2, "%d"), part(9, 2, "%H"))
    return F.when(F.length(c) > 10, F.lit("%Y%m%d%H%M%S")).otherwise(parts)


def epoch_to_session(c: Column | str) -> Column:
    """Epoch seconds to a real-time period in UTC, whatever the session's time zone."""
    zero = F.lit(0)
    moment = _epoch() + F.make_dt_interval(zero, zero, zero, F.floor(_col(c)).cast("decimal(18,6)"))
    return digits(moment)


def session_to_epoch(c: Column | str) -> Column:
    """Real-time period in UTC to epoch seconds, whatever the session's time zone."""
    return seconds_between(_epoch(), _at_start(_col(c)))


def session_to_hour(c: Column | str) -> Column:
    """Real-time period to its hour; raises on text that is no real-time period."""
    return to_period(HOURLY, period_start(REAL_TIME, c))


def hour_to_day(c: Column | str) -> Column:
    return to_period(DAILY, period_start(HOURLY, c))


def day_to_month(c: Column | str) -> Column:
    return to_period(MONTHLY, period_start(DAILY, c))


def month_to_year(c: Column | str) -> Column:
    return to_period(YEARLY, period_start(MONTHLY, c))


def to_period(q: str, ts: Column | str) -> Column:
    """Timestamp to the period of granularity ``q`` that holds it."""
    q, ts = qualifier(q), _col(ts)
    if q == REAL_TIME:
        return digits(ts)
    number = F.year(ts).cast("bigint") * 1000000
    if q in (MONTHLY, DAILY, HOURLY):
        number = number + F.month(ts) * 10000
    if q in (DAILY, HOURLY):
        number = number + F.dayofmonth(ts) * 100
    if q == HOURLY:
        number = number + F.hour(ts)
    if q == BY_SCHEDULE:
        raise ValueError("a schedule has no calendar period")
    return _from_number(number)


def period_start(q: str, c: Column | str) -> Column:
    """Period to the timestamp it starts at; raises on a period of another shape."""
    q, c = qualifier(q), _col(c)
    shape = {
        REAL_TIME: r"^\d{14}$",
        HOURLY: r"^\d{10}$",
        DAILY: r"^\d{8}00$",
        MONTHLY: r"^\d{6}0000$",
        YEARLY: r"^\d{4}000000$",
    }
    if q not in shape:
        raise ValueError("a schedule has no calendar period")
    start = {DAILY: 7, HOURLY: 7, REAL_TIME: 7, MONTHLY: 5}.get(q)
    ok = c.rlike(shape[q])
    if start is not None:
        ok = ok & (F.substring(c, start, 2) != "00") & (F.substring(c, 5, 2) != "00")
    return _require(_at_start(c), ok, c, q.strip("_"))


def cast_period(q: str, c: Column | str) -> Column:
    """Period of any granularity to the period of granularity ``q`` at its start.

    Text slicing only, so it costs next to nothing inside a grouping key.
    """
    q, c = _calendar(q), _col(c)

    def first(start: int) -> Column:
        piece = F.substring(c, start, 2)
        return F.when(piece == "00", F.lit("01")).otherwise(piece)

    year = F.substring(c, 1, 4)
    if q == YEARLY:
        return F.concat(year, F.lit("000000"))
    if q == MONTHLY:
        return F.concat(year, first(5), F.lit("0000"))
    if q == DAILY:
        return F.concat(year, first(5), first(7), F.lit("00"))
    return F.concat(year, first(5), first(7), F.substring(c, 9, 2))


def coarsen_period(q: str, c: Column | str) -> Column:
    """Period to the same or a coarser granularity: its leading digits, zeros behind."""
    width = {HOURLY: 10, DAILY: 8, MONTHLY: 6, YEARLY: 4}[_calendar(q)]
    head = F.substring(_col(c), 1, width)
    return head if width == 10 else F.concat(head, F.lit("0" * (10 - width)))


def cast_period_by(q: Column | str, c: Column | str) -> Column:
    """``cast_period`` with the granularity taken from a column."""
    q = _col(q)
    out = F.when(q == HOURLY, cast_period(HOURLY, c))
    for name in (DAILY, MONTHLY, YEARLY):
        out = out.when(q == name, cast_period(name, c))
    return out


def shift_period(q: str, c: Column | str, delta: Column | int) -> Column:
    """Move a period by ``delta`` units of ``q``; months and years roll over."""
    q, c = _calendar(q), _col(c)
    delta = F.lit(delta) if isinstance(delta, int) else delta
    year, month, day, _ = _parts(c)
    if q == HOURLY:
        return to_period(q, _at_start(c) + F.make_dt_interval(F.lit(0), delta.cast("int")))
    if q == DAILY:
        return to_period(q, F.date_add(F.make_date(year, month, day), delta.cast("int")))
    if q == MONTHLY:
        months = year * 12 + month - 1 + delta
        return _from_number(F.floor(months / 12) * 1000000 + (F.pmod(months, F.lit(12)) + 1) * 10000)
    return _from_number((year + delta).cast("bigint") * 1000000)


def _width(q: Column) -> Column:
    widths = F.expr(f"map('{HOURLY}', 10, '{DAILY}', 8, '{MONTHLY}', 6, '{YEARLY}', 4)")
    return F.element_at(widths, q)


def coarsen_period_by(q: Column | str, c: Column | str) -> Column:
    """Period to the same or a coarser granularity taken from a column.

    Keeps the leading digits and refers to the period once, so generated code stays
    small where such expressions nest; ``cast_period_by`` also goes to finer ones.
    """
    return F.rpad(F.substring(_col(c), F.lit(1), _width(_col(q))), 10, "0")


def to_period_by(q: Column | str, ts: Column | str) -> Column:
    """``to_period`` with the granularity taken from a column."""
    return coarsen_period_by(q, F.date_format(_col(ts), "yyyyMMddHH"))


def shift_start_by(q: Column | str, c: Column | str, delta: Column | int) -> Column:
    """Start of the period ``delta`` units on, with the granularity taken from a column."""
    q, c = _col(q), _col(c)
    delta = (F.lit(delta) if isinstance(delta, int) else delta).cast("int")
    zero = F.lit(0)

    def units(name: str) -> Column:
        return F.when(q == name, delta).otherwise(zero)

    months = F.make_ym_interval(units(YEARLY), units(MONTHLY))
    return _at_start(c) + months + F.make_dt_interval(units(DAILY), units(HOURLY))


def shift_period_by(q: Column | str, c: Column | str, delta: Column | int) -> Column:
    """``shift_period`` with the granularity taken from a column."""
    return to_period_by(q, shift_start_by(q, c, delta))


def current_period(q: str, now: datetime | Column) -> Column:
    """Period holding ``now``; the clock is always an argument, one value per run."""
    return to_period(q, now if isinstance(now, Column) else ntz(now))


def current_period_by(q: Column | str, now: datetime | Column) -> Column:
    return to_period_by(q, now if isinstance(now, Column) else ntz(now))


def ntz(moment: datetime) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


# ---- running numbers -----------------------------------------------------------


def moment_number(q: str, at: datetime) -> int:
    """Running number of the period of ``q`` that holds a moment."""
    q = _calendar(q)
    if q == HOURLY:
        return int((at - datetime(1970, 1, 1)).total_seconds() // 3600)
    if q == DAILY:
        return (at - datetime(1970, 1, 1)).days
    return at.year * 12 + at.month - 1 if q == MONTHLY else at.year


def period_number(q: str, c: Column | str) -> Column:
    """Running number of the period of ``q`` that starts with a period of the same or a coarser granularity."""
    q = _calendar(q)
    year, month, day, hour = _parts(_col(c))
    if q in (HOURLY, DAILY):
        days = F.unix_date(F.make_date(year, month, day))
        return days * 24 + hour if q == HOURLY else days
    return year * 12 + month - 1 if q == MONTHLY else year


def period_number_by(q: Column | str, c: Column | str) -> Column:
    """``period_number`` with the granularity taken from a column."""
    return _by(_col(q), lambda name: period_number(name, c))


def numbered_period(q: str, n: Column) -> Column:
    """Period with a running number."""
    q, n = _calendar(q), n.cast("int")
    if q == HOURLY:
        return to_period(q, _epoch() + F.make_dt_interval(F.lit(0), n))
    if q == DAILY:
        return to_period(q, F.date_from_unix_date(n))
    if q == MONTHLY:
        return shift_period(q, F.lit("0000010000"), n)
    return F.concat(n.cast("string"), F.lit("000000"))


def numbered_period_by(q: Column | str, n: Column) -> Column:
    """``numbered_period`` with the granularity taken from a column."""
    return _by(_col(q), lambda name: numbered_period(name, n))


def _by(q: Column, of: Callable[[str], Column]) -> Column:
    out = F.when(q == HOURLY, of(HOURLY))
    for name in (DAILY, MONTHLY, YEARLY):
        out = out.when(q == name, of(name))
    return out


def child_numbers(parent: str, child: str, c: Column | str) -> tuple[Column, Column]:
    """Running numbers of the first and the last ``child`` period inside a period of ``parent``."""
    return period_number(child, c), period_number(child, shift_period(parent, c, 1)) - 1


def split_period(c: Column | str) -> Column:
    """Struct of year, month, day and hour as text; the period must have ten digits."""
    c = _col(c)
    parts = F.struct(
        F.substring(c, 1, 4).alias("year"),
        F.substring(c, 5, 2).alias("month"),
        F.substring(c, 7, 2).alias("day"),
        F.substring(c, 9, 2).alias("hour"),
    )
    return _require(parts, F.length(c) == 10, c, "ten-digit")


# ---- n-unit groups -------------------------------------------------------------


def check_grouping(q: str, n: int) -> str:
    """Reject a grouping that does not fit inside the parent unit."""
    q = _calendar(q)
    if not 1 <= n <= MAX_GROUPING[q]:
        raise ValueError(f"grouping {n} is outside 1..{MAX_GROUPING[q]} for {q}")
    return q


def _stem(q: str, c: Column) -> tuple[Column, Column]:
    """The number that is grouped, and the largest value it takes in its parent."""
    if q == HOURLY:
        return _num(c, 9, 2), F.lit(23)
    if q == DAILY:
        year, month, _, _ = _parts(c)
        return _num(c, 7, 2), F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return _num(c, 5, 2), F.lit(12)


def _with_stem(q: str, c: Column, stem: Column) -> Column:
    text = F.lpad(stem.cast("int").cast("string"), 2, "0")
    if q == HOURLY:
        return F.concat(F.substring(c, 1, 8), text)
    if q == DAILY:
        return F.concat(F.substring(c, 1, 6), text, F.substring(c, 9, 2))
    return F.concat(F.substring(c, 1, 4), text, F.substring(c, 7, 4))


def group_period(q: str, n: int, c: Column | str) -> Column:
    """Label of the n-unit group a period falls in: the group's last unit.

    Groups never cross the parent unit, so the last one may be short, and hour 00
    joins the first one.
    """
    q, c = check_grouping(q, n), _col(c)
    if n == 1:
        return c
    stem, upper = _stem(q, c)
    end = F.least(F.greatest(F.ceil(stem / n), F.lit(1)) * n, upper)
    return _with_stem(q, c, end)


def group_start(q: str, n: int, c: Column | str) -> Column:
    """First period, inclusive, of the n-unit group a period falls in."""
    q, c = check_grouping(q, n), _col(c)
    if n == 1:
        return c
    stem, _ = _stem(q, c)
    first = F.floor((F.greatest(stem, F.lit(1)) - 1) / n) * n + 1
    if q == HOURLY:
        first = F.when(first == 1, F.lit(0)).otherwise(first)
    return _with_stem(q, c, first)


def group_end(q: str, c: Column | str) -> Column:
    """First period after this one: the exclusive end of a bucket."""
    return shift_period(q, c, 1)


def is_between_group(q: str, n: int, c: Column | str) -> Column:
    """True when a period is not the label of its n-unit group."""
    return group_period(q, n, c) != _col(c)


def fold_by_group(
    df: DataFrame, q: str, n: int, order: str, *, period: str = "timeperiod", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Keep the last row written per n-unit group, relabelled with the group.

    A single ``max_by`` with map-side combine, so a hot group never lands in one task.
    """
    values = [c for c in df.columns if c not in (period, *keys)]
    packed = F.max_by(F.struct(*values), F.col(order)).alias("_last")
    return (
        df.groupBy(*keys, group_period(q, n, period).alias(period))
        .agg(packed)
        .select(*keys, period, *[F.col(f"_last.{v}").alias(v) for v in values])
    )
