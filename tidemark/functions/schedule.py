"""Schedule texts as Column expressions.

A schedule is ``every N`` (seconds) or ``at D-HH:MM, ...`` with D from 0 (Monday) to 6,
or ``*`` or nothing for every day. Everything is computed on the row: no join, no
shuffle, and no list of days to test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERY_DAY = "*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tidy(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def is_every(c: Column | str) -> Column:
    return _tidy(c).startswith("every ")


def is_at(c: Column | str) -> Column:
    return _tidy(c).startswith("at ")


def interval_seconds(c: Column | str) -> Column:
    """Seconds of an ``every N`` schedule, else null."""
    return F.when(is_every(c), F.substr(_tidy(c), F.lit(7)).cast("int"))


def entry_texts(c: Column | str) -> Column:
    """Entries of an ``at`` schedule as written, spaces removed, else null."""
    body = F.regexp_replace(F.regexp_replace(_tidy(c), r"^at ", ""), " ", "")
    return F.when(is_at(c), F.split(body, ","))


def entries(c: Column | str) -> Column:
    """Array of (day, hour, minute) of an ``at`` schedule; day is ``*`` or a digit."""

    def parse(text: Column) -> Column:
        dashed = F.contains(text, F.lit("-"))
        day = F.when(dashed, F.substring_index(text, "-", 1)).otherwise(F.lit(EVERY_DAY))
        clock = F.substring_index(text, "-", -1)
        return F.struct(
            day.alias("day"),
            F.substring_index(clock, ":", 1).cast("int").alias("hour"),
            F.substring_index(clock, ":", -1).cast("int").alias("minute"),
        )

    return F.transform(entry_texts(c), parse)


def checked(c: Column | str) -> Column:
    """The schedule text itself; raises on any other form."""
    text = _col(c)
    bad = F.raise_error(F.concat(F.lit("unknown schedule: "), text))
    return F.when(is_at(c) | is_every(c) | text.isNull(), text).otherwise(bad)


def _entry_next(ts: Column, entry: Column) -> Column:
    """Next time of one entry at or after ``ts``: a time of day that has passed, if only by
    seconds, counts from tomorrow; then the first matching weekday."""
    seconds_now = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    fraction = ts != F.date_trunc("second", ts)
    at = entry["hour"] * 3600 + entry["minute"] * 60
    passed = (seconds_now > at) | ((seconds_now == at) & fraction)
    start = F.date_add(F.to_date(ts), F.when(passed, 1).otherwise(0))
    wait = F.when(entry["day"] == EVERY_DAY, F.lit(0)).otherwise(
        F.pmod(F.try_to_number(entry["day"], F.lit("9")).cast("int") - F.weekday(start), F.lit(7))
    )
    day = F.date_add(start, wait).cast("timestamp_ntz")
    zero = F.lit(0)
    return day + F.make_dt_interval(zero, entry["hour"], entry["minute"])


def next_trigger(ts: Column | str, schedule: Column | str, last_run: Column | str | None = None) -> Column:
    """Next run after ``ts``: the earliest entry of an ``at`` schedule, or the last run
    (``ts`` where none is given) plus the seconds of an ``every`` schedule."""
    ts = _col(ts).cast("timestamp_ntz")
    last = ts if last_run is None else _col(last_run).cast("timestamp_ntz")
    zero = F.lit(0)
    step = F.make_dt_interval(zero, zero, zero, interval_seconds(schedule).cast("decimal(18,6)"))
    at = F.array_min(F.transform(entries(schedule), lambda e: _entry_next(ts, e)))
    return F.when(is_every(schedule), last + step).otherwise(at)
