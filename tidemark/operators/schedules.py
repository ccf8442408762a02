"""Schedules as rows: their entries, expected runs, and runs that did not happen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import schedule as X


def parse_schedule(df: DataFrame, col: str) -> DataFrame:
    """One row per schedule entry: kind, seconds for ``every``, day and time for ``at``."""
    text = X.checked(col)
    at = F.transform(
        X.entries(text),
        lambda e: F.struct(
            F.lit("at").alias("kind"),
            F.lit(None).cast("int").alias("every_seconds"),
            e["day"].alias("day"),
            e["hour"].alias("hour"),
            e["minute"].alias("minute"),
        ),
    )
    every = F.array(
        F.struct(
            F.lit("every").alias("kind"),
            X.interval_seconds(text).alias("every_seconds"),
            F.lit(None).cast("string").alias("day"),
            F.lit(None).cast("int").alias("hour"),
            F.lit(None).cast("int").alias("minute"),
        )
    )
    rows = df.select("*", F.explode(F.when(X.is_every(text), every).otherwise(at)).alias("_e"))
    return rows.select(*df.columns, "_e.*")


def next_trigger(df: DataFrame, ts: str, schedule: str, *, last_run: str | None = None) -> DataFrame:
    """Adds ``next_trigger`` to each row."""
    return df.withColumn("next_trigger", X.next_trigger(ts, schedule, last_run))


def expected_runs(schedules: DataFrame, schedule: str, lo: datetime, hi: datetime) -> DataFrame:
    """Minutes in ``[lo, hi)`` at which each schedule fires, each minute once.

    An ``every N`` schedule counts from ``lo``. Days and steps come from generators on the row of the
    schedule. Equal schedules are made one before they become runs; no two runs are compared across rows.
    """
    start, end = P.ntz(lo), P.ntz(hi)
    keys = schedules.columns
    session = schedules.sparkSession
    # a row is small and becomes thousands: rows are dealt by number, as their bytes would leave one task
    once = schedules.distinct().repartition(int(session.conf.get("spark.sql.shuffle.partitions")))
    text = X.checked(schedule)
    zero = F.lit(0)
    # an entry past midnight can meet one of the next day: the minutes of a row are made distinct as one
    # array, which the days of the range and the entries of the text bound
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))

    def on_day(day):
        fires = F.filter("_entries", lambda e: (e["day"] == X.EVERY_DAY) | (F.weekday(day) == F.try_to_number(e["day"], F.lit("9")).cast("int")))
        return F.transform(fires, lambda e: day.cast("timestamp_ntz") + F.make_dt_interval(zero, e["hour"], e["minute"]))

    minutes = F.array_distinct(F.flatten(F.transform(days, on_day)))
    at = once.where(~X.is_every(text)).withColumn("_entries", X.entries(text)).select(*keys, F.explode(minutes).alias("expected_at"))
    # runs of an interval are numbered from 1; each day holds a short range of numbers
    first = F.greatest(F.ceil(F.col("_d") * 86400 / F.col("_step")), F.lit(1))
    last = F.ceil((F.col("_d") + 1) * 86400 / F.col("_step")) - 1
    minute = lambda n: F.floor((n * F.col("_step") + lo.second) / 60)
    every = (
        once.where(X.is_every(text))
        .withColumn("_step", X.interval_seconds(text))
        .withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(max((hi - lo).days, 0)))))
        .withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("_n", F.explode(F.sequence("_first", "_last")))
        # runs follow each other, so the run before tells whether their minute came already
        .where((F.col("_n") == 1) | (minute(F.col("_n") - 1) < minute(F.col("_n"))))
        .withColumn("expected_at", start + F.make_dt_interval(zero, zero, zero, (F.col("_n") * F.col("_step")).cast("decimal(18,6)")))
    )
    both = at.unionByName(every.select(*keys, "expected_at"))
    inside = both.where((F.col("expected_at") >= start) & (F.col("expected_at") < end))
    return inside.withColumn("expected_at", F.date_trunc("minute", "expected_at").cast("timestamp_ntz"))


def missed_runs(expected: DataFrame, actual: DataFrame, keys: list[str], ts: str, lo: datetime, hi: datetime) -> DataFrame:
    """Expected runs without an event in their minute; only events in ``[lo, hi)`` are read."""
    inside = actual.where((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi)))
    seen = inside.select(*keys, F.date_trunc("minute", ts).cast("timestamp_ntz").alias("expected_at")).distinct()
    return expected.join(seen, [*keys, "expected_at"], "left_anti")
