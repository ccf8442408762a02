"""Counts of successes and failures per tick, and statistics of one run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.sources.scans import scan_periods

TICK = "60 seconds"  # Fixed value: length of a counter tick.


def throughput(events: DataFrame, width: str = TICK, *, ts: str = "ts", ok: Column | str = "ok") -> DataFrame:
    """Successes and failures per tumbling window; pass ``24 hours`` for the daily counters."""
    ok = F.col(ok) if isinstance(ok, str) else ok
    return (
        events.groupBy(F.window(ts, width).alias("_w"))
        .agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"))
        .select(F.col("_w.start").alias("tick"), "success", "failure")
    )


@dataclass(frozen=True)
class RunStats:
    rows_read: int
    groups_written: int
    elapsed: float
    state: str
    error: str | None = None


@dataclass(frozen=True)
class RangeJob:
    """A job over one bucket range: ``fn(rows, start, end)`` gives the rows to write.

    Counts come with the write itself, so nothing is computed twice. A function that
    returns None did its own work and counts as processed; an exception marks the range
    invalid and is reported, not hidden.
    """

    fn: Callable[[DataFrame, str, str], DataFrame | None]
    write: Callable[[DataFrame], None]
    period: str = "timeperiod"
    ts: str | None = None  # the time the bucket is derived from, so that the bounds reach the files

    def run(self, source: DataFrame, start: str, end: str) -> RunStats:
        began = time.monotonic()
        read, written = Observation(), Observation()
        rows = scan_periods(source, start, end, period=self.period, ts=self.ts).observe(read, F.count(F.lit(1)).alias("n"))
        try:
            out = self.fn(rows, start, end)
            if out is None:
                return RunStats(0, 0, time.monotonic() - began, S.PROCESSED)
            self.write(out.observe(written, F.count(F.lit(1)).alias("n")))
        except Exception as e:
            return RunStats(0, 0, time.monotonic() - began, S.INVALID, str(e))
        return RunStats(read.get["n"], written.get["n"], time.monotonic() - began, S.PROCESSED)


def run_with_stats(df: DataFrame, fn: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> RunStats:
    """Run a transformation and its write over all rows of ``df``, counting both sides."""
    everything = RangeJob(lambda rows, *_: fn(rows.drop("_all")), write, period="_all")
    return everything.run(df.withColumn("_all", F.lit("0")), "0", "1")


def attempt_row(stats: RunStats, q: str, start: str) -> dict[str, object]:
    """The outcome of a run in the shape of an attempt."""
    return {
        "time_qualifier": P.qualifier(q),
        "start_timeperiod": start,
        "state": stats.state,
        "number_of_processed_documents": stats.rows_read,
        "number_of_aggregated_documents": stats.groups_written,
    }
