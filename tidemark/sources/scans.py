"""Scans of period-keyed tables.

Every filter compares a stored column with a literal, so it reaches the Parquet
reader (and prunes partitions where the table is partitioned by period).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import period as P


def _within(start: str | None, end: str | None, period: str, ts: str | None) -> Column:
    """Bucket bounds; on the time the bucket is derived from as well, where there is one.

    A filter on a derived text can't reach the files, a literal bound on the stored time can.
    """
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(period) >= start)
        test = test if ts is None else test & (F.col(ts) >= F.lit(P.moment(start)))
    if end is not None:
        test = test & (F.col(period) < end)
        test = test if ts is None else test & (F.col(ts) < F.lit(P.moment(end)))
    return test


def scan_periods(df: DataFrame, start: str, end: str, *, period: str = "timeperiod", ts: str | None = None) -> DataFrame:
    """Rows of the half-open bucket range; both bounds are mandatory.

    ``ts`` names the timestamp that the bucket is derived from, if it is.
    """
    if start is None or end is None:
        raise ValueError("a bucket range needs both bounds")
    return df.where(_within(start, end, period, ts))


def scan_keys(
    df: DataFrame,
    lo: int | str,
    hi: int | str,
    start: str | None = None,
    end: str | None = None,
    *,
    key: str = "id",
    period: str = "timeperiod",
    ts: str | None = None,
) -> DataFrame:
    """Rows of a closed key range; with both bucket bounds, rows outside them are dropped."""
    out = df.where(F.col(key).between(lo, hi))
    return out if start is None or end is None else scan_periods(out, start, end, period=period, ts=ts)


def key_bounds(df: DataFrame, start: str, end: str, *, key: str = "id", period: str = "timeperiod", ts: str | None = None) -> DataFrame:
    """One row with the lowest and highest key in a bucket range; fails when the range is empty."""
    bounds = scan_periods(df, start, end, period=period, ts=ts).agg(
        F.min(key).alias("lowest_key"), F.max(key).alias("highest_key")
    )
    return bounds.withColumn("lowest_key", _present("lowest_key", f"no rows in [{start} : {end})"))


def _present(name: str, message: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(message)))


def scan_since(df: DataFrame, since: str | None, *, period: str = "timeperiod", ts: str | None = None) -> DataFrame:
    """Rows at or after a bucket; all rows when no bucket is given."""
    return df if since is None else df.where(_within(since, None, period, ts))


def lookup(df: DataFrame, wanted: DataFrame, keys: list[str], *, strict: bool = False) -> DataFrame:
    """Rows whose composite key is among ``wanted``, for any number of keys at once.

    With ``strict`` a key that has no row fails the job, as a missed point lookup does.
    No broadcast is forced: Spark picks it from the measured size of ``wanted``.
    """
    _same_columns(df, wanted, keys)
    asked = wanted.select(*keys).distinct()
    if not strict:
        return df.join(asked, keys, "inner")
    found = df.withColumn("_found", F.lit(True)).join(asked, keys, "right")
    missing = F.concat(F.lit("no row for key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(missing))
    return found.where(checked).select(*df.columns)


def lookup_misses(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` that have no row."""
    _same_columns(df, wanted, keys)
    return wanted.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti")


def _same_columns(df: DataFrame, other: DataFrame, keys: list[str]) -> None:
    if not keys:
        raise ValueError("a key needs at least one column")
    for k in keys:
        if k not in df.columns or k not in other.columns:
            raise ValueError(f"key column {k} is missing")


def expire(df: DataFrame, ts_col: str, days: int, now: datetime) -> DataFrame:
    """Drop rows older than ``days`` days."""
    return df.where(F.col(ts_col) >= P.ntz(now) - F.make_dt_interval(F.lit(days)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count: empty when the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ledger_since(ledger: DataFrame, since: str, *, q: str = "time_qualifier", period: str = "timeperiod") -> DataFrame:
    """Ledger rows of every granularity since a day.

    Hours and days compare with the day itself, months and years with the month and
    year that hold it. The bounds are literals, one per granularity.
    """
    month = f"{since[:6]}0000"
    year = f"{since[:4]}000000"
    g, tp = F.col(q), F.col(period)
    fine = g.isin(P.HOURLY, P.DAILY) & (tp >= since)
    return ledger.where(fine | ((g == P.MONTHLY) & (tp >= month)) | ((g == P.YEARLY) & (tp >= year)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
