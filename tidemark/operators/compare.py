"""Comparison of a bucket with an earlier one, and the step from sites to their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.operators.rollup import COUNTERS

ALERT_MEASURES = ("number_of_visits", "number_of_pageviews")


def _with_baseline(df: DataFrame, lag: int, keys: list[str], measures: tuple[str, ...], q: str) -> DataFrame:
    """Buckets beside the bucket ``lag`` units earlier, without joining the table to itself.

    Each row is sent to its own bucket and, as baseline, to the bucket ``lag`` units on;
    one aggregation brings the two together. The table is computed and read once.
    """
    own = F.struct(F.lit(True).alias("_own"), F.col("timeperiod").alias("_to"))
    ahead = F.struct(F.lit(False).alias("_own"), P.shift_period(q, "timeperiod", lag).alias("_to"))
    sent = df.select(*keys, *measures, F.inline(F.array(own, ahead)))
    now, old = F.col("_own"), ~F.col("_own")
    met = sent.groupBy(*keys, F.col("_to").alias("timeperiod")).agg(
        F.bool_or(now).alias("_here"),
        F.bool_or(old).alias("_before"),
        *[F.max(F.when(now, F.col(m))).alias(m) for m in measures],
        *[F.max(F.when(old, F.col(m))).alias(f"_old_{m}") for m in measures],
    )
    return met.where("_here and _before")


def _zero_baseline(measures: tuple[str, ...]) -> Column:
    zero = F.lit(False)
    for m in measures:
        zero = zero | (F.col(f"_old_{m}") == 0)
    return zero


def period_alert(
    df: DataFrame,
    lag: int = 7,
    lo: float = 0.8,
    hi: float = 1.2,
    *,
    keys: tuple[str, ...] = ("domain",),
    measures: tuple[str, ...] = ALERT_MEASURES,
    q: str = P.DAILY,
) -> DataFrame:
    """Buckets whose measures left the band around the bucket ``lag`` units earlier.

    Bounds are strict; the output holds the differences. A bucket without a baseline
    gives no row, nor does a zero baseline, which ``alert_rejects`` lists.
    """
    joined = _with_baseline(df, lag, list(keys), measures, q).where(~_zero_baseline(measures))
    crossed = F.lit(False)
    for m in measures:
        ratio = F.try_divide(F.col(m).cast("double"), F.col(f"_old_{m}").cast("double"))
        crossed = crossed | (ratio < lo) | (ratio > hi)
    return joined.where(crossed).select(
        *keys, "timeperiod", *[(F.col(m) - F.col(f"_old_{m}")).alias(m) for m in measures]
    )


def alert_rejects(
    df: DataFrame,
    lag: int = 7,
    *,
    keys: tuple[str, ...] = ("domain",),
    measures: tuple[str, ...] = ALERT_MEASURES,
    q: str = P.DAILY,
) -> DataFrame:
    """Buckets that cannot be compared because a baseline measure is zero."""
    joined = _with_baseline(df, lag, list(keys), measures, q)
    return joined.where(_zero_baseline(measures)).select(*keys, "timeperiod")


def assign_owner(df: DataFrame, owners: DataFrame, *, key: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Rows with their owner, and the rows whose key has none.

    A key that two owners claim counts for both; ``duplicate_keys`` reports such keys. Owners may be
    many, so no broadcast is forced: Spark decides by size.
    """
    return df.join(owners, key), df.join(owners, key, "left_anti")


def client_daily(site_daily: DataFrame, owners: DataFrame, *, owner: str = "client_id") -> DataFrame:
    """Owner counters per day; each owner has one share of the sites and may own most of them."""
    owned, _ = assign_owner(site_daily, owners.select("domain", owner))
    return owned.groupBy(owner, P.coarsen_period(P.DAILY, "timeperiod").alias("timeperiod")).agg(
        *[F.sum(c).alias(c) for c in COUNTERS]
    )


def client_daily_histograms(site_daily: DataFrame, owners: DataFrame, *, owner: str = "client_id") -> DataFrame:
    owned, _ = assign_owner(site_daily, owners.select("domain", owner))
    return owned.groupBy(owner, P.coarsen_period(P.DAILY, "timeperiod").alias("timeperiod"), "family", "key").agg(
        F.sum("cnt").alias("cnt")
    )
