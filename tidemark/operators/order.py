"""Position of each row within its key, safe when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import period as P


def index_in_order(df: DataFrame, keys: list[str], ts: str, tie: str, *, name: str = "position") -> DataFrame:
    """Number the rows of each key from 0 by (``ts``, ``tie``).

    Every key is cut into days and seconds. Rows are numbered inside their second; the rows of
    earlier seconds of the day, and of earlier days, are added from count tables. So a task sorts
    the rows of one second of a key, the seconds of one of its days, or its days, however many rows
    the key has; the calendar bounds the last two. Every row is kept and every position is exact.
    A null time comes first.
    """
    seconds = P.epoch_seconds(ts)
    sliced = df.withColumn("_second", seconds)
    inside = Window.partitionBy(*keys, "_second").orderBy(ts, tie)
    numbered = sliced.withColumn("_row", F.row_number().over(inside) - 1)

    def earlier(part: list[str], order: str):
        rows = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(rows), F.lit(0))

    counts = sliced.groupBy(*keys, "_second").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.floor(F.col("_second") / 86400))
    in_day = counts.withColumn("_before", earlier([*keys, "_day"], "_second"))
    days = counts.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n")).withColumn("_days_before", earlier(keys, "_day")).drop("_n")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*keys, "_day"]]
    offsets = in_day.alias("o").join(days.alias("d"), same).select(*[F.col(f"o.{c}") for c in [*keys, "_second"]], (F.col("_before") + F.col("_days_before")).alias("_offset"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, "_second"]]
    placed = numbered.alias("n").join(offsets.alias("o"), same)
    position = (F.col("_row") + F.col("_offset")).cast("bigint")
    return placed.select(*[F.col(f"n.{c}") for c in df.columns], position.alias(name))
