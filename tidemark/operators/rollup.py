"""Counters and histograms per (entity, bucket), and their roll-up through the calendar.

Counters live in one row per (entity, bucket). Histograms live in a long table
(entity, bucket, family, key, cnt), which merges with a plain sum, combines map-side
and spills; maps are packed only at the edge. Both are sums, so any coarser level may
be computed from any finer one with a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions.text import screen_label

COUNTERS = ("number_of_visits", "number_of_pageviews", "total_duration")
FAMILIES = ("os", "browser", "screen_resolution", "language", "country")


@dataclass(frozen=True)
class AggSpec:
    """A declared aggregation: key expressions, sums, and histogram keys.

    ``keys`` and ``measures`` map output names to Columns; every measure is an aggregate.
    ``families`` maps a family name to the Column whose values are counted.
    ``finish`` is applied to the counter table at the end.
    """

    keys: dict[str, Column]
    measures: dict[str, Column]
    families: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] | None = None

    def counters(self, df: DataFrame) -> DataFrame:
        keys = [c.alias(n) for n, c in self.keys.items()]
        out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in self.measures.items()])
        return out if self.finish is None else out.transform(self.finish)

    def histograms(self, df: DataFrame) -> DataFrame:
        return histogram(df, self.keys, self.families)


def run_spec(df: DataFrame, spec: AggSpec) -> tuple[DataFrame, DataFrame | None]:
    """Counter table and, where families are declared, histogram table."""
    return spec.counters(df), spec.histograms(df) if spec.families else None


def histogram(df: DataFrame, keys: dict[str, Column], families: dict[str, Column]) -> DataFrame:
    """Count the non-null values of several columns in one pass, as long rows."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("family"), c.cast("string").alias("key")) for n, c in families.items()]
    )
    rows = df.select(*[c.alias(n) for n, c in keys.items()], F.inline(pairs))
    return rows.where("key is not null").groupBy(*keys, "family", "key").agg(F.count(F.lit(1)).alias("cnt"))


def site_hourly_spec() -> AggSpec:
    return AggSpec(
        keys={"domain": F.col("domain"), "timeperiod": F.col("timeperiod")},
        measures={
            "number_of_visits": F.count(F.lit(1)),
            "number_of_pageviews": F.sum("number_of_pageviews"),
            "total_duration": F.sum("total_duration"),
        },
        families={
            "os": F.col("os"),
            "browser": F.col("browser"),
            "screen_resolution": screen_label("screen_x", "screen_y"),
            "language": F.col("language"),
            "country": F.col("country"),
        },
    )


def site_hourly(sessions: DataFrame) -> DataFrame:
    return site_hourly_spec().counters(sessions)


def site_hourly_histograms(sessions: DataFrame) -> DataFrame:
    return site_hourly_spec().histograms(sessions)


def _sum_levels(df: DataFrame, keys: list[str], values: Iterable[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def rollup_periods(df: DataFrame, q: str, *, period: str = "timeperiod", values: Iterable[str] = COUNTERS) -> DataFrame:
    """Sum a counter table of any finer level into buckets of ``q``."""
    values = list(values)
    keys = [c for c in df.columns if c not in values]
    return _sum_levels(df.withColumn(period, P.coarsen_period(q, period)), keys, values)


def rollup_histograms(df: DataFrame, q: str, *, period: str = "timeperiod") -> DataFrame:
    """Sum a histogram table of any finer level into buckets of ``q``."""
    return rollup_periods(df, q, period=period, values=("cnt",))


def rollup_chain(
    df: DataFrame, levels: Iterable[str], *, period: str = "timeperiod", values: Iterable[str] = COUNTERS, store: str | None = None
) -> dict[str, DataFrame]:
    """Tables of several levels, each summed from the next finer one.

    With ``store``, a folder of its own, each level is written there and the next reads it, so the source
    is read once and each level has one shuffle. Without it the tables are plans, and using several of
    them computes the finer levels again.
    """
    ordered = sorted((P.qualifier(q) for q in levels), key=lambda q: P.RANK[q])
    tables: dict[str, DataFrame] = {}
    for q in ordered:
        df = rollup_periods(df, q, period=period, values=values)
        if store:
            df.write.parquet(f"{store}/{q}")
            df = df.sparkSession.read.schema(df.schema).parquet(f"{store}/{q}")
        tables[q] = df
    return {q: tables[q] for q in reversed(ordered)}


def rollup_levels(
    df: DataFrame, levels: Iterable[str], *, period: str = "timeperiod", values: Iterable[str] = COUNTERS
) -> DataFrame:
    """All levels in one table and one shuffle, told apart by ``time_qualifier``."""
    values = list(values)
    levels = sorted((P.qualifier(q) for q in levels), key=lambda q: -P.RANK[q])
    tagged = F.array(
        *[F.struct(F.lit(q).alias("time_qualifier"), P.coarsen_period(q, period).alias("tp")) for q in levels]
    )
    other = [c for c in df.columns if c not in (period, *values)]
    rows = df.select(*other, *values, F.inline(tagged)).withColumnRenamed("tp", period)
    return _sum_levels(rows, [*other, "time_qualifier", period], values)


def parent_level(levels: Iterable[str], q: str) -> str | None:
    """Next coarser level of a chain."""
    coarser = [x for x in levels if P.RANK[P.qualifier(x)] > P.RANK[P.qualifier(q)]]
    return min(coarser, key=lambda x: P.RANK[P.qualifier(x)], default=None)


def child_level(levels: Iterable[str], q: str) -> str | None:
    """Next finer level of a chain."""
    finer = [x for x in levels if P.RANK[P.qualifier(x)] < P.RANK[P.qualifier(q)]]
    return max(finer, key=lambda x: P.RANK[P.qualifier(x)], default=None)


# ---- maps at the edge ------------------------------------------------------------


def unpack_maps(df: DataFrame, keys: list[str], maps: dict[str, Column]) -> DataFrame:
    """Map columns to long histogram rows."""

    def entries(family: str, c: Column) -> Column:
        return F.transform(
            F.map_entries(c),
            lambda e: F.struct(F.lit(family).alias("family"), e["key"].alias("key"), e["value"].alias("cnt")),
        )

    parts = [entries(n, c) for n, c in maps.items()]
    filled = [F.coalesce(p, F.array().cast("array<struct<family:string,key:string,cnt:bigint>>")) for p in parts]
    rows = df.select(*keys, F.explode(F.concat(*filled)).alias("_e"))
    return rows.select(*keys, "_e.family", "_e.key", "_e.cnt")


def sum_maps(df: DataFrame, keys: list[str], maps: dict[str, Column]) -> DataFrame:
    """Merge map columns over groups, adding the values of shared keys, as long rows."""
    return unpack_maps(df, keys, maps).groupBy(*keys, "family", "key").agg(F.sum("cnt").alias("cnt"))


def add_maps(a: Column, b: Column) -> Column:
    """Merge two maps of the same row."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def pack_maps(histograms: DataFrame, keys: list[str], families: Iterable[str] = FAMILIES) -> DataFrame:
    """Long histogram rows to one map per family, sorted by key.

    The rows are already summed, so a map holds one entry per distinct value.
    """
    entry = F.struct("key", "cnt")
    return histograms.groupBy(*keys).agg(
        *[
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("family") == f, entry)))).alias(f)
            for f in families
        ]
    )


def nest_statistics(counters: DataFrame, histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Document shape: the keys and one ``stat`` struct of counters and maps."""
    packed = pack_maps(histograms, keys)
    none = F.create_map().cast("map<string,bigint>")
    stat = [F.col(c) for c in COUNTERS] + [F.coalesce(F.col(f), none).alias(f) for f in FAMILIES]
    return counters.join(packed, keys, "left").select(*keys, F.struct(*stat).alias("stat"))
