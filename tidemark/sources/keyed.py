"""Tables laid out by ranges of a unique key: a change rewrites the ranges it falls into, and no other file.

Under ``base`` lie ``data/version=V/range=R``, the rows of a range as version V left them, sorted by key,
with a Bloom filter and bounds of the key in each file, and ``index/version=V``, which names for every
range the version that holds it. A write reads the ranges of its own keys, writes them as a new version,
and adds an index at the end, so readers see all of a write or nothing; a write that stopped half way is
done over by the next. The index has a row per range and tells how many keys a range holds: ``width``, or,
where the first write would fill too many ranges of that width, a multiple of it (``MAX_RANGES``).

One writer at a time is assumed, as for any table without a lock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import writes

INDEX = "range string, version long, width long"


def _children(spark: SparkSession, path: str, name: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [n.removeprefix(f"{name}=") for n in found if n.startswith(f"{name}=")]


@dataclass(frozen=True)
class KeyedTable:
    """A table with one row per ``key``, a whole number; ranges hold ``width`` consecutive keys each, or a multiple of that."""

    base: str
    key: str
    width: int

    def _range(self, width: int) -> Column:
        return F.floor(F.col(self.key) / width).cast("bigint").cast("string")

    def _width(self, spark: SparkSession) -> int | None:
        """Keys of a range; unknown while no range is held."""
        row = self.index(spark).select("width").first()
        return row and (row[0] or self.width)  # an index without the column was written by width

    def _fitting(self, keys: DataFrame) -> int:
        """The least multiple of ``width`` that leaves few ranges, or ranges of many rows."""
        fine = keys.where(F.col(self.key).isNotNull()).groupBy(self._range(self.width).cast("bigint").alias("range")).agg(F.count(F.lit(1)).alias("n"))
        steps = [4**i for i in range(STEPS)]
        counts = [F.approx_count_distinct(F.floor(F.col("range") / x)).alias(str(x)) for x in steps]
        *ranges, rows = fine.agg(*counts, F.sum("n")).first()
        limit = max(MAX_RANGES, (rows or 0) // RANGE_ROWS)
        return self.width * next((x for x, n in zip(steps, ranges) if n <= limit), steps[-1])

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted(map(int, _children(spark, f"{self.base}/index", "version")))

    def index(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Which version holds each range, now or as of a version."""
        known = [v for v in self.versions(spark) if version is None or v <= version]
        return spark.read.schema(INDEX).parquet(f"{self.base}/index/version={known[-1]}") if known else spark.createDataFrame([], INDEX)

    def _rows(self, index: DataFrame, schema) -> DataFrame:
        """Rows of the ranges in a piece of the index; only their folders are listed."""
        paths = [f"{self.base}/data/version={v}/range={r}" for r, v in index.select("range", "version").collect()]
        spark = index.sparkSession
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema, version: int | None = None) -> DataFrame:
        """The whole table, now or as of a version that is still kept."""
        return self._rows(self.index(spark, version), schema)

    def _touched(self, df: DataFrame) -> list[str]:
        """Ranges that keys fall into: no more than there are ranges, however many keys."""
        width = self._width(df.sparkSession)
        if width is None:
            return []  # nothing is held
        return [r[0] for r in df.where(F.col(self.key).isNotNull()).select(self._range(width).alias("range")).distinct().collect()]

    def _held(self, spark: SparkSession, ranges: list[str], schema) -> DataFrame:
        return self._rows(self.index(spark).where(F.col("range").isin(*ranges)) if ranges else self.index(spark).where("false"), schema)

    def _commit(self, rows: DataFrame, replaced: list[str]) -> int:
        """Write ``rows`` as the new content of the ``replaced`` ranges; the index comes last."""
        spark = rows.sparkSession
        known = self.versions(spark)
        version = known[-1] + 1 if known else 0
        path = f"{self.base}/data/version={version}"
        width = self._width(spark) or self._fitting(rows)
        placed = rows.withColumn("range", self._range(width)).hint("rebalance", F.col("range")).sortWithinPartitions("range", self.key)
        writer = placed.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        writer.option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(min(width, RANGE_ROWS))).partitionBy("range").parquet(path)
        # a range that lost all its rows has no folder, and leaves the index
        fresh = spark.createDataFrame([(r, version, width) for r in _children(spark, path, "range")], INDEX)
        stays = self.index(spark)
        stays = stays.where(~F.col("range").isin(*replaced)) if replaced else stays
        stays.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/index/version={version}")
        return version

    def upsert(self, changes: DataFrame, order: list[str] | None = None) -> int:
        """Replace rows by key and add new ones; of several changes of a key the last by ``order`` wins. Null keys are left out."""
        changes = changes.where(F.col(self.key).isNotNull())
        ranges = self._touched(changes)
        return self._commit(writes.upsert(self._held(changes.sparkSession, ranges, changes.schema), changes, [self.key], order), ranges)

    def delete(self, keys: DataFrame, schema) -> int:
        """Remove the rows whose key is listed."""
        ranges = self._touched(keys)
        return self._commit(writes.delete_keys(self._held(keys.sparkSession, ranges, schema), keys, [self.key]), ranges)

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Add rows with new keys and return those refused, with a ``reason``: the key is held, repeated, or null.

        Of several new rows of a key the first by ``order`` goes in. Uniqueness is checked against the key
        column of the ranges that the rows fall into; the table is never grouped as a whole.
        """
        spark = rows.sparkSession
        keyed = rows.where(F.col(self.key).isNotNull())
        ranges = self._touched(keyed)
        held = self._held(spark, ranges, rows.schema)
        first = [F.col(c) for c in order] if order else [F.xxhash64(*rows.columns)]
        packed = F.struct(*rows.columns).alias("_row")
        asked = keyed.select(self.key, packed, F.struct(*first, F.xxhash64(*rows.columns), F.monotonically_increasing_id()).alias("_at"))
        path = f"{self.base}/asked/version={len(self.versions(spark))}"
        asked.write.mode("overwrite").parquet(path)  # which of equal rows is the first is settled here
        asked = spark.read.schema(asked.schema).parquet(path)
        once = asked.groupBy(self.key).agg(F.min("_at").alias("_first"))
        judged = asked.join(once, self.key).join(held.select(self.key).distinct().withColumn("_held", F.lit(True)), self.key, "left")
        reason = F.when(F.col("_held"), "held").when(F.col("_at") != F.col("_first"), "repeated")
        judged = judged.withColumn("reason", reason)
        taken = judged.where("reason is null").select("_row.*")
        refused = f"{self.base}/refused/version={len(self.versions(spark))}"
        none = rows.where(F.col(self.key).isNull()).withColumn("reason", F.lit("null"))
        judged.where("reason is not null").select("_row.*", "reason").unionByName(none).write.mode("overwrite").parquet(refused)
        self._commit(held.unionByName(taken), ranges)
        return spark.read.schema(none.schema).parquet(refused)

    def lookup(self, keys: DataFrame, schema) -> DataFrame:
        """Rows of the listed keys.

        Reads the files of their ranges only. Within those the least and greatest key asked bound the row
        groups, and while few keys are asked (``MAX_LISTED``) they reach the reader as a list, which its
        Bloom filters answer; more of them only decide in the join.
        """
        spark = keys.sparkSession
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        rows = self._held(spark, self._touched(keys), schema)
        listed = [r[0] for r in wanted.limit(MAX_LISTED + 1).collect()]
        if len(listed) <= MAX_LISTED:
            return rows.where(F.col(self.key).isin(*listed)) if listed else rows.where("false")
        low, high = wanted.agg(F.min(self.key), F.max(self.key)).first()
        return rows.where(F.col(self.key).between(low, high)).join(wanted, self.key, "left_semi")

    def vacuum(self, spark: SparkSession, keep: int = 1) -> int:
        """Remove ranges that none of the last ``keep`` versions names, and the older indexes."""
        versions = self.versions(spark)
        kept = {(r.range, r.version) for v in versions[-keep:] for r in self.index(spark, v).collect()}
        gone = 0
        for v in map(int, _children(spark, f"{self.base}/data", "version")):
            stale = [r for r in _children(spark, f"{self.base}/data/version={v}", "range") if (r, v) not in kept]
            writes.drop_buckets(spark, f"{self.base}/data/version={v}", stale, period="range")
            gone += len(stale)
        writes.drop_buckets(spark, f"{self.base}/index", [str(v) for v in versions[:-keep]], period="version")
        return gone


MAX_LISTED = 200  # keys that are sent to the reader by name
MAX_RANGES = 256  # of a first write, each a folder; more only if each then has RANGE_ROWS rows
RANGE_ROWS = 1_000_000
STEPS = 24  # widths tried, each four times the one before
