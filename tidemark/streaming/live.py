"""Where streams of buckets go: files per micro-batch, read back as one table.

A micro-batch folds its own rows into sums per key and writes them to a folder named by its id, so
a replay after a failure rewrites the same rows. Readers add the sums up. Nothing waits in a state
store and no row is ever too late to count; how far the stream has come only says which buckets are
final. Compaction keeps the number of folders small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NEWEST = "newest_ts"


def start(stream: DataFrame, base: str, write: Callable[[DataFrame, int], None], *, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folder(spark: SparkSession, path: str):
    """A folder and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """Batches that have a folder under ``path``, in order."""
    at, fs = folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = folder(spark, path)
    fs.delete(at, True)


def write_sums(stream: DataFrame, base: str, keys: list[Column], sums: dict[str, Column], *, ts: str = "ts", available_now: bool = True) -> StreamingQuery:
    """Fold every micro-batch into ``sums`` per key and the newest time seen."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folded = batch.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()], F.max(ts).alias(NEWEST))
        folded.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    return start(stream, base, write, available_now=available_now)


def _rows(spark: SparkSession, base: str, compacted: int | None) -> DataFrame:
    rows = spark.read.parquet(f"{base}/rows")
    if compacted is None:
        return rows.drop("batch")
    return spark.read.parquet(f"{base}/compacted/upto={compacted}").unionByName(rows.where(F.col("batch") > compacted).drop("batch"))


def _merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in (*keys, NEWEST)]
    return rows.groupBy(*keys).agg(*sums, F.max(NEWEST).alias(NEWEST))


def read_live(spark: SparkSession, base: str, keys: list[str], compacted: int | None = None) -> DataFrame:
    """Every bucket as of the last finished batch."""
    return _merge(_rows(spark, base, compacted), keys).drop(NEWEST)


def read_final(
    spark: SparkSession, base: str, keys: list[str], end: Column, lateness_minutes: int, compacted: int | None = None
) -> DataFrame:
    """Buckets whose ``end`` lies so far behind the newest time seen that they count as closed."""
    rows = _rows(spark, base, compacted)
    newest = rows.agg(F.max(NEWEST)).scalar()
    zero = F.lit(0)
    closed = end <= newest - F.make_dt_interval(zero, zero, F.lit(lateness_minutes))
    return _merge(rows, keys).where(closed).drop(NEWEST)


def compact(spark: SparkSession, base: str, keys: list[str], upto: int, previous: int | None = None) -> None:
    """Merge batches up to ``upto`` (and a previous compaction) into one row per key."""
    rows = spark.read.parquet(f"{base}/rows").where(F.col("batch") <= upto)
    if previous is not None:
        earlier = spark.read.parquet(f"{base}/compacted/upto={previous}")
        rows = rows.where(F.col("batch") > previous).drop("batch").unionByName(earlier)
    else:
        rows = rows.drop("batch")
    _merge(rows, keys).write.mode("overwrite").parquet(f"{base}/compacted/upto={upto}")


def write_rows(stream: DataFrame, base: str, *, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a plain stream."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .option("path", f"{base}/rows")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_rows(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/rows")
