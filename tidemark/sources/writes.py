"""Whole-row changes of keyed tables, and bucket writes.

The table-level functions return the changed table as a new DataFrame; writing it is
a separate step, always to new files, never over files the same job reads. The key sides
of semi and anti joins are made distinct first: that combines map-side, shuffles by the
join key anyway, and keeps a key with many copies from piling up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _in_turn(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """Held rows (turn 0) and new ones (turn 1) side by side, grouped by key: one shuffle, no join.

    New rows of one key follow each other by ``order``, or by a hash of the row where none is given.
    """
    columns = target.columns
    first = [F.col(c) for c in order] if order else [F.xxhash64(*columns)]
    rows = F.struct(*columns).alias("_row")
    nulls = target.select(*keys, rows, F.lit(0).alias("_turn"), *[F.lit(None).alias(f"_o{i}") for i in range(len(first))])
    new = changes.select(*keys, rows, F.lit(1).alias("_turn"), *[c.alias(f"_o{i}") for i, c in enumerate(first)])
    return nulls.unionByName(new).withColumn("_at", F.struct("_turn", *[f"_o{i}" for i in range(len(first))])).groupBy(*keys)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Replace whole rows by key and add the rows that are new. Of several changes of a key the last one wins."""
    last = _in_turn(target, changes, keys, order).agg(F.max_by("_row", "_at").alias("_row"))
    return last.select("_row.*")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` into those to insert and, for keys already taken, the row that is held.

    Of several new rows of a key the first is inserted; the others find it held.
    """
    held = _in_turn(target, rows, keys, order).agg(
        F.min_by("_row", "_at").alias("_row"), F.min("_turn").alias("_first"), F.sum("_turn").alias("_asked")
    )
    return held.where("_first = 1").select("_row.*"), held.where("_asked > _first").select("_row.*")


def delete_keys(target: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose key is listed."""
    return target.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Add messages to per-parent logs, starting a log where there is none.

    The log is a long table (parent, position, message): a parent may own any share of
    all messages, so its messages are never gathered into one array.
    """
    return log.unionByName(new)


def attach_log(log: DataFrame, parents: DataFrame, key: str = "parent_object_id") -> DataFrame:
    """Start the logs of ``parents`` afresh: their earlier messages go."""
    return log.join(parents.select(key).distinct(), key, "left_anti")


def write_buckets(df: DataFrame, path: str, *, period: str = "timeperiod", recomputed: DataFrame | None = None) -> None:
    """Overwrite exactly the buckets present in ``df``; running it twice changes nothing.

    ``recomputed`` lists the buckets that were computed anew: those of them that have no rows left
    are dropped. Their number is bounded by the calendar. Which buckets have rows is observed as they are
    written, so ``df`` is computed once. The rebalance hint sizes output files and splits a bucket that
    holds a large share of the rows over several tasks.
    """
    asked: set[str] = set()
    seen = Observation()
    if recomputed is not None:  # asked before writing: the list may come from the table itself
        asked = {r[0] for r in recomputed.select(period).distinct().collect()}
        df = df.observe(seen, F.collect_set(period).alias("buckets"))
    (
        df.hint("rebalance", F.col(period))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period)
        .parquet(path)
    )
    if asked:
        drop_buckets(df.sparkSession, path, sorted(asked - set(seen.get["buckets"])), period=period)


def drop_buckets(spark: SparkSession, path: str, buckets: list[str], *, period: str = "timeperiod") -> None:
    """Remove whole buckets of a bucket table."""
    for bucket in buckets:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{period}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bucket table with its key as text, so that ranges of buckets prune folders."""
    return spark.read.schema(schema).parquet(path)


def replace_table(df: DataFrame, base: str, version: str) -> str:
    """Write every row of a new definition as a version of its own and return its path."""
    path = f"{base}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{base}/version={version}")
