"""Hours, days, months and years of a stream, rebuilt level by level inside each micro-batch.

A micro-batch adds to the hours that its rows fall in, however late they are. The day of each such hour
is then summed from its hours, the month from its days and the year from its months: only what a
change reaches is read and written. Buckets that are summed together share a folder: the hours of a day,
the days of a month, the months of a year. A folder that changes is written anew under the batch's
number and none is ever written over, so what a batch does not touch keeps its files.

Under ``base`` lie::

    <level>/batch=N/folder=F       the buckets of a folder as batch N left them
    ledger/batch=N                 every bucket so far: the batch that last changed it, the batch that closed it
    emitted/batch=N                rows of the buckets that batch N closed, each bucket once in a stream's life
    corrected/batch=N              buckets that batch N built anew although they had been closed before

A batch reads the ledger of the one before and writes its own last but one, so a replay does the same again
whatever it left behind. The ledger has a row per bucket of the calendar, and lists of buckets are all
that the driver ever sees.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import period as P
from tidemark.streaming import live

LEVELS = (P.HOURLY, P.DAILY, P.MONTHLY, P.YEARLY)
LATENESS_MINUTES = 5  # Fixed value: lateness allowed before a bucket closes.
LEDGER = "time_qualifier string, timeperiod string, version long, closed_in long, newest_ts timestamp_ntz"

FOLDERS = {P.HOURLY: P.DAILY, P.DAILY: P.MONTHLY, P.MONTHLY: P.YEARLY, P.YEARLY: P.YEARLY}
_DIGITS = {P.DAILY: 8, P.MONTHLY: 6, P.YEARLY: 4}

Versions = list[tuple[str, int]]  # folder and the batch that wrote it


def _ledger(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The last ledger written, or the last one before a batch; empty at the start."""
    known = [b for b in live.batches(spark, f"{base}/ledger") if before is None or b < before]
    if not known:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{base}/ledger/batch={known[-1]}")


def _held(spark: SparkSession, base: str, level: str, versions: Versions, schema: StructType) -> DataFrame:
    """Rows of the named folders; no other is listed or read."""
    if not versions:
        return spark.createDataFrame([], schema)
    paths = [f"{base}/{level}/batch={v}/folder={folder}" for folder, v in versions]
    return spark.read.schema(schema).parquet(*paths)


def _folders(ledger: DataFrame) -> dict[str, dict[str, int]]:
    """The newest version of every folder, by level."""
    folder = F.lit(None).cast("string")
    for level in LEVELS:
        folder = F.when(F.col("time_qualifier") == level, P.coarsen_period(FOLDERS[level], "timeperiod")).otherwise(folder)
    out: dict[str, dict[str, int]] = {level: {} for level in LEVELS}
    for level, name, version in ledger.groupBy("time_qualifier", folder.alias("folder")).agg(F.max("version")).collect():
        out[level][name] = version
    return out


def _some(versions: dict[str, int], folders: Iterable[str]) -> Versions:
    return [(f, versions[f]) for f in folders if f in versions]


def _coarser(level: str, buckets: Iterable[str]) -> list[str]:
    return sorted({tp[: _DIGITS[level]].ljust(10, "0") for tp in buckets})


class Cascade:
    """What the batches of one stream do to the tables under ``base``."""

    def __init__(self, base: str, keys: tuple[str, ...], measures: dict[str, Column], ts: str, lateness_minutes: int):
        self.base, self.keys, self.measures, self.ts, self.lateness = base, keys, measures, ts, lateness_minutes

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark, base = batch.sparkSession, self.base
        known = _ledger(spark, base, before=batch_id)
        folded = batch.groupBy(*self.keys, P.to_period(P.HOURLY, self.ts).alias("timeperiod")).agg(
            *[c.alias(n) for n, c in self.measures.items()], F.max(self.ts).alias(live.NEWEST)
        )
        delta = f"{base}/delta/batch={batch_id}"
        folded.write.mode("overwrite").parquet(delta)
        added = spark.read.schema(folded.schema).parquet(delta)
        newest = [r[0] for r in added.agg(F.max(live.NEWEST)).unionByName(known.agg(F.max(live.NEWEST).alias(f"max({live.NEWEST})"))).collect() if r[0]]
        if not newest:
            return
        schema = added.drop(live.NEWEST).schema
        changed: list[tuple[str, str, int]] = []
        versions = _folders(known)
        rows, touched = added.drop(live.NEWEST), [r[0] for r in added.select("timeperiod").distinct().collect()]
        for depth, level in enumerate(LEVELS):
            if depth:
                finer = _held(spark, base, LEVELS[depth - 1], [(f, batch_id) for f in folders], schema)
                touched = _coarser(level, touched)
                rows = finer.withColumn("timeperiod", P.coarsen_period(level, "timeperiod")).where(F.col("timeperiod").isin(*touched))
            folders = _coarser(FOLDERS[level], touched)
            before = _held(spark, base, level, _some(versions[level], folders), schema)
            # hours grow by what the batch brings; a coarser bucket is summed anew, and its like in the folder stay
            rows = rows.unionByName(before if depth == 0 else before.where(~F.col("timeperiod").isin(*touched)))
            sums = rows.groupBy(*self.keys, "timeperiod").agg(*[F.sum(n).cast(schema[n].dataType).alias(n) for n in self.measures])
            self._put(sums.select(*schema.names), level, batch_id)
            changed += [(level, tp, batch_id) for tp in touched]
        ledger = self._close(spark, known, changed, max(newest), batch_id)
        self._emit(spark, ledger, batch_id, schema)
        for old in live.batches(spark, f"{base}/delta"):
            if old < batch_id:
                live.remove(spark, f"{base}/delta/batch={old}")
        for old in live.batches(spark, f"{base}/ledger")[:-2]:
            live.remove(spark, f"{base}/ledger/batch={old}")

    def _put(self, rows: DataFrame, level: str, batch_id: int) -> None:
        placed = rows.withColumn("folder", P.coarsen_period(FOLDERS[level], "timeperiod")).hint("rebalance", F.col("folder"))
        placed.write.mode("overwrite").partitionBy("folder").parquet(f"{self.base}/{level}/batch={batch_id}")

    def _close(self, spark: SparkSession, known: DataFrame, changed: list, newest, batch_id: int) -> DataFrame:
        fresh = spark.createDataFrame(changed, "time_qualifier string, timeperiod string, version long")
        both = known.drop(live.NEWEST).unionByName(fresh, allowMissingColumns=True)
        one = both.groupBy("time_qualifier", "timeperiod").agg(F.max("version").alias("version"), F.min("closed_in").alias("closed_in"))
        zero, clock = F.lit(0), F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz")
        over = P.shift_start_by("time_qualifier", "timeperiod", 1) + F.make_dt_interval(zero, zero, F.lit(self.lateness)) <= clock
        closed = F.coalesce("closed_in", F.when(over, F.lit(batch_id)).cast("bigint"))
        path = f"{self.base}/ledger/batch={batch_id}"
        one.withColumns({"closed_in": closed, live.NEWEST: clock}).coalesce(1).write.mode("overwrite").parquet(path)
        return spark.read.schema(LEDGER).parquet(path)

    def _emit(self, spark: SparkSession, ledger: DataFrame, batch_id: int, schema: StructType) -> None:
        due = ledger.where(F.col("closed_in") == batch_id)
        out = spark.createDataFrame([], schema).withColumn("time_qualifier", F.lit(""))
        newest, closing = _folders(ledger), _folders(due)
        for level in LEVELS:
            if closing[level]:
                rows = _held(spark, self.base, level, _some(newest[level], closing[level]), schema)
                out = out.unionByName(rows.withColumn("time_qualifier", F.lit(level)))
        closed = out.join(due.select("time_qualifier", "timeperiod"), ["time_qualifier", "timeperiod"], "left_semi")
        closed.select(*schema.names, "time_qualifier").write.mode("overwrite").parquet(f"{self.base}/emitted/batch={batch_id}")
        again = ledger.where((F.col("version") == batch_id) & (F.col("closed_in") < batch_id))
        again.select("time_qualifier", "timeperiod").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/corrected/batch={batch_id}")


def stream_cascade(
    stream: DataFrame,
    base: str,
    *,
    keys: tuple[str, ...] = ("domain",),
    measures: dict[str, Column],
    ts: str = "ts",
    lateness_minutes: int = LATENESS_MINUTES,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep all four levels of ``measures`` (counts or sums) up to date, and close each bucket once.

    A bucket closes in the first batch that brings the newest time seen to its end plus the lateness;
    what it held then is emitted. Rows that come later still count: its levels are built anew and the
    bucket is listed as corrected, but not emitted again.
    """
    return live.start(stream, base, Cascade(base, keys, measures, ts, lateness_minutes).write, available_now=available_now)


def read_level(spark: SparkSession, base: str, q: str, schema: str) -> DataFrame:
    """Every bucket of a level as of the last finished batch; ``schema`` names its columns."""
    level = P.qualifier(q)
    return _held(spark, base, level, list(_folders(_ledger(spark, base))[level].items()), spark.createDataFrame([], schema).schema)


def read_emitted(spark: SparkSession, base: str) -> DataFrame:
    """Rows of closed buckets as they were when they closed, with the batch that closed them."""
    return spark.read.parquet(f"{base}/emitted")


def read_corrected(spark: SparkSession, base: str) -> DataFrame:
    """Buckets that were built anew after they had closed, by batch."""
    return spark.read.parquet(f"{base}/corrected")


def vacuum(spark: SparkSession, base: str) -> int:
    """Remove folders that neither of the last two ledgers names; the older one serves a replay of the last batch."""
    kept: set[tuple[str, str, int]] = set()
    for batch in live.batches(spark, f"{base}/ledger")[-2:]:
        ledger = spark.read.schema(LEDGER).parquet(f"{base}/ledger/batch={batch}")
        kept |= {(level, *version) for level, held in _folders(ledger).items() for version in held.items()}
    gone = 0
    for level in LEVELS:
        for batch in live.batches(spark, f"{base}/{level}"):
            folder, fs = live.folder(spark, f"{base}/{level}/batch={batch}")
            for status in fs.listStatus(folder):
                name = status.getPath().getName().removeprefix("folder=")
                if status.isDirectory() and (level, name, batch) not in kept:
                    fs.delete(status.getPath(), True)
                    gone += 1
    return gone
