"""Buckets kept up to date from streams: live, final, and late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.operators.ledger import cap_events, propagate_dirty
from tidemark.plans.catalog import Catalog
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import live

LATENESS_MINUTES = 5  # Fixed value: lateness allowed before a bucket closes.


def stream_rollup(
    stream: DataFrame,
    q: str,
    base: str,
    *,
    keys: tuple[str, ...] = ("domain",),
    measures: dict[str, Column],
    ts: str = "ts",
) -> StreamingQuery:
    """Calendar buckets of a stream, of any granularity; ``measures`` are counts or sums.

    Rows count whenever they arrive. ``live.read_live`` reads every bucket as it stands, ``read_final``
    those that are closed.
    """
    return live.write_sums(stream, base, [*map(F.col, keys), P.to_period(q, ts).alias("timeperiod")], measures, ts=ts)


def read_final(spark: SparkSession, q: str, base: str, *, keys: tuple[str, ...] = ("domain",), lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    """Buckets whose end and lateness the stream has passed."""
    end = P.shift_start_by(F.lit(P.qualifier(q)), "timeperiod", 1)
    return live.read_final(spark, base, [*keys, "timeperiod"], end, lateness_minutes)


def late_to_dirty(
    touched: DataFrame, catalog: Catalog, ledger: DataFrame, *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Buckets to redo because rows arrived for finished ones: they, ancestors and dependents."""
    done = ledger.where(S.is_finished("state"))
    late = touched.join(done, [*by, "process_name", "timeperiod"], "left_semi")
    return propagate_dirty(late, catalog, ledger, by=by)


def stream_late_to_dirty(
    touched: DataFrame,
    catalog: Catalog,
    ledger: Callable[[], DataFrame],
    base: str,
    *,
    by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Per micro-batch, the buckets to redo, written under the batch id (a replay rewrites it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # ancestors of a bucket lie between the start of its year and the bucket itself
        low, high = batch.agg(F.min("timeperiod"), F.max("timeperiod")).first()
        near = ledger().where(F.col("timeperiod").between(P.coarsen_period(P.YEARLY, F.lit(low)), F.lit(high)))
        dirty = late_to_dirty(batch, catalog, near, by=by)
        dirty.write.mode("overwrite").parquet(f"{base}/dirty/batch={batch_id}")

    return (
        touched.writeStream.option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def recompute_buckets(
    source: DataFrame,
    dirty: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    *,
    by: tuple[str, ...],
    period: Column,
    q: str | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Recompute whole buckets: source rows of the dirty ones only, then the operator.

    With the granularity and the time the buckets are derived from, the first and last dirty bucket
    bound the rows that are read.
    """
    marked = dirty.select(*by, F.col("timeperiod").alias("_bucket")).distinct()
    if q is not None and ts is not None:
        first = dirty.agg(P.at_start(F.min("timeperiod"))).scalar()
        last = dirty.agg(P.shift_start_by(F.lit(P.qualifier(q)), F.max("timeperiod"), 1)).scalar()
        source = source.where((F.col(ts) >= first) & (F.col(ts) < last))
    rows = source.withColumn("_bucket", period).join(marked, [*by, "_bucket"], "left_semi").drop("_bucket")
    return compute(rows)


def deliver_requests(
    stream: DataFrame, stored: Callable[[], DataFrame], base: str, key: str = "attempt_id", width: int = 10_000
) -> StreamingQuery:
    """Requests that are to run: each once, and only if the store still holds it as requested.

    The state in a message may be old, so the stored one decides; of the store, only rows between the
    least and the greatest key of the batch are read. What earlier batches delivered is kept in a table by
    ranges of ``width`` keys, of which a batch reads and rewrites those that its keys fall into: its cost
    does not grow with what was ever delivered. A replayed batch delivers the same rows again to its own
    folder. Keys are whole numbers; a row without one is not delivered.
    """
    return live.start(stream, base, lambda batch, batch_id: _deliver(batch, batch_id, stored, base, key, width))


def _deliver(batch: DataFrame, batch_id: int, stored: Callable[[], DataFrame], base: str, key: str, width: int) -> None:
    spark = batch.sparkSession
    delivered = KeyedTable(f"{base}/delivered", key, width)
    schema = f"{key} {batch.schema[key].dataType.simpleString()}, batch long"
    once = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("_row")).select(key, "_row.*")
    once.write.mode("overwrite").parquet(f"{base}/asked/batch={batch_id}")
    once = spark.read.schema(once.schema).parquet(f"{base}/asked/batch={batch_id}")
    low, high = once.agg(F.min(key), F.max(key)).first()
    waiting = stored().where(S.is_requested("state") & F.col(key).between(low, high)).select(key).distinct()
    todo = once.join(waiting, key, "left_semi")
    earlier = delivered.lookup(once.select(key), schema).where(F.col("batch") < batch_id)
    todo = todo.join(earlier.select(key), key, "left_anti")
    todo.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")
    sent = spark.read.schema(todo.schema).parquet(f"{base}/rows/batch={batch_id}").select(key, F.lit(batch_id).cast("bigint").alias("batch"))
    delivered.upsert(sent)
    if batch_id % 10 == 9:
        delivered.vacuum(spark, keep=2)
    for old in live.batches(spark, f"{base}/asked"):
        if old < batch_id:
            live.remove(spark, f"{base}/asked/batch={old}")


def stream_throughput(stream: DataFrame, base: str, *, ts: str = "ts", ok: Column | str = "ok") -> StreamingQuery:
    """Successes and failures per minute of a stream; rows count whenever they arrive."""
    passed = F.col(ok) if isinstance(ok, str) else ok
    tick = F.concat(F.substring(P.to_period(P.REAL_TIME, ts), 1, 12), F.lit("00")).alias("tick")
    return live.write_sums(stream, base, [tick], {"success": F.count_if(passed), "failure": F.count_if(~passed)}, ts=ts)


def stream_throughput_levels(stream: DataFrame, base: str, *, ts: str = "ts", ok: Column | str = "ok") -> StreamingQuery:
    """Successes and failures per minute and per 24 hours, from one pass over the rows.

    A micro-batch folds its rows into minutes, and those minutes into days: a day never sees a row.
    """
    passed = F.col(ok) if isinstance(ok, str) else ok
    sums = {"success": F.count_if(passed), "failure": F.count_if(~passed)}

    def write(batch: DataFrame, batch_id: int) -> None:
        minutes = f"{base}/minutes/rows/batch={batch_id}"
        tick = F.date_trunc("minute", ts).cast("timestamp_ntz").alias("tick")
        batch.groupBy(tick).agg(*[c.alias(n) for n, c in sums.items()], F.max(ts).alias(live.NEWEST)).write.mode("overwrite").parquet(minutes)
        day = F.window("tick", "24 hours")["start"].alias("tick")
        days = batch.sparkSession.read.parquet(minutes).groupBy(day).agg(*[F.sum(n).alias(n) for n in sums], F.max(live.NEWEST).alias(live.NEWEST))
        days.write.mode("overwrite").parquet(f"{base}/days/rows/batch={batch_id}")

    return live.start(stream, base, write)


def stream_cap_events(stream: DataFrame, base: str, key: list[str], ts: str, tie: str, n: int) -> StreamingQuery:
    """The newest events per key of a stream, one more than ``n`` as in ``ledger.cap_events``.

    The newest of several sets are among the newest of each, so a micro-batch keeps only its own and a
    compaction those of many batches; no step looks at all events.
    """
    return live.start(stream, base, lambda batch, batch_id: cap_events(batch, key, ts, tie, n).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}"))


def read_cap_events(spark: SparkSession, base: str, key: list[str], ts: str, tie: str, n: int) -> DataFrame:
    kept = live.batches(spark, f"{base}/compacted")
    rows = spark.read.parquet(f"{base}/rows").where(F.col("batch") > (kept[-1] if kept else -1)).drop("batch")
    if kept:
        rows = rows.unionByName(spark.read.parquet(f"{base}/compacted/batch={kept[-1]}"))
    return cap_events(rows, key, ts, tie, n)


def compact_cap_events(spark: SparkSession, base: str, key: list[str], ts: str, tie: str, n: int) -> None:
    """Fold what all batches so far kept into one set, at most ``n`` + 1 events a key, and drop theirs."""
    done = live.batches(spark, f"{base}/rows")
    if not done:
        return
    read_cap_events(spark, base, key, ts, tie, n).write.mode("overwrite").parquet(f"{base}/compacted/batch={done[-1]}")
    for batch in done[:-1]:  # the last one may be replayed, and is left out by its number
        live.remove(spark, f"{base}/rows/batch={batch}")
    for old in live.batches(spark, f"{base}/compacted")[:-1]:
        live.remove(spark, f"{base}/compacted/batch={old}")
