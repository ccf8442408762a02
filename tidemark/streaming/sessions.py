"""Sessions from a stream of hits.

A session has no end, so keeping it in stream state would grow without bound or forget
late hits. Instead every micro-batch folds its own hits into session state rows and
writes them under its batch id; readers merge the state rows. A replayed batch rewrites
its own folder, so each hit counts once, and a lost executor costs one task.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import sessions as S
from tidemark.sources.envelope import HIT_KEYS, HIT_SCHEMA, split_bad_records
from tidemark.streaming import live


def _write_partials(hits: DataFrame, base: str, batch_id: int) -> None:
    S.partial_sessions(hits).write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")


def stream_sessions(hits: DataFrame, base: str, timeout_minutes: int | None = None, *, available_now: bool = True) -> StreamingQuery:
    """Start folding a stream of hits into the session table at ``base``.

    With ``timeout_minutes``, a session without a hit for so long, by the newest time seen, closes: its
    state moves from the open to the closed sessions, and batches no longer read it. Read those tables
    with ``read_open_sessions`` and ``read_closed_sessions``.
    """
    write = _write_partials if timeout_minutes is None else partial(_write_and_close, timeout_minutes=timeout_minutes)
    return live.start(hits, base, lambda batch, batch_id: write(batch, base, batch_id), available_now=available_now)


def _write_and_close(hits: DataFrame, base: str, batch_id: int, timeout_minutes: int) -> None:
    """The open sessions of the batch before, with the batch's hits, as open and closed ones of this batch.

    What is read is bounded by the sessions that are open. The generation before stays until the next
    batch is done, so a replay finds what the first attempt found.
    """
    spark = hits.sparkSession
    earlier = [b for b in live.batches(spark, f"{base}/open") if b < batch_id]
    state = S.partial_sessions(hits)
    if earlier:
        state = S.merge_sessions(state.unionByName(spark.read.parquet(f"{base}/open/batch={earlier[-1]}").drop(live.NEWEST)))
    merged = f"{base}/merged/batch={batch_id}"
    state.write.mode("overwrite").parquet(merged)
    state = spark.read.schema(state.schema).parquet(merged)
    # the clock stands beside every open session, and in a row of its own where none is open
    clocks = state.agg(F.max("last_ts").alias(live.NEWEST))
    if earlier:
        clocks = clocks.unionByName(spark.read.parquet(f"{base}/clock/batch={earlier[-1]}"))
    newest = clocks.agg(F.max(live.NEWEST)).scalar()
    clock = clocks.agg(F.max(live.NEWEST).alias(live.NEWEST))
    clock.coalesce(1).write.mode("overwrite").parquet(f"{base}/clock/batch={batch_id}")
    zero = F.lit(0)
    idle = F.col("last_ts") + F.make_dt_interval(zero, zero, F.lit(timeout_minutes)) <= newest
    state.where(idle).write.mode("overwrite").parquet(f"{base}/closed/batch={batch_id}")
    state.where(~idle).withColumn(live.NEWEST, newest).write.mode("overwrite").parquet(f"{base}/open/batch={batch_id}")
    for table in ("open", "clock", "merged"):
        for old in live.batches(spark, f"{base}/{table}"):
            if old < (earlier[-1] if earlier else batch_id):
                live.remove(spark, f"{base}/{table}/batch={old}")


def _open_state(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/open/batch={live.batches(spark, f'{base}/open')[-1]}").drop(live.NEWEST)


def read_open_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions that have not closed, with all hits since they were last closed, if ever."""
    return S.finish_sessions(_open_state(spark, base))


def read_closed_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions that are closed as of the last finished batch, whole.

    A late hit opens its session again for a while; such a session has a state row for each time it
    closed, which are merged here, and is left out while it is open.
    """
    closed = spark.read.parquet(f"{base}/closed").drop("batch")
    return S.finish_sessions(S.merge_sessions(closed).join(_open_state(spark, base).select(*S.KEYS), S.KEYS, "left_anti"))


def stream_messages(messages: DataFrame, base: str, *, available_now: bool = True) -> StreamingQuery:
    """The same from raw messages, with unusable ones kept in a dead-letter table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, dead = split_bad_records(batch, HIT_SCHEMA, HIT_KEYS)
        _write_partials(good, base, batch_id)
        dead.write.mode("overwrite").parquet(f"{base}/dead/batch={batch_id}")

    writer = (
        messages.writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_state(spark: SparkSession, base: str, compacted: int | None = None) -> DataFrame:
    """State rows written so far: several per session, or one per compaction plus later batches.

    ``batch`` is a partition column, so folders a compaction covers are never opened.
    """
    state = spark.read.parquet(f"{base}/state")
    if compacted is None:
        return state.drop("batch")
    later = state.where(F.col("batch") > compacted).drop("batch")
    return spark.read.parquet(f"{base}/compacted/upto={compacted}").unionByName(later)


def read_sessions(spark: SparkSession, base: str, compacted: int | None = None) -> DataFrame:
    """Sessions as of the last finished batch."""
    return S.finish_sessions(S.merge_sessions(session_state(spark, base, compacted)))


def read_dead_letters(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/dead").drop("batch")


def compact_sessions(spark: SparkSession, base: str, upto: int, previous: int | None = None) -> None:
    """Merge the state of batches up to ``upto`` (and a previous compaction) into one row per session."""
    state = spark.read.parquet(f"{base}/state").where(F.col("batch") <= upto)
    if previous is not None:
        earlier = spark.read.parquet(f"{base}/compacted/upto={previous}")
        state = state.where(F.col("batch") > previous).drop("batch").unionByName(earlier)
    else:
        state = state.drop("batch")
    S.merge_sessions(state).write.mode("overwrite").parquet(f"{base}/compacted/upto={upto}")
