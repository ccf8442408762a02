"""Sessions from hits: one row per (domain, session_id).

A session has no gap rule and never ends, so its state is kept mergeable: minima,
maxima, sums and "last non-null" values as (ts, id, value) triples. The same three
steps serve batch and stream::

    partial_sessions(hits)   hits -> state rows       (map-side combine)
    merge_sessions(state)    state rows -> one per session
    finish_sessions(state)   state -> plain columns
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.operators.order import index_in_order

KEYS = ["domain", "session_id"]
LAST_VALUES = ("os", "browser", "language", "country")
_STATE_MAX = (*[f"{c}_at" for c in LAST_VALUES], "screen_at")


def _when_last(*present: str) -> Column:
    """(ts, id, values) where all values are present, else null: max() keeps the last."""
    known = F.lit(True)
    for c in present:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.struct("ts", "event_id", *present))


def partial_sessions(hits: DataFrame) -> DataFrame:
    """Fold hits into session state; order of arrival does not matter."""
    return hits.groupBy(*KEYS).agg(
        F.min(F.struct("ts", "event_id", "ip")).alias("first_at"),
        F.max("ts").alias("last_ts"),
        *[F.max(_when_last(c)).alias(f"{c}_at") for c in LAST_VALUES],
        F.max(_when_last("screen_x", "screen_y")).alias("screen_at"),
        F.count_if("is_page_view").alias("number_of_pageviews"),
        F.count(F.lit(1)).alias("number_of_entries"),
    )


def merge_sessions(state: DataFrame) -> DataFrame:
    """Combine state rows of the same session, in any order and any grouping."""
    return state.groupBy(*KEYS).agg(
        F.min("first_at").alias("first_at"),
        F.max("last_ts").alias("last_ts"),
        *[F.max(c).alias(c) for c in _STATE_MAX],
        F.sum("number_of_pageviews").alias("number_of_pageviews"),
        F.sum("number_of_entries").alias("number_of_entries"),
    )


def finish_sessions(state: DataFrame) -> DataFrame:
    """State to plain columns: hour label of the first hit, whole seconds to the last."""
    first = F.col("first_at.ts")
    return state.select(
        "domain",
        P.to_period(P.HOURLY, first).alias("timeperiod"),
        "session_id",
        F.col("first_at.ip").alias("ip"),
        *[F.col(f"{c}_at.{c}").alias(c) for c in LAST_VALUES],
        F.col("screen_at.screen_x").alias("screen_x"),
        F.col("screen_at.screen_y").alias("screen_y"),
        (P.epoch_seconds("last_ts") - P.epoch_seconds(first)).alias("total_duration"),
        "number_of_pageviews",
        "number_of_entries",
    )


def build_sessions(hits: DataFrame) -> DataFrame:
    return finish_sessions(partial_sessions(hits))


def session_entries(hits: DataFrame) -> DataFrame:
    """Hit times of each session in order, as long rows with an index from 0.

    A session may hold any share of all hits, so the list stays a table.
    """
    indexed = index_in_order(hits.select(*KEYS, "ts", "event_id"), KEYS, "ts", "event_id", name="entry_index")
    return indexed.select(*KEYS, "entry_index", P.to_period(P.REAL_TIME, "ts").alias("entry_timestamp"))


def nest_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions in document shape, without the entry times (see ``session_entries``)."""
    profile = ("ip", "os", "browser", "language", "country", "screen_x", "screen_y")
    history = ("total_duration", "number_of_pageviews", "number_of_entries")
    return sessions.select(
        "domain",
        "timeperiod",
        "session_id",
        F.struct(*profile).alias("user_profile"),
        F.struct(*history).alias("browsing_history"),
    )


def session_write_stats(batch: DataFrame, target: DataFrame) -> DataFrame:
    """How the hits of a batch reach the store: sessions created, and hits that update one.

    The first hit of an unknown session inserts it; every other hit updates a session.
    """
    per_session = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hits"))
    known = target.select(*KEYS).distinct().withColumn("known", F.lit(True))
    joined = per_session.join(known, KEYS, "left")
    inserts = F.count_if(F.col("known").isNull())
    return joined.agg(
        inserts.alias("inserts"),
        (F.coalesce(F.sum("hits"), F.lit(0)) - inserts).alias("updates"),
    )
