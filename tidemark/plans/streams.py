"""Queries run as streams over the events table; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.operators.ledger import refresh_targets
from tidemark.operators.sessions import session_write_stats
from tidemark.plans import views as V
from tidemark.plans.catalog import SITE_SUITE
from tidemark.plans.registry import query
from tidemark.sources import envelope, shared
from tidemark.streaming import buckets, cascade, live
from tidemark.streaming import sessions as SS


def _run(q) -> None:
    q.awaitTermination()


@query("stream_sessions", "SELECT * FROM sessions")
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-sessions")
    _run(SS.stream_sessions(V.hits(V.event_stream(spark, sf)), base))
    return SS.read_sessions(spark, base)


def _messages(spark, sf):
    """Each hit as a message; those from one country arrive cut short."""
    whole = envelope.to_envelope(V.hits(V.event_stream(spark, sf)))
    return whole.select(F.when(F.col("value").like('%"country":"c_3"%'), F.substring("value", 1, 60)).otherwise(F.col("value")).alias("value"))


@query("stream_good_messages", "SELECT domain, session_id, number_of_entries, number_of_pageviews FROM (SELECT domain, session_id, count(*) AS number_of_entries, count(*) FILTER (WHERE is_page_view) AS number_of_pageviews FROM hits WHERE country <> 'c_3' GROUP BY 1, 2)")
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-messages")
    _run(SS.stream_messages(_messages(spark, sf), base))
    return SS.read_sessions(spark, base).select("domain", "session_id", "number_of_entries", "number_of_pageviews")


@query(
    "stream_dead_letters",
    """SELECT h.event_id, 'hit' AS kind FROM hits h WHERE country = 'c_3'""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-dead")
    _run(SS.stream_messages(_messages(spark, sf), base))
    dead = SS.read_dead_letters(spark, base)
    number = F.regexp_extract("message", '"event_id":([0-9]+)', 1).cast("bigint")
    return dead.select(number.alias("event_id"), F.lit("hit").alias("kind"))


@query(
    "session_write_stats",
    """WITH known AS (SELECT DISTINCT domain, session_id FROM hits WHERE is_page_view), n AS (SELECT domain, session_id, count(*) AS hits FROM hits WHERE NOT is_page_view GROUP BY 1, 2)
       SELECT count(*) FILTER (WHERE k.domain IS NULL) AS inserts, CAST(sum(n.hits) - count(*) FILTER (WHERE k.domain IS NULL) AS BIGINT) AS updates
       FROM n LEFT JOIN known k ON k.domain = n.domain AND k.session_id = n.session_id""",
)
def _(spark, sf):
    hits = V.hits_of(spark, sf)
    return session_write_stats(hits.where(~F.col("is_page_view")), hits.where("is_page_view"))


def _rollup(spark, sf, q: str, base: str) -> None:
    measures = {"hits": F.count(F.lit(1)), "pageviews": F.count_if("is_page_view")}
    _run(buckets.stream_rollup(V.hits(V.event_stream(spark, sf)), q, base, measures=measures))


def _register_live(name: str, q: str, pattern: str) -> None:
    @query(
        name,
        f"SELECT domain, strftime(ts, '{pattern}') AS timeperiod, count(*) AS hits, count(*) FILTER (WHERE is_page_view) AS pageviews FROM hits GROUP BY 1, 2",
    )
    def _(spark, sf):
        base = shared.fresh_dir(spark, name)
        _rollup(spark, sf, q, base)
        live.compact(spark, base, ["domain", "timeperiod"], upto=1)
        return live.read_live(spark, base, ["domain", "timeperiod"], compacted=1)


_register_live("stream_site_hourly", P.HOURLY, "%Y%m%d%H")
_register_live("stream_site_daily", P.DAILY, "%Y%m%d00")


@query(
    "stream_final_daily",
    """SELECT domain, strftime(ts, '%Y%m%d00') AS timeperiod, count(*) AS hits, count(*) FILTER (WHERE is_page_view) AS pageviews FROM hits
       WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM hits) - INTERVAL 5 MINUTE GROUP BY 1, 2""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-final")
    _rollup(spark, sf, P.DAILY, base)
    return buckets.read_final(spark, P.DAILY, base)


_CASCADE = "domain string, hits long, pageviews long, timeperiod string"


def _cascade(spark, events, name: str) -> str:
    base = shared.fresh_dir(spark, name)
    measures = {"hits": F.count(F.lit(1)), "pageviews": F.count_if("is_page_view")}
    _run(cascade.stream_cascade(V.hits(events), base, measures=measures))
    return base


_LEVEL_SQL = (
    "SELECT '{q}' AS time_qualifier, domain, strftime(ts, '{pattern}') AS timeperiod, count(*) AS hits, "
    "count(*) FILTER (WHERE is_page_view) AS pageviews FROM hits {where} GROUP BY domain, strftime(ts, '{pattern}')"
)
_LEVEL_PATTERNS = ((P.HOURLY, "%Y%m%d%H", "hour"), (P.DAILY, "%Y%m%d00", "day"), (P.MONTHLY, "%Y%m0000", "month"), (P.YEARLY, "%Y000000", "year"))


@query("stream_cascade", " UNION ALL ".join(_LEVEL_SQL.format(q=q, pattern=p, where="") for q, p, _ in _LEVEL_PATTERNS))
def _(spark, sf):
    """All levels of a stream most of whose rows are late, each rebuilt from the next finer one."""
    base = _cascade(spark, V.event_stream(spark, sf), "stream-cascade")
    out = [cascade.read_level(spark, base, q, _CASCADE).withColumn("time_qualifier", F.lit(q)) for q in cascade.LEVELS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "stream_closed_once",
    " UNION ALL ".join(
        _LEVEL_SQL.format(q=q, pattern=p, where=f"WHERE date_trunc('{unit}', ts) + INTERVAL 1 {unit} <= (SELECT max(ts) FROM hits) - INTERVAL 5 MINUTE")
        for q, p, unit in _LEVEL_PATTERNS
    ),
)
def _(spark, sf):
    """What a stream in time order emits as its buckets close: each of them once, complete."""
    base = _cascade(spark, V.event_stream(spark, sf, in_order=True), "stream-closed")
    return cascade.read_emitted(spark, base).drop("batch")


@query(
    "stream_throughput",
    """SELECT strftime(date_trunc('minute', ts), '%Y%m%d%H%M%S') AS tick, count(*) FILTER (WHERE event_type <> 'error') AS success,
       count(*) FILTER (WHERE event_type = 'error') AS failure FROM ev GROUP BY 1""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-throughput")
    _run(buckets.stream_throughput(V.event_stream(spark, sf), base, ok=F.col("event_type") != "error"))
    return live.read_live(spark, base, ["tick"])


@query(
    "stream_closed_sessions",
    """SELECT s.* FROM sessions s JOIN (SELECT domain, session_id, max(ts) AS last_ts FROM hits GROUP BY 1, 2) USING (domain, session_id)
       WHERE last_ts + INTERVAL 720 MINUTE <= (SELECT max(ts) FROM hits)""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-closing")
    _run(SS.stream_sessions(V.hits(V.event_stream(spark, sf)), base, timeout_minutes=720))
    return SS.read_closed_sessions(spark, base)


@query("stream_through_messages", "SELECT * FROM sessions")
def _(spark, sf):
    """Hits written as messages by one stream and read as messages by another."""
    base = shared.fresh_dir(spark, "stream-through")
    _run(envelope.write_messages(V.hits(V.event_stream(spark, sf)), f"{base}/messages", f"{base}/sent"))
    _run(SS.stream_sessions(envelope.read_hits(spark, f"{base}/messages"), base))
    return SS.read_sessions(spark, base)


@query(
    "stream_throughput_day",
    """SELECT strftime(date_trunc('day', ts), '%Y%m%d%H') AS tick, count(*) FILTER (WHERE event_type <> 'error') AS success,
       count(*) FILTER (WHERE event_type = 'error') AS failure FROM ev GROUP BY 1""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-levels")
    _run(buckets.stream_throughput_levels(V.event_stream(spark, sf), base, ok=F.col("event_type") != "error"))
    days = live.read_live(spark, f"{base}/days", ["tick"])
    return days.select(P.to_period(P.HOURLY, "tick").alias("tick"), "success", "failure")


@query("stream_cap_events", "SELECT domain, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 129")
def _(spark, sf):
    base, by = shared.fresh_dir(spark, "stream-cap"), (["domain"], "ts", "event_id", 128)
    events = V.event_stream(spark, sf).select(V.domain().alias("domain"), "ts", "event_id")
    _run(buckets.stream_cap_events(events, base, *by))
    buckets.compact_cap_events(spark, base, *by)
    return buckets.read_cap_events(spark, base, *by).select("domain", "event_id")


@query("stream_dedupe", "SELECT attempt_id, process_name, timeperiod FROM attempts WHERE state = 'state_requested'")
def _(spark, sf):
    """Every attempt is asked for twice, as requested, whatever became of it; a copy comes in another batch."""
    attempts = V.attempts(V.event_stream(spark, sf))
    copies = F.inline(F.array(F.struct("attempt_id"), F.struct((F.col("attempt_id") + 1 - 3 * (F.col("attempt_id") % 3 == 2).cast("int")).alias("attempt_id"))))
    asked = attempts.select(copies)
    base = shared.fresh_dir(spark, "stream-dedupe")
    stored = V.attempts_of(spark, sf)
    _run(buckets.deliver_requests(asked, lambda: stored, base))
    sent = spark.read.parquet(f"{base}/rows").select("attempt_id")
    return sent.join(stored.select("attempt_id", "process_name", "timeperiod"), "attempt_id")


@query(
    "stream_late_to_dirty",
    f"""WITH late AS (SELECT DISTINCT l.domain, l.process_name, l.timeperiod FROM ledger l JOIN attempts a USING (domain, process_name, timeperiod)
          WHERE l.state IN ('state_processed', 'state_skipped', 'state_noop')),
        reach AS (SELECT * FROM late UNION SELECT r.domain, e.target, {V.cast_by('e.q', 'r.timeperiod')} FROM reach r JOIN (
            SELECT process_name, parent_process AS target, parent_qualifier AS q FROM procs WHERE parent_process IS NOT NULL
            UNION ALL SELECT w.depends_on, w.process_name, p.time_qualifier FROM waits w JOIN procs p ON p.process_name = w.process_name) e USING (process_name))
        SELECT r.domain, r.process_name, r.timeperiod, coalesce(l.state, 'state_embryo') AS state,
          CASE WHEN coalesce(l.state, 'state_embryo') = 'state_embryo' THEN 'none' ELSE 'reprocess' END AS action
        FROM reach r LEFT JOIN ledger l USING (domain, process_name, timeperiod)""",
)
def _(spark, sf):
    base = shared.fresh_dir(spark, "stream-late")
    touched = V.attempts(V.event_stream(spark, sf)).select("domain", "process_name", "timeperiod")
    _run(buckets.stream_late_to_dirty(touched, SITE_SUITE, lambda: V.ledger(spark, sf), base, by=("domain",)))
    return spark.read.parquet(f"{base}/dirty").drop("batch").distinct()


@query(
    "stream_refresh_targets",
    """SELECT a.attempt_id, a.domain, a.process_name, a.timeperiod, 'client_daily' AS target FROM attempts a
       WHERE a.process_name = 'site_daily' AND a.state IN ('state_processed', 'state_noop')""",
)
def _(spark, sf):
    status = V.attempts(V.event_stream(spark, sf))
    base = shared.fresh_dir(spark, "stream-targets")
    targets = refresh_targets(status, SITE_SUITE, by=("attempt_id", "domain"))
    _run(live.write_rows(targets, base))
    return live.read_rows(spark, base)


@query(
    "recompute_late_buckets",
    """WITH hot AS (SELECT DISTINCT domain, strftime(ts, '%Y%m%d00') AS timeperiod FROM ev WHERE event_type = 'signup')
       SELECT h.domain, h.timeperiod, count(*) AS hits, count(DISTINCT session_id) AS visits FROM
       (SELECT *, strftime(ts, '%Y%m%d00') AS timeperiod FROM hits) h JOIN hot USING (domain, timeperiod) GROUP BY 1, 2""",
)
def _(spark, sf):
    events = V.table(spark, sf, "events").where("event_type = 'signup'")
    dirty = events.select(V.domain().alias("domain"), P.to_period(P.DAILY, "ts").alias("timeperiod"))

    def compute(rows):
        day = P.to_period(P.DAILY, "ts").alias("timeperiod")
        per_session = rows.groupBy("domain", day, "session_id").agg(F.count(F.lit(1)).alias("n"))
        return per_session.groupBy("domain", "timeperiod").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("visits"))

    return buckets.recompute_buckets(
        V.hits_of(spark, sf), dirty, compute, by=("domain",), period=P.to_period(P.DAILY, "ts"), q=P.DAILY, ts="ts"
    )
