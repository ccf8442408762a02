"""Queries: the period algebra and schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import schedule as X
from tidemark.operators import schedules
from tidemark.operators.ledger import is_closed
from tidemark.plans import views as V
from tidemark.plans.registry import query

_LEVELS = (P.HOURLY, P.DAILY, P.MONTHLY, P.YEARLY)


def _hours(spark, sf):
    """Every hour in which an order, a line or an event falls."""
    parts = [
        V.table(spark, sf, t).select(P.to_period(P.HOURLY, c).alias("hour"))
        for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


_H = """WITH h AS (SELECT strftime(ts, '%Y%m%d%H') AS hour FROM events UNION SELECT strftime(o_orderdate, '%Y%m%d%H') FROM orders
  UNION SELECT strftime(l_shipdate, '%Y%m%d%H') FROM lineitem)"""


@query(
    "period_patterns",
    """WITH p AS (SELECT DISTINCT unnest([strftime(ts, '%Y%m%d%H%M%S'), strftime(ts, '%Y%m%d%H'), strftime(ts, '%Y%m%d00'),
         strftime(ts, '%Y%m0000'), strftime(ts, '%Y000000')]) AS tp FROM events)
       SELECT tp, CASE WHEN length(tp) > 10 THEN '%Y%m%d%H%M%S' ELSE
         '%Y' || CASE WHEN substr(tp,5,2) = '00' THEN '00' ELSE '%m' END || CASE WHEN substr(tp,7,2) = '00' THEN '00' ELSE '%d' END
         || CASE WHEN substr(tp,9,2) = '00' THEN '00' ELSE '%H' END END AS pattern FROM p""",
)
def _(spark, sf):
    forms = [P.to_period(q, "ts") for q in (P.REAL_TIME, *_LEVELS)]
    periods = V.table(spark, sf, "events").select(F.explode(F.array(*forms)).alias("tp")).distinct()
    return periods.select("tp", P.period_pattern("tp").alias("pattern"))


@query(
    "epoch_round_trip",
    """SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS session, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y%m%d%H') AS hour,
       strftime(ts, '%Y%m%d00') AS day, strftime(ts, '%Y%m0000') AS month, strftime(ts, '%Y000000') AS year FROM events""",
)
def _(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", P.epoch_to_session(P.epoch_seconds("ts")).alias("session"))
    rows = rows.withColumn("seconds", P.session_to_epoch("session")).withColumn("hour", P.session_to_hour("session"))
    rows = rows.withColumn("day", P.hour_to_day("hour")).withColumn("month", P.day_to_month("day"))
    return rows.withColumn("year", P.month_to_year("month"))


@query(
    "period_parts",
    f"{_H} SELECT hour, substr(hour,1,4) AS y, substr(hour,5,2) AS m, substr(hour,7,2) AS d, substr(hour,9,2) AS h FROM h",
)
def _(spark, sf):
    rows = _hours(spark, sf).withColumn("p", P.split_period("hour"))
    parts = [F.col(f"p.{n}").alias(a) for n, a in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"))]
    return rows.select("hour", *parts)


@query(
    "period_cast",
    _H + " SELECT hour, " + ", ".join(f"{V._cast(q, 'hour')} AS to{q}" for q in _LEVELS) + " FROM h",
)
def _(spark, sf):
    return _hours(spark, sf).select("hour", *[P.cast_period(q, "hour").alias(f"to{q}") for q in _LEVELS])


@query(
    "period_start",
    _H + " SELECT hour, " + ", ".join(
        f"strftime({V.start_by('', V._cast(q, 'hour'))}, '%Y-%m-%d %H:%M:%S') AS at{q}" for q in _LEVELS
    ) + " FROM h",
)
def _(spark, sf):
    starts = [
        F.date_format(P.period_start(q, P.cast_period(q, "hour")), "yyyy-MM-dd HH:mm:ss").alias(f"at{q}") for q in _LEVELS
    ]
    return _hours(spark, sf).select("hour", *starts)


_DELTAS = (-25, -3, -1, 1, 5)
_LABEL = {d: f"minus{-d}" if d < 0 else f"plus{d}" for d in _DELTAS}


@query(
    "period_shift",
    _H
    + ", l AS (SELECT hour, unnest(['_hourly', '_daily', '_monthly', '_yearly']) AS q FROM h), p AS (SELECT DISTINCT q, "
    + V.cast_by("q", "hour")
    + " AS tp FROM l) SELECT q, tp, "
    + ", ".join(f"{V.shift_by('q', 'tp', d)} AS {_LABEL[d]}" for d in _DELTAS)
    + " FROM p",
)
def _(spark, sf):
    levels = F.array(*[F.struct(F.lit(q).alias("q"), P.cast_period(q, "hour").alias("tp")) for q in _LEVELS])
    periods = _hours(spark, sf).select(F.explode(levels).alias("l")).select("l.q", "l.tp").distinct()
    return periods.select("q", "tp", *[P.shift_period_by("q", "tp", d).alias(_LABEL[d]) for d in _DELTAS])


def _group_sql(q: str, n: int, c: str, start: bool) -> str:
    stem = {P.HOURLY: f"substr({c},9,2)", P.DAILY: f"substr({c},7,2)", P.MONTHLY: f"substr({c},5,2)"}[q]
    stem = f"CAST({stem} AS INT)"
    upper = {
        P.HOURLY: "23",
        P.DAILY: f"day(last_day(make_date(CAST(substr({c},1,4) AS INT), CAST(substr({c},5,2) AS INT), 1)))",
        P.MONTHLY: "12",
    }[q]
    if start:
        value = f"((greatest({stem}, 1) - 1) // {n}) * {n} + 1"
        if q == P.HOURLY:
            value = f"CASE WHEN {value} = 1 THEN 0 ELSE {value} END"
    else:
        value = f"least(greatest(({stem} + {n - 1}) // {n}, 1) * {n}, {upper})"
    text = f"lpad(CAST({value} AS VARCHAR), 2, '0')"
    return {
        P.HOURLY: f"substr({c},1,8) || {text}",
        P.DAILY: f"substr({c},1,6) || {text} || '00'",
        P.MONTHLY: f"substr({c},1,4) || {text} || '0000'",
    }[q]


_GROUPS = ((P.HOURLY, 3), (P.HOURLY, 5), (P.DAILY, 3), (P.DAILY, 10), (P.MONTHLY, 3), (P.MONTHLY, 5))


def _register_group(name: str, start: bool) -> None:
    columns = ", ".join(f"{_group_sql(q, n, V._cast(q, 'hour'), start)} AS by{q}_{n}" for q, n in _GROUPS)

    @query(name, f"{_H} SELECT hour, {columns} FROM h")
    def _(spark, sf):
        group = P.group_start if start else P.group_period
        return _hours(spark, sf).select("hour", *[group(q, n, P.cast_period(q, "hour")).alias(f"by{q}_{n}") for q, n in _GROUPS])


_register_group("period_group", False)
_register_group("period_group_start", True)


@query(
    "period_group_bounds",
    _H
    + f" SELECT hour, {V.shift_by(chr(39) + '_hourly' + chr(39), 'hour', 1)} AS hour_end, hour <> {_group_sql(P.HOURLY, 3, 'hour', False)} AS between_groups, "
    + f"{V.start_by('', 'hour')} + INTERVAL 1 HOUR + INTERVAL 5 MINUTE < TIMESTAMP '2024-01-20 12:30:00' AS closed FROM h",
)
def _(spark, sf):
    return _hours(spark, sf).select(
        "hour",
        P.group_end(P.HOURLY, "hour").alias("hour_end"),
        P.is_between_group(P.HOURLY, 3, "hour").alias("between_groups"),
        is_closed(P.HOURLY, "hour", V.LEDGER_NOW).alias("closed"),
    )


@query(
    "current_periods",
    """SELECT user_id, strftime(max(ts), '%Y%m%d%H') AS current_hour, strftime(max(ts), '%Y%m%d00') AS current_day, strftime(max(ts), '%Y%m0000') AS current_month FROM ev GROUP BY 1""",
)
def _(spark, sf):
    last = V.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("now"))
    names = {P.HOURLY: "current_hour", P.DAILY: "current_day", P.MONTHLY: "current_month"}
    return last.select("user_id", *[P.current_period(q, F.col("now")).alias(n) for q, n in names.items()])


@query(
    "fold_by_group",
    f"""SELECT domain, {_group_sql(P.HOURLY, 3, "strftime(ts, '%Y%m%d%H')", False)} AS timeperiod, max(event_id) AS event_id,
        arg_max(event_type, event_id) AS event_type FROM ev GROUP BY 1, 2""",
)
def _(spark, sf):
    events = V.table(spark, sf, "events").select(
        V.domain().alias("domain"), P.to_period(P.HOURLY, "ts").alias("timeperiod"), "event_id", "event_type"
    )
    return P.fold_by_group(events, P.HOURLY, 3, "event_id", keys=("domain",))


# ---- schedules -------------------------------------------------------------------------

_SCHED = "SELECT ev.*, [" + ", ".join(f"'{s}'" for s in V.SCHEDULES) + f"][user_id % {len(V.SCHEDULES)} + 1] AS schedule FROM ev"
_USERS = f"s AS (SELECT DISTINCT user_id, schedule FROM ({_SCHED}))"
_ENTRIES = (
    _USERS
    + """, e AS (SELECT user_id, schedule, unnest(str_split(replace(substr(schedule, 4), ' ', ''), ',')) AS entry FROM s WHERE schedule LIKE 'at %'),
  p AS (SELECT user_id, schedule, 'at' AS kind, CAST(NULL AS INT) AS every_seconds, CASE WHEN contains(entry, '-') THEN split_part(entry, '-', 1) ELSE '*' END AS day,
    CAST(split_part(split_part('*-' || entry, '-', -1), ':', 1) AS INT) AS hour, CAST(split_part(entry, ':', 2) AS INT) AS minute FROM e
    UNION ALL SELECT user_id, schedule, 'every', CAST(trim(substr(schedule, 7)) AS INT), NULL, NULL, NULL FROM s WHERE schedule LIKE 'every %')"""
)


def _user_schedules(spark, sf):
    return V.schedules(V.table(spark, sf, "events")).select("user_id", "schedule").distinct()


@query("schedule_entries", f"WITH {_ENTRIES} SELECT * FROM p")
def _(spark, sf):
    return schedules.parse_schedule(_user_schedules(spark, sf), "schedule")


@query(
    "schedule_next",
    f"""WITH {_ENTRIES}, c AS (
         SELECT v.event_id, min(d.day0 + to_hours(p.hour) + to_minutes(p.minute)) AS next FROM ({_SCHED}) v JOIN p ON p.user_id = v.user_id AND p.kind = 'at',
           LATERAL (SELECT unnest(range(0, 9)) AS i) r, LATERAL (SELECT date_trunc('day', v.ts) + to_days(CAST(r.i AS INT)) AS day0) d
         WHERE (p.day = '*' OR CAST(p.day AS INT) = isodow(d.day0) - 1) AND d.day0 + to_hours(p.hour) + to_minutes(p.minute) >= v.ts GROUP BY 1
         UNION ALL SELECT v.event_id, v.ts + to_seconds(p.every_seconds) FROM ({_SCHED}) v JOIN p ON p.user_id = v.user_id AND p.kind = 'every')
       SELECT event_id, strftime(next, '%Y-%m-%d %H:%M:%S') AS next_trigger FROM c""",
)
def _(spark, sf):
    events = V.schedules(V.table(spark, sf, "events"))
    runs = schedules.next_trigger(events, "ts", "schedule")
    return runs.select("event_id", F.date_format("next_trigger", "yyyy-MM-dd HH:mm:ss").alias("next_trigger"))


_LO, _HI = datetime(2024, 1, 8), datetime(2024, 1, 15)
_EXPECTED = (
    _ENTRIES
    + """, x AS (SELECT DISTINCT user_id, schedule, d + to_hours(hour) + to_minutes(minute) AS run_at FROM p,
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS d) WHERE kind = 'at' AND (day = '*' OR CAST(day AS INT) = isodow(d) - 1)
    UNION SELECT user_id, schedule, date_trunc('minute', unnest(generate_series(TIMESTAMP '2024-01-08' + to_seconds(every_seconds), TIMESTAMP '2024-01-15' - INTERVAL 1 SECOND, to_seconds(every_seconds))))
    FROM p WHERE kind = 'every')"""
)


def _expected(spark, sf):
    return schedules.expected_runs(_user_schedules(spark, sf), "schedule", _LO, _HI)


@query("expected_runs", f"WITH {_EXPECTED} SELECT user_id, schedule, strftime(run_at, '%Y-%m-%d %H:%M') AS expected_at FROM x")
def _(spark, sf):
    return _expected(spark, sf).withColumn("expected_at", F.date_format("expected_at", "yyyy-MM-dd HH:mm"))


@query(
    "missed_runs",
    f"""WITH {_EXPECTED} SELECT user_id, schedule, strftime(run_at, '%Y-%m-%d %H:%M') AS expected_at FROM x
        WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = x.user_id AND date_trunc('minute', ev.ts) = x.run_at)""",
)
def _(spark, sf):
    missed = schedules.missed_runs(_expected(spark, sf), V.table(spark, sf, "events"), ["user_id"], "ts", _LO, _HI)
    return missed.withColumn("expected_at", F.date_format("expected_at", "yyyy-MM-dd HH:mm"))


@query(
    "schedule_kinds",
    f"WITH {_USERS} SELECT schedule, schedule LIKE 'every %' AS every, count(*) AS users FROM s GROUP BY 1",
)
def _(spark, sf):
    users = _user_schedules(spark, sf)
    return users.groupBy("schedule", X.is_every("schedule").alias("every")).agg(F.count(F.lit(1)).alias("users"))
