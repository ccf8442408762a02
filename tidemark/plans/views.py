"""Views over the given tables that feed the registered queries.

Each view reads a whole table; none keeps a subset of ids. The same expressions in
DuckDB's SQL are in ``PRELUDE``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.operators import sessions as SE
from tidemark.operators.spine import period_spine
from tidemark.plans.catalog import SITE_SUITE
from tidemark.sources.shared import fresh_dir, stored_bytes

LEDGER_NOW = datetime(2024, 1, 20, 12, 30)
ATTEMPT_NOW = datetime(2024, 1, 31)
SPINE_START = "2024010100"

PROCESS_ORDER = (
    "site_hourly",
    "site_daily",
    "site_monthly",
    "site_yearly",
    "client_daily",
    "client_monthly",
    "client_yearly",
    "alert_daily",
)
LEDGER_STATES = (S.PROCESSED, S.NOOP, S.SKIPPED, S.IN_PROGRESS, S.FINAL_RUN, S.EMBRYO)
ATTEMPT_STATES = (S.REQUESTED, S.IN_PROGRESS, S.PROCESSED, S.CANCELED, S.INVALID, S.NOOP)
SCHEDULES = ("at 6:05", "at 2-11:10", "at *-23:59, 3-07:45", "at 6-00:00, 3-12:15 ,0-21:30", "every 420", "at *-12:34,12:34,  5-1:02")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STREAM_FILES: dict[tuple, tuple[str, int]] = {}
_FILE_BYTES = 2 << 20  # of the events table, for each file of a micro-batch


def event_stream(spark: SparkSession, sf_dir: str, files: int = 3, *, in_order: bool = False) -> DataFrame:
    """The events table as a stream of several micro-batches.

    The events are dealt over ``files`` batches by their id, so each batch spans all times: after the first
    nearly all rows are late. With ``in_order`` each batch holds the next ten days. A batch has more files
    the larger the table is, so that many tasks read it; its files are written after those of the batch
    before, which is the order in which the stream takes them. A session writes the files once; streams only
    read them.
    """
    events = table(spark, sf_dir, "events")
    known = (spark.sparkContext.applicationId, sf_dir, files, in_order)
    if known not in _STREAM_FILES:
        path, share = fresh_dir(spark, "events"), stored_bytes(spark, f"{sf_dir}/events.parquet") // (files * _FILE_BYTES) + 1
        share = max(share, 8) if in_order else share
        part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) if in_order else F.pmod("event_id", F.lit(files))
        for i in range(3 if in_order else files):
            events.where(F.coalesce(part, F.lit(0)) == i).repartition(share).write.mode("append").parquet(path)
        _STREAM_FILES[known] = path, share
    path, share = _STREAM_FILES[known]
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", share).parquet(path)


def k() -> Column:
    return F.expr("cast(get_json_object(props, '$.k') as int)")


def domain() -> Column:
    """Ten users share a site, so the number of sites grows with the users."""
    return F.expr("concat('domain_', user_id div 10)")


def hits(events: DataFrame) -> DataFrame:
    """Events as page hits; works on a table and on a stream."""
    keyed = events.selectExpr(
        "event_id", "ts", "user_id", "event_type", "cast(get_json_object(props, '$.k') as int) as k"
    )
    return keyed.selectExpr(
        "event_id",
        "ts",
        "concat('domain_', user_id div 10) as domain",
        "concat('session_', user_id, '_', date_format(ts, 'yyyyMMdd')) as session_id",
        "concat('10.0.', user_id % 256, '.', k) as ip",
        "case when k % 11 <> 0 then cast(320 + 160 * (k % 4) as bigint) end as screen_x",
        "case when k % 13 <> 0 then cast(240 + 120 * (k % 4) as bigint) end as screen_y",
        "case when k % 7 <> 0 then concat('os_', k % 4) end as os",
        "case when k % 5 <> 0 then concat('browser_', k % 6) end as browser",
        "concat('lang_', k % 3) as language",
        "concat('c_', k % 5) as country",
        "event_type = 'view' as is_page_view",
    )


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "events"))


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.build_sessions(hits_of(spark, sf_dir))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers own the site of their number; one in debt owns none."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return customers.select(
        F.expr("concat('domain_', c_custkey)").alias("domain"),
        F.expr("concat('client_', c_nationkey)").alias("client_id"),
    )


_HOUR = "date_format(ts, 'yyyyMMddHH')"


def _bucket(name: str, hour: str) -> str:
    """SQL for the bucket of a process that holds an hour."""
    return _cast(SITE_SUITE.processes[name].qualifier, hour)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger per site: one row per process and touched bucket, its state drawn from its events."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('domain_', user_id div 10) as domain", f"{_HOUR} as hour", "cast(get_json_object(props, '$.k') as int) as k"
    )
    fine = events.groupBy("domain", "hour", F.expr("k % 8 as r")).agg(
        F.expr("count(1) as n"), F.expr("sum(k) as s"), F.expr("max(event_id) as last_id")
    )
    parts = ", ".join(
        f"struct({i} as i, '{name}' as process_name, '{SITE_SUITE.processes[name].qualifier}' as time_qualifier, "
        f"{_bucket(name, 'hour')} as timeperiod)"
        for i, name in enumerate(PROCESS_ORDER)
    )
    rows = fine.selectExpr("domain", "r", "n", "s", "last_id", f"inline(array({parts}))")
    folded = rows.groupBy("domain", "i", "process_name", "time_qualifier", "timeperiod").agg(
        F.expr("sum(s) + i * sum(n) as x"), F.expr("max(case when r = i then last_id end) as related_unit_of_work")
    )
    others = " ".join(f"when {i} then '{state}'" for i, state in enumerate(LEDGER_STATES))
    return folded.selectExpr(
        "domain",
        "process_name",
        "time_qualifier",
        "timeperiod",
        f"""case when time_qualifier = '{P.HOURLY}' then
              case when x % 24 = 0 then '{S.IN_PROGRESS}' when cast(substring(timeperiod, 7, 2) as int) % 7 = 0 then '{S.SKIPPED}'
                   when x % 24 = 1 then '{S.EMBRYO}' when x % 24 < 4 then '{S.SKIPPED}' when x % 24 < 12 then '{S.NOOP}'
                   else '{S.PROCESSED}' end
            else case x % 6 {others} end end as state""",
        "x % 5 as number_of_failures",
        "related_unit_of_work",
    )


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written once to the shared folder and read back, for jobs that use it several times."""
    path = fresh_dir(spark, "ledger")
    ledger(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def dense_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with rows in nearly all buckets up to its clock, written once: what it lacks needs no work, and one in 37 stays a gap."""
    rows = ledger_table(spark, sf_dir).select("domain", "process_name", "time_qualifier", "timeperiod", "state", "number_of_failures")
    spine = period_spine(entities(spark, sf_dir), SITE_SUITE, SPINE_START, LEDGER_NOW)
    lacking = spine.join(rows, ["domain", "process_name", "timeperiod"], "left_anti").where("cast(substring(timeperiod, 5, 6) as int) % 37 <> 0")
    filled = lacking.select("domain", "process_name", "time_qualifier", "timeperiod", F.lit(S.NOOP).alias("state"), F.lit(0).cast("bigint").alias("number_of_failures"))
    path = fresh_dir(spark, "dense-ledger")
    rows.unionByName(filled).write.parquet(path)
    return spark.read.parquet(path)


def bucket_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of their hour's and their month's bucket."""
    events = table(spark, sf_dir, "events")
    entry = "struct('{0}' as process_name, {1} as timeperiod)"
    parts = ", ".join(entry.format(n, _bucket(n, _HOUR)) for n in ("site_hourly", "site_monthly"))
    return events.selectExpr("concat('domain_', user_id div 10) as domain", "ts as logged_at", "concat(event_type, ' ', event_id) as message", f"inline(array({parts}))")


def attempts(events: DataFrame) -> DataFrame:
    """One attempt per event; works on a table and on a stream."""
    names = ", ".join(f"'{p}'" for p in PROCESS_ORDER)
    states = ", ".join(f"'{x}'" for x in ATTEMPT_STATES)
    buckets = " ".join(f"when {i} then {_bucket(name, 'hour')}" for i, name in enumerate(PROCESS_ORDER))
    keyed = events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k", f"{_HOUR} as hour")
    placed = keyed.selectExpr("*", f"case k % 8 {buckets} end as timeperiod")
    return placed.selectExpr(
        "event_id as attempt_id",
        "concat('domain_', user_id div 10) as domain",
        f"element_at(array({names}), k % 8 + 1) as process_name",
        "timeperiod",
        "timeperiod as start_timeperiod",
        f"element_at(array({states}), cast((event_id + k) % 6 as int) + 1) as state",
        "ts as created_at",
        "ts + make_dt_interval(0, 0, k) as submitted_at",
        "cast(k % 4 as bigint) as number_of_retries",
        f"case when event_type = 'signup' then '{S.FREERUN}' else '{S.MANAGED}' end as unit_of_work_type",
    )


def attempts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(table(spark, sf_dir, "events"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(domain().alias("domain")).distinct()


def schedules(events: DataFrame) -> DataFrame:
    """Each event carries the schedule of its user; the text is one of a handful."""
    texts = ", ".join(f"'{s}'" for s in SCHEDULES)
    return events.withColumn("schedule", F.expr(f"element_at(array({texts}), cast(user_id % {len(SCHEDULES)} as int) + 1)"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cast(q: str, c: str) -> str:
    return {
        P.HOURLY: c,
        P.DAILY: f"substr({c},1,8)||'00'",
        P.MONTHLY: f"substr({c},1,6)||'0000'",
        P.YEARLY: f"substr({c},1,4)||'000000'",
    }[q]


def cast_by(q: str, c: str) -> str:
    """SQL for the period of the granularity a column names."""
    whens = " ".join(f"WHEN '{x}' THEN {_cast(x, c)}" for x in (P.HOURLY, P.DAILY, P.MONTHLY, P.YEARLY))
    return f"CASE {q} {whens} END"


def start_by(q: str, c: str) -> str:
    """SQL for the start of a period of the granularity a column names."""
    return (
        f"make_timestamp(CAST(substr({c},1,4) AS BIGINT), greatest(CAST(substr({c},5,2) AS BIGINT),1), "
        f"greatest(CAST(substr({c},7,2) AS BIGINT),1), CAST(substr({c},9,2) AS BIGINT), 0, 0.0)"
    )


def shift_by(q: str, c: str, n: int) -> str:
    """SQL for the period ``n`` units on."""
    at = start_by(q, c)
    return (
        f"CASE {q} WHEN '_hourly' THEN strftime({at} + INTERVAL ({n}) HOUR, '%Y%m%d%H') "
        f"WHEN '_daily' THEN strftime({at} + INTERVAL ({n}) DAY, '%Y%m%d00') "
        f"WHEN '_monthly' THEN strftime({at} + INTERVAL ({n}) MONTH, '%Y%m0000') "
        f"WHEN '_yearly' THEN strftime({at} + INTERVAL ({n}) YEAR, '%Y000000') END"
    )


PRELUDE = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         'domain_' || CAST(user_id // 10 AS VARCHAR) AS domain FROM events
), hits AS (
  SELECT event_id, ts, domain,
         'session_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id,
         '10.0.' || (user_id % 256) || '.' || k AS ip,
         CASE WHEN k % 11 <> 0 THEN CAST(320 + 160 * (k % 4) AS BIGINT) END AS screen_x,
         CASE WHEN k % 13 <> 0 THEN CAST(240 + 120 * (k % 4) AS BIGINT) END AS screen_y,
         CASE WHEN k % 7 <> 0 THEN 'os_' || (k % 4) END AS os,
         CASE WHEN k % 5 <> 0 THEN 'browser_' || (k % 6) END AS browser,
         'lang_' || (k % 3) AS language, 'c_' || (k % 5) AS country,
         event_type = 'view' AS is_page_view
  FROM ev
), sessions AS (
  SELECT domain, strftime(min(ts), '%Y%m%d%H') AS timeperiod, session_id,
         arg_min(ip, row(ts, event_id)) AS ip,
         arg_max(os, row(ts, event_id)) FILTER (WHERE os IS NOT NULL) AS os,
         arg_max(browser, row(ts, event_id)) FILTER (WHERE browser IS NOT NULL) AS browser,
         arg_max(language, row(ts, event_id)) FILTER (WHERE language IS NOT NULL) AS language,
         arg_max(country, row(ts, event_id)) FILTER (WHERE country IS NOT NULL) AS country,
         arg_max(screen_x, row(ts, event_id)) FILTER (WHERE screen_x IS NOT NULL AND screen_y IS NOT NULL) AS screen_x,
         arg_max(screen_y, row(ts, event_id)) FILTER (WHERE screen_x IS NOT NULL AND screen_y IS NOT NULL) AS screen_y,
         CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS total_duration,
         CAST(count(*) FILTER (WHERE is_page_view) AS BIGINT) AS number_of_pageviews,
         CAST(count(*) AS BIGINT) AS number_of_entries
  FROM hits GROUP BY domain, session_id
), site AS (
  SELECT domain, timeperiod, CAST(count(*) AS BIGINT) AS number_of_visits,
         CAST(sum(number_of_pageviews) AS BIGINT) AS number_of_pageviews,
         CAST(sum(total_duration) AS BIGINT) AS total_duration
  FROM sessions GROUP BY ALL
), hist AS (
  SELECT domain, timeperiod, family, key, CAST(count(*) AS BIGINT) AS cnt FROM (
    SELECT domain, timeperiod, 'os' AS family, os AS key FROM sessions
    UNION ALL SELECT domain, timeperiod, 'browser', browser FROM sessions
    UNION ALL SELECT domain, timeperiod, 'screen_resolution',
      '(' || coalesce(CAST(screen_x AS VARCHAR), 'None') || ', ' || coalesce(CAST(screen_y AS VARCHAR), 'None') || ')' FROM sessions
    UNION ALL SELECT domain, timeperiod, 'language', language FROM sessions
    UNION ALL SELECT domain, timeperiod, 'country', country FROM sessions
  ) WHERE key IS NOT NULL GROUP BY ALL
), owners AS (
  SELECT 'domain_' || c_custkey AS domain, 'client_' || c_nationkey AS client_id FROM customer WHERE c_acctbal >= 0
), procs(i, process_name, time_qualifier, tree_name, depth, parent_process, parent_qualifier, child_process,
         blocking_type, runs_on_open_bucket) AS (VALUES
  (0, 'site_hourly', '_hourly', 'tree_site', 3, 'site_daily', '_daily', NULL, 'blocking_normal', true),
  (1, 'site_daily', '_daily', 'tree_site', 2, 'site_monthly', '_monthly', 'site_hourly', 'blocking_children', true),
  (2, 'site_monthly', '_monthly', 'tree_site', 1, 'site_yearly', '_yearly', 'site_daily', 'blocking_normal', true),
  (3, 'site_yearly', '_yearly', 'tree_site', 0, NULL, NULL, 'site_monthly', 'blocking_normal', true),
  (4, 'client_daily', '_daily', 'tree_client', 2, 'client_monthly', '_monthly', NULL, 'blocking_dependencies', false),
  (5, 'client_monthly', '_monthly', 'tree_client', 1, 'client_yearly', '_yearly', 'client_daily', 'blocking_normal', true),
  (6, 'client_yearly', '_yearly', 'tree_client', 0, NULL, NULL, 'client_monthly', 'blocking_normal', true),
  (7, 'alert_daily', '_daily', 'tree_alert', 0, NULL, NULL, NULL, 'blocking_dependencies', false)
), waits(process_name, depends_on) AS (VALUES
  ('client_daily', 'site_daily'), ('client_monthly', 'site_monthly'), ('client_yearly', 'site_yearly')
), folded AS (
  SELECT domain, i, process_name, time_qualifier, {cast_by('time_qualifier', "strftime(ts, '%Y%m%d%H')")} AS timeperiod,
         CAST(sum(k) + i * count(*) AS BIGINT) AS x, max(event_id) FILTER (WHERE k % 8 = i) AS related_unit_of_work
  FROM ev, procs GROUP BY domain, i, process_name, time_qualifier, timeperiod
), ledger AS (
  SELECT domain, process_name, time_qualifier, timeperiod,
         CASE WHEN time_qualifier = '_hourly' THEN
           CASE WHEN x % 24 = 0 THEN 'state_in_progress' WHEN CAST(substr(timeperiod, 7, 2) AS INT) % 7 = 0 THEN 'state_skipped'
                WHEN x % 24 = 1 THEN 'state_embryo' WHEN x % 24 < 4 THEN 'state_skipped'
                WHEN x % 24 < 12 THEN 'state_noop' ELSE 'state_processed' END
         ELSE {_sql_list(LEDGER_STATES)}[x % 6 + 1] END AS state,
         x % 5 AS number_of_failures, related_unit_of_work
  FROM folded
), attempts AS (
  SELECT event_id AS attempt_id, domain, process_name, {cast_by('time_qualifier', "strftime(ts, '%Y%m%d%H')")} AS timeperiod,
         {_sql_list(ATTEMPT_STATES)}[(event_id + k) % 6 + 1] AS state, ts AS created_at,
         ts + INTERVAL (k) MINUTE AS submitted_at, CAST(k % 4 AS BIGINT) AS number_of_retries,
         CASE WHEN event_type = 'signup' THEN 'type_freerun' ELSE 'type_managed' END AS unit_of_work_type, time_qualifier
  FROM ev JOIN procs ON procs.i = k % 8
), kids AS (
  SELECT l.domain, p.parent_process AS process_name, {cast_by('p.parent_qualifier', 'l.timeperiod')} AS timeperiod,
         count(*) AS number_of_children,
         bool_and(l.state IN ('state_processed', 'state_skipped', 'state_noop')) AS children_finished,
         bool_or(l.state NOT IN ('state_processed', 'state_skipped', 'state_noop')) AS child_active,
         bool_and(l.state = 'state_skipped') AS children_skipped,
         bool_and(l.state = 'state_skipped' OR l.number_of_failures > 3) AS children_spoiled
  FROM ledger l JOIN procs p USING (process_name) WHERE p.parent_process IS NOT NULL GROUP BY ALL
), deps AS (
  SELECT a.domain, a.process_name, a.timeperiod, w.depends_on, coalesce(b.state, 'state_embryo') AS depends_on_state
  FROM ledger a JOIN waits w USING (process_name)
  LEFT JOIN ledger b ON b.domain = a.domain AND b.process_name = w.depends_on AND b.timeperiod = a.timeperiod
), judged AS (
  SELECT l.*, p.blocking_type, p.tree_name, p.depth, p.parent_qualifier, p.child_process, p.runs_on_open_bucket,
         coalesce(kids.children_finished, true) AS children_finished, kids.children_spoiled, kids.child_active,
         kids.children_skipped, kids.number_of_children,
         coalesce(d.all_finished, true) AS all_finished, coalesce(d.all_processed, true) AS all_processed,
         coalesce(d.skipped_present, false) AS skipped_present,
         l.state IN ('state_processed', 'state_skipped', 'state_noop') AS finished
  FROM ledger l JOIN procs p USING (process_name) LEFT JOIN kids USING (domain, process_name, timeperiod)
  LEFT JOIN (SELECT domain, process_name, timeperiod,
      bool_and(depends_on_state IN ('state_processed', 'state_skipped', 'state_noop')) AS all_finished,
      bool_and(depends_on_state IN ('state_processed', 'state_noop')) AS all_processed,
      bool_or(depends_on_state = 'state_skipped') AS skipped_present FROM deps GROUP BY ALL) d
    USING (domain, process_name, timeperiod)
)
"""


def oracle(body: str) -> str:
    """A DuckDB query that may use every view above."""
    body = body.strip()
    if body.startswith("WITH "):
        return PRELUDE.rstrip() + ", " + body[len("WITH ") :]
    return PRELUDE + body
