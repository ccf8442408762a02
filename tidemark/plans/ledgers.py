"""Queries: a ledger per site, its gaps, dependencies, propagation and attempts."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.operators import ledger as L
from tidemark.operators import spine
from tidemark.plans import catalog as C
from tidemark.plans import views as V
from tidemark.plans.catalog import SITE_SUITE
from tidemark.plans.registry import query
from tidemark.sources.scans import ledger_since

BY = ("domain",)
_KEY = ["domain", "process_name", "timeperiod"]
_DONE = "('state_processed', 'state_skipped', 'state_noop')"
_ACTIVE = "('state_embryo', 'state_in_progress', 'state_final_run')"
_NOW = "TIMESTAMP '2024-01-20 12:30:00'"


def _current(q: str) -> str:
    return V.cast_by(q, "'2024012012'")


@query("ledger", "SELECT * FROM ledger")
def _(spark, sf):
    return V.ledger(spark, sf)


# ---- buckets that should exist -----------------------------------------------------

_SPINE = f"""bottom AS (SELECT p.process_name, p.time_qualifier, CASE p.tree_name WHEN 'tree_site' THEN '_hourly' ELSE '_daily' END AS fine FROM procs p),
  spine AS (SELECT DISTINCT d.domain, b.process_name, b.time_qualifier, {V.cast_by('b.time_qualifier', "strftime(t, '%Y%m%d%H')")} AS timeperiod
    FROM (SELECT DISTINCT domain FROM ev) d, bottom b,
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20 12:00:00', INTERVAL 1 HOUR)) AS t))"""


def _spine(spark, sf):
    return spine.period_spine(V.entities(spark, sf), SITE_SUITE, V.SPINE_START, V.LEDGER_NOW)


@query("period_spine", f"WITH {_SPINE} SELECT * FROM spine")
def _(spark, sf):
    return _spine(spark, sf)


@query(
    "missing_periods",
    f"""WITH {_SPINE} SELECT domain, process_name, time_qualifier, timeperiod, 'state_embryo' AS state, CAST(0 AS BIGINT) AS number_of_failures
        FROM spine WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.domain = spine.domain AND l.process_name = spine.process_name AND l.timeperiod = spine.timeperiod)""",
)
def _(spark, sf):
    return spine.missing_periods(_spine(spark, sf), V.ledger(spark, sf), by=BY)


@query(
    "period_ancestors",
    """SELECT DISTINCT custkey, time_qualifier, timeperiod FROM (
       SELECT o_custkey AS custkey, '_monthly' AS time_qualifier, strftime(o_orderdate, '%Y%m0000') AS timeperiod FROM orders
       UNION ALL SELECT o_custkey, '_yearly', strftime(o_orderdate, '%Y000000') FROM orders
       UNION ALL SELECT o_custkey, '_daily', strftime(o_orderdate, '%Y%m%d00') FROM orders)""",
)
def _(spark, sf):
    days = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), P.to_period(P.DAILY, "o_orderdate").alias("timeperiod")
    )
    return spine.with_ancestors(days, [P.DAILY, P.MONTHLY, P.YEARLY])


# ---- ledgers with gaps -----------------------------------------------------------------
#
# The twins below build every bucket of the calendar and judge it; the operators only count.
# Each query runs on the ledger as it is, with many gaps, and on one with few.

_SPAN = (V.SPINE_START, V.LEDGER_NOW)
_LEDGERS = (("", "ledger", V.ledger_table), ("_dense", "dense", V.dense_ledger_table))


def _gaps(base: str) -> str:
    """SQL: the ledger with a row for every bucket of the calendar, and what each of its rows hears."""
    return f"""{_SPINE}, dense AS (
      SELECT domain, process_name, time_qualifier, timeperiod, state, number_of_failures FROM ledger
      UNION ALL SELECT s.domain, s.process_name, s.time_qualifier, s.timeperiod, 'state_noop', 0 FROM spine s
        WHERE CAST(substr(s.timeperiod, 5, 6) AS INT) % 37 <> 0 AND NOT EXISTS
          (SELECT 1 FROM ledger l WHERE l.domain = s.domain AND l.process_name = s.process_name AND l.timeperiod = s.timeperiod)
    ), whole AS (
      SELECT domain, process_name, time_qualifier, timeperiod, state, number_of_failures, true AS held FROM {base}
      UNION ALL SELECT s.domain, s.process_name, s.time_qualifier, s.timeperiod, 'state_embryo', 0, false FROM spine s WHERE NOT EXISTS
        (SELECT 1 FROM {base} l WHERE l.domain = s.domain AND l.process_name = s.process_name AND l.timeperiod = s.timeperiod)
    ), below AS (
      SELECT l.domain, p.parent_process AS process_name, {V.cast_by('p.parent_qualifier', 'l.timeperiod')} AS timeperiod,
        count(*) AS number_of_children, bool_and(l.state IN {_DONE}) AS children_finished, bool_or(l.state NOT IN {_DONE}) AS child_active,
        bool_and(l.state = 'state_skipped') AS children_skipped,
        bool_and(l.held AND (l.state = 'state_skipped' OR l.number_of_failures > 3)) AS children_spoiled
      FROM whole l JOIN procs p USING (process_name) WHERE p.parent_process IS NOT NULL GROUP BY ALL
    ), beside AS (
      SELECT a.domain, a.process_name, a.timeperiod, bool_and(coalesce(b.state, 'state_embryo') IN {_DONE}) AS all_finished,
        bool_and(coalesce(b.state, 'state_embryo') IN ('state_processed', 'state_noop')) AS all_processed, bool_or(coalesce(b.state, '') = 'state_skipped') AS skipped_present
      FROM {base} a JOIN waits w USING (process_name) LEFT JOIN {base} b ON b.domain = a.domain AND b.process_name = w.depends_on AND b.timeperiod = a.timeperiod GROUP BY ALL
    ), weighed AS (
      SELECT l.*, p.blocking_type, p.tree_name, p.depth, p.parent_qualifier, p.child_process, coalesce(k.children_finished, true) AS children_finished,
        k.children_spoiled, k.child_active, k.children_skipped, k.number_of_children, coalesce(d.all_finished, true) AS all_finished,
        coalesce(d.all_processed, true) AS all_processed, coalesce(d.skipped_present, false) AS skipped_present, l.state IN {_DONE} AS finished
      FROM {base} l JOIN procs p USING (process_name) LEFT JOIN below k USING (domain, process_name, timeperiod) LEFT JOIN beside d USING (domain, process_name, timeperiod)
    )"""


# ---- dependencies ----------------------------------------------------------------------


@query("children_summary", "SELECT * FROM kids")
def _(spark, sf):
    return L.children_summary(V.ledger_table(spark, sf), SITE_SUITE, by=BY)


@query("counterparts", "SELECT domain, process_name, timeperiod, depends_on, 'tree_site' AS depends_on_tree, depends_on_state FROM deps")
def _(spark, sf):
    return L.counterparts(V.ledger_table(spark, sf), SITE_SUITE, by=BY)


@query("dependents", "SELECT l.domain, w.depends_on AS process_name, l.timeperiod, w.process_name AS dependent FROM ledger l JOIN waits w ON w.depends_on = l.process_name")
def _(spark, sf):
    return L.dependents(V.ledger(spark, sf), SITE_SUITE, by=BY)


def _names(condition: str) -> str:
    return f"coalesce(string_agg(depends_on, ',' ORDER BY depends_on) FILTER (WHERE {condition}), '')"


_NOT_DONE = "depends_on_state NOT IN ('state_processed', 'state_noop')"


@query(
    "dependency_summary",
    f"""SELECT domain, process_name, timeperiod, {_names(f'depends_on_state NOT IN {_DONE}')} AS unfinished, {_names(_NOT_DONE)} AS unprocessed,
        {_names(f"{_NOT_DONE} AND depends_on_state NOT IN {_ACTIVE}")} AS unhealthy, {_names("depends_on_state = 'state_skipped'")} AS skipped,
        bool_and(depends_on_state IN {_DONE}) AS all_finished, bool_and(NOT {_NOT_DONE}) AS all_processed,
        bool_and(depends_on_state IN {_ACTIVE} OR NOT ({_NOT_DONE})) AS all_healthy, bool_or(depends_on_state = 'state_skipped') AS skipped_present
        FROM deps GROUP BY ALL""",
)
def _(spark, sf):
    out = L.dependency_summary(V.ledger_table(spark, sf), SITE_SUITE, by=BY)
    lists = ("unfinished", "unprocessed", "unhealthy", "skipped")
    return out.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in out.columns])


_READY = "(all_finished AND children_finished AND NOT finished)"


def _judging(suffix, base, view):
    @query(
        f"readiness{suffix}",
        f"WITH {_gaps(base)} SELECT domain, process_name, timeperiod, state, children_finished, all_finished, all_processed, skipped_present, {_READY} AS ready FROM weighed",
    )
    def _(spark, sf):
        out = L.readiness(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN)
        return out.select(*_KEY, "state", "children_finished", "all_finished", "all_processed", "skipped_present", "ready")

    @query(
        f"gate{suffix}",
        f"""WITH {_gaps(base)} SELECT domain, process_name, timeperiod, blocking_type, CASE WHEN finished THEN 'done' WHEN blocking_type = 'blocking_normal' THEN 'run'
            WHEN blocking_type = 'blocking_children' THEN CASE WHEN {_READY} THEN 'run' ELSE 'wait' END
            ELSE CASE WHEN all_processed THEN 'run' WHEN skipped_present THEN 'skip' ELSE 'wait' END END AS decision FROM weighed""",
    )
    def _(spark, sf):
        return L.gate(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN).select(*_KEY, "blocking_type", "decision")

    @query(
        f"bucket_status{suffix}",
        f"""WITH {_gaps(base)} SELECT domain, process_name, timeperiod, CASE WHEN finished THEN 'done' WHEN timeperiod = {_current('time_qualifier')} OR NOT {_READY} THEN 'open'
            WHEN timeperiod < {_current('time_qualifier')} THEN 'ready' ELSE 'future' END AS status FROM weighed""",
    )
    def _(spark, sf):
        return L.bucket_status(view(spark, sf), SITE_SUITE, V.LEDGER_NOW, by=BY, start=V.SPINE_START).select(*_KEY, "status")


for _each in _LEDGERS:
    _judging(*_each)


@query(
    "closed_buckets",
    f"""WITH n AS (SELECT domain, process_name, timeperiod, runs_on_open_bucket, {V.shift_by('time_qualifier', 'timeperiod', 1)} AS following FROM judged)
        SELECT domain, process_name, timeperiod, runs_on_open_bucket OR {_NOW} > {V.start_by('', 'following')} + INTERVAL 5 MINUTE AS may_start FROM n""",
)
def _(spark, sf):
    return L.closed_buckets(V.ledger(spark, sf), SITE_SUITE, V.LEDGER_NOW).select(*_KEY, "may_start")


_GROUPED = C.Catalog(
    [C.Process("site_hourly", P.HOURLY, grouping=3), C.Process("site_daily", P.DAILY, grouping=5)],
    [C.Tree("tree_site", ("site_daily", "site_hourly"))],
)


@query(
    "mark_noop",
    f"""WITH g AS (SELECT *, CASE process_name
          WHEN 'site_hourly' THEN CAST(substr(timeperiod,9,2) AS INT) <> least(greatest((CAST(substr(timeperiod,9,2) AS INT) + 2) // 3, 1) * 3, 23)
          WHEN 'site_daily' THEN CAST(substr(timeperiod,7,2) AS INT) <> least(greatest((CAST(substr(timeperiod,7,2) AS INT) + 4) // 5, 1) * 5, 31)
          ELSE false END AS between_groups FROM ledger)
        SELECT domain, process_name, timeperiod, CASE WHEN between_groups AND state IN {_ACTIVE} THEN 'state_noop' ELSE state END AS state FROM g""",
)
def _(spark, sf):
    return L.mark_noop(V.ledger(spark, sf), _GROUPED).select(*_KEY, "state")


# ---- propagation -------------------------------------------------------------------------

# Changed buckets: the hours, and client days, in which the site reported an error.
_CHANGED = """changed AS (SELECT DISTINCT domain, 'site_hourly' AS process_name, strftime(ts, '%Y%m%d%H') AS timeperiod FROM ev WHERE event_type = 'error'
    UNION SELECT domain, 'client_daily', strftime(ts, '%Y%m%d00') FROM ev WHERE event_type = 'signup')"""


def _changed(spark, sf):
    events = V.table(spark, sf, "events")

    def buckets(kind: str, process: str, q: str):
        return events.where(F.col("event_type") == kind).select(
            V.domain().alias("domain"), F.lit(process).alias("process_name"), P.to_period(q, "ts").alias("timeperiod")
        )

    return buckets("error", "site_hourly", P.HOURLY).unionByName(buckets("signup", "client_daily", P.DAILY)).distinct()


@query(
    "propagate_dirty",
    f"""WITH {_CHANGED}, reach AS (SELECT domain, process_name, timeperiod FROM changed UNION
          SELECT r.domain, e.target, {V.cast_by('e.q', 'r.timeperiod')} FROM reach r JOIN (
            SELECT process_name, parent_process AS target, parent_qualifier AS q FROM procs WHERE parent_process IS NOT NULL
            UNION ALL SELECT w.depends_on, w.process_name, p.time_qualifier FROM waits w JOIN procs p ON p.process_name = w.process_name) e USING (process_name))
        SELECT r.domain, r.process_name, r.timeperiod, coalesce(l.state, 'state_embryo') AS state,
          CASE WHEN coalesce(l.state, 'state_embryo') = 'state_embryo' THEN 'none' ELSE 'reprocess' END AS action
        FROM reach r LEFT JOIN ledger l USING (domain, process_name, timeperiod)""",
)
def _(spark, sf):
    return L.propagate_dirty(_changed(spark, sf), SITE_SUITE, V.ledger(spark, sf), by=BY)


# Skipped buckets: the site days with a purchase by a user of the site.
@query(
    "propagate_skip",
    f"""WITH seed AS (SELECT DISTINCT domain, 'site_daily' AS process_name, strftime(ts, '%Y%m%d00') AS timeperiod FROM ev WHERE event_type = 'purchase'),
        up AS (
          SELECT l.domain, l.process_name, l.timeperiod, l.state, p.depth, s.timeperiod AS day FROM ledger l JOIN procs p USING (process_name)
          JOIN seed s ON s.domain = l.domain AND (
            (l.process_name IN ('site_daily', 'client_daily') AND l.timeperiod = s.timeperiod)
            OR (l.process_name = 'site_hourly' AND substr(l.timeperiod,1,8)||'00' = s.timeperiod)))
        SELECT DISTINCT domain, process_name, timeperiod, state, CASE WHEN state IN {_DONE} THEN 'none' ELSE 'skip' END AS action FROM up""",
)
def _(spark, sf):
    days = (
        V.table(spark, sf, "events")
        .where("event_type = 'purchase'")
        .select(V.domain().alias("domain"), F.lit("site_daily").alias("process_name"), P.to_period(P.DAILY, "ts").alias("timeperiod"))
        .distinct()
    )
    return L.propagate_skip(days, SITE_SUITE, V.ledger_table(spark, sf), by=BY)


# ---- what to do next ------------------------------------------------------------------------

_SKIPPABLE = "CASE WHEN finished THEN true WHEN child_process IS NULL THEN number_of_failures > 3 ELSE coalesce(children_spoiled, true) END"


def _next(base: str) -> str:
    """SQL: the next bucket of every process, level by level over every bucket of the calendar."""
    out = (
        f"{_gaps(base)}, open AS (SELECT domain, process_name, timeperiod, parent_qualifier, NOT finished AND NOT ({_SKIPPABLE}) AS eligible FROM weighed"
        " UNION ALL SELECT w.domain, w.process_name, w.timeperiod, p.parent_qualifier, true FROM whole w JOIN procs p USING (process_name) WHERE NOT held),"
        f" pairs AS (SELECT domain, process_name, time_qualifier, tree_name, depth, {_current('time_qualifier')} AS current FROM procs, (SELECT DISTINCT domain FROM {base})),"
        " n0 AS (SELECT p.domain, p.tree_name, p.process_name, p.time_qualifier, coalesce(min(o.timeperiod) FILTER (WHERE o.eligible), any_value(p.current)) AS tp"
        " FROM pairs p LEFT JOIN open o USING (domain, process_name) WHERE p.depth = 0 GROUP BY ALL)"
    )
    for d, above in ((1, None), (2, "_yearly"), (3, "_monthly")):
        family = "true" if above is None else f"{V._cast(above, 'x.parent')} = {V._cast(above, 'n.tp')}"
        out += (
            f", n{d} AS (SELECT p.domain, p.tree_name, p.process_name, p.time_qualifier, coalesce(min(x.timeperiod) FILTER (WHERE x.eligible AND x.parent >= n.tp AND {family}), any_value(p.current)) AS tp"
            f" FROM pairs p JOIN n{d - 1} n USING (domain, tree_name) LEFT JOIN (SELECT *, {V.cast_by('parent_qualifier', 'timeperiod')} AS parent FROM open) x"
            f" ON x.domain = p.domain AND x.process_name = p.process_name WHERE p.depth = {d} GROUP BY ALL)"
        )
    return out + ", upcoming AS (" + " UNION ALL ".join(f"SELECT domain, process_name, tp FROM n{d}" for d in range(4)) + ")"


def _choosing(suffix, base, view):
    @query(f"should_skip{suffix}", f"WITH {_gaps(base)} SELECT domain, process_name, timeperiod, state, {_SKIPPABLE} AS skippable FROM weighed")
    def _(spark, sf):
        return L.should_skip(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN).select(*_KEY, "state", "skippable")

    @query(f"next_period{suffix}", f"WITH {_next(base)} SELECT domain, process_name, tp AS timeperiod FROM upcoming")
    def _(spark, sf):
        return L.next_period(view(spark, sf), SITE_SUITE, V.LEDGER_NOW, by=BY, start=V.SPINE_START)

    @query(
        f"audit{suffix}",
        f"""WITH {_gaps(base)}, later AS (SELECT j.domain, j.process_name, j.timeperiod, EXISTS (SELECT 1 FROM whole y WHERE y.domain = j.domain AND y.process_name = j.process_name
              AND y.timeperiod = {V.shift_by('j.time_qualifier', 'j.timeperiod', 1)} AND (j.parent_qualifier IS NULL OR {V.cast_by('j.parent_qualifier', 'y.timeperiod')} = {V.cast_by('j.parent_qualifier', 'j.timeperiod')})) AS younger_sibling
              FROM weighed j),
            a AS (SELECT domain, process_name, timeperiod, state, CASE WHEN finished AND child_active THEN 'reprocess'
              WHEN children_skipped AND younger_sibling AND state <> 'state_skipped' THEN 'skip' END AS action
            FROM weighed JOIN later USING (domain, process_name, timeperiod) WHERE number_of_children > 0) SELECT * FROM a WHERE action IS NOT NULL""",
    )
    def _(spark, sf):
        return L.audit(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN)


for _each in _LEDGERS:
    _choosing(*_each)


_SIBLING = f"""sib AS (SELECT j.domain, j.process_name, j.timeperiod, EXISTS (SELECT 1 FROM judged y WHERE y.domain = j.domain AND y.process_name = j.process_name
    AND y.timeperiod = {V.shift_by('j.time_qualifier', 'j.timeperiod', 1)} AND (j.parent_qualifier IS NULL OR {V.cast_by('j.parent_qualifier', 'y.timeperiod')} = {V.cast_by('j.parent_qualifier', 'j.timeperiod')})) AS younger_sibling
  FROM judged j)"""


@query("next_sibling", f"WITH {_SIBLING} SELECT * FROM sib")
def _(spark, sf):
    return L.has_next_sibling(V.ledger_table(spark, sf), SITE_SUITE, by=BY).select(*_KEY, "younger_sibling")


# ---- attempts -------------------------------------------------------------------------------


@query(
    "current_attempts",
    """SELECT l.domain, l.process_name, l.timeperiod, l.state, l.related_unit_of_work, a.state AS attempt_state FROM ledger l JOIN attempts a
       ON a.domain = l.domain AND a.process_name = l.process_name AND a.timeperiod = l.timeperiod AND a.attempt_id = l.related_unit_of_work
       WHERE a.state IN ('state_processed', 'state_canceled', 'state_noop') AND a.unit_of_work_type = 'type_managed'""",
)
def _(spark, sf):
    out = L.current_attempts(V.ledger(spark, sf), V.attempts_of(spark, sf), by=BY)
    return out.select(*_KEY, "state", "related_unit_of_work", "attempt_state")


@query(
    "settle",
    """SELECT l.domain, l.process_name, l.timeperiod, CASE a.state WHEN 'state_canceled' THEN 'state_skipped' ELSE a.state END AS state FROM ledger l JOIN attempts a
       ON a.domain = l.domain AND a.process_name = l.process_name AND a.timeperiod = l.timeperiod AND a.attempt_id = l.related_unit_of_work
       WHERE a.state IN ('state_processed', 'state_canceled', 'state_noop') AND a.unit_of_work_type = 'type_managed'""",
)
def _(spark, sf):
    return L.settle(V.ledger(spark, sf), V.attempts_of(spark, sf), by=BY).select(*_KEY, "state")


_SINCE = "2024012512"
_OVERVIEW_SINCE = "2024011812"


def _candidates(since: str) -> str:
    return f"""cand AS (SELECT * FROM attempts WHERE state IN ('state_in_progress', 'state_invalid', 'state_requested') AND unit_of_work_type = 'type_managed'
    AND timeperiod >= {V.cast_by('time_qualifier', f"'{since}'")})"""



@query("reprocess_candidates", f"WITH {_candidates(_SINCE)} SELECT attempt_id, domain, process_name, timeperiod, state FROM cand")
def _(spark, sf):
    out = L.reprocess_candidates(V.attempts_of(spark, sf), SITE_SUITE, _SINCE)
    return out.select("attempt_id", *_KEY, "state")


_TRIAGE = """tri AS (SELECT *, CASE WHEN NOT (unit_of_work_type = 'type_managed' AND state IN ('state_in_progress', 'state_invalid', 'state_requested')) THEN 'keep'
    WHEN created_at < TIMESTAMP '{now}' - INTERVAL 48 HOUR THEN 'cancel'
    WHEN submitted_at < TIMESTAMP '{now}' - INTERVAL 1 HOUR OR state = 'state_invalid' THEN 'resubmit' ELSE 'keep' END AS action FROM {source})"""


@query(
    "triage",
    f"""WITH {_TRIAGE.format(source='attempts', now='2024-01-31')} SELECT attempt_id, action, CASE action WHEN 'cancel' THEN 'state_canceled' WHEN 'resubmit' THEN 'state_requested' ELSE state END AS state,
        CASE WHEN action = 'resubmit' AND state = 'state_invalid' THEN number_of_retries + 1 ELSE number_of_retries END AS number_of_retries,
        strftime(CASE WHEN action = 'resubmit' THEN TIMESTAMP '2024-01-31' ELSE submitted_at END, '%Y%m%d%H%M%S') AS submitted FROM tri""",
)
def _(spark, sf):
    out = L.triage(V.attempts_of(spark, sf), SITE_SUITE, V.ATTEMPT_NOW)
    return out.select(
        "attempt_id", "action", "state", "number_of_retries", P.to_period(P.REAL_TIME, "submitted_at").alias("submitted")
    )


@query(
    "count_failures",
    """SELECT l.domain, l.process_name, l.timeperiod, l.number_of_failures + count(a.attempt_id) AS number_of_failures FROM ledger l
       LEFT JOIN (SELECT * FROM attempts WHERE state = 'state_invalid') a USING (domain, process_name, timeperiod)
       GROUP BY l.domain, l.process_name, l.timeperiod, l.number_of_failures""",
)
def _(spark, sf):
    lookups = V.attempts_of(spark, sf).withColumn("failed", S.is_invalid("state"))
    return L.count_failures(V.ledger(spark, sf), lookups, by=BY).select(*_KEY, "number_of_failures")


@query(
    "filter_ledger",
    "SELECT domain, process_name, timeperiod, state FROM ledger WHERE timeperiod >= '2024011000' AND state IN ('state_in_progress', 'state_embryo', 'state_final_run', 'state_skipped')",
)
def _(spark, sf):
    return L.filter_states(V.ledger(spark, sf), "2024011000", running=True, failed=True).select(*_KEY, "state")


@query(
    "filter_attempts",
    "SELECT attempt_id, state FROM attempts WHERE timeperiod >= '2024010500' AND unit_of_work_type = 'type_freerun' AND state IN ('state_processed', 'state_canceled', 'state_invalid')",
)
def _(spark, sf):
    out = L.filter_states(V.attempts_of(spark, sf), "2024010500", processed=True, failed=True, attempt=True)
    return out.select("attempt_id", "state")


@query(
    "state_flags",
    f"""SELECT domain, process_name, timeperiod, state IN {_ACTIVE} AS active, state IN {_DONE} AS finished, state = 'state_processed' AS processed,
        state = 'state_noop' AS noop, state = 'state_skipped' AS skipped, state = 'state_embryo' AS embryo, state = 'state_in_progress' AS in_progress,
        state = 'state_final_run' AS final_run FROM ledger""",
)
def _(spark, sf):
    flags = {
        "active": S.is_active, "finished": S.is_finished, "processed": S.is_processed, "noop": S.is_noop,
        "skipped": S.is_skipped, "embryo": S.is_embryo, "in_progress": S.is_in_progress, "final_run": S.is_final_run,
    }
    return V.ledger(spark, sf).select(*_KEY, *[fn("state").alias(n) for n, fn in flags.items()])


@query("known_only", "SELECT domain, process_name, timeperiod FROM ledger WHERE process_name NOT LIKE 'client%' AND process_name <> 'site_yearly'")
def _(spark, sf):
    ledger = V.ledger(spark, sf)
    known = SITE_SUITE.process_dim(spark).where("tree_name <> 'tree_client'")
    dim = known.withColumn("is_on", F.col("process_name") != "site_yearly")
    return L.known_only(ledger, dim).select(*_KEY)


@query(
    "with_details",
    """SELECT l.domain, l.process_name, l.timeperiod, l.related_unit_of_work, a.state AS attempt_state, a.number_of_retries FROM ledger l
       LEFT JOIN attempts a ON a.attempt_id = l.related_unit_of_work""",
)
def _(spark, sf):
    details = V.attempts_of(spark, sf).select(
        F.col("attempt_id").alias("related_unit_of_work"), F.col("state").alias("attempt_state"), "number_of_retries"
    )
    out = L.with_details(V.ledger(spark, sf), details, ["related_unit_of_work"])
    return out.select(*_KEY, "related_unit_of_work", "attempt_state", "number_of_retries")


@query("cap_events", "SELECT domain, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 129")
def _(spark, sf):
    events = V.table(spark, sf, "events").select(V.domain().alias("domain"), "ts", "event_id")
    return L.cap_events(events, ["domain"], "ts", "event_id", 128).select("domain", "event_id")


@query(
    "newest_children",
    "SELECT domain, process_name, timeperiod, state FROM ledger QUALIFY row_number() OVER (PARTITION BY domain, process_name ORDER BY timeperiod DESC) <= 168",
)
def _(spark, sf):
    return L.newest(V.ledger(spark, sf), ["domain", "process_name"], [F.desc("timeperiod")], 168).select(*_KEY, "state")


# ---- reports ------------------------------------------------------------------------------


_PARTIAL = C.Catalog(
    [C.Process("site_hourly", P.HOURLY), C.Process("site_daily", P.DAILY), C.Process("client_daily", P.MONTHLY)],
    [C.Tree("tree_site", ("site_daily", "site_hourly")), C.Tree("tree_client", ("client_daily",))],
)


@query(
    "ledger_orphans",
    """SELECT process_name, CASE WHEN process_name = 'client_daily' THEN 'other_granularity' ELSE 'no_tree' END AS reason, count(*) AS n
       FROM ledger WHERE process_name NOT IN ('site_hourly', 'site_daily') GROUP BY 1, 2""",
)
def _(spark, sf):
    return L.ledger_orphans(V.ledger(spark, sf), _PARTIAL)


@query("jobs_by_process", "SELECT process_name, domain, timeperiod, state FROM ledger ORDER BY 1, 2, 3")
def _(spark, sf):
    return L.jobs_by_process(V.ledger(spark, sf), by=BY).select("process_name", "domain", "timeperiod", "state")


@query(
    "state_matrix",
    f"""WITH {_SPINE} SELECT s.domain, s.process_name, s.timeperiod, l.state FROM spine s
        LEFT JOIN ledger l ON l.domain = s.domain AND l.process_name = s.process_name AND l.timeperiod = s.timeperiod""",
)
def _(spark, sf):
    return L.state_matrix(V.ledger(spark, sf), SITE_SUITE, V.SPINE_START, V.LEDGER_NOW, by=BY)


def _detailing(suffix, base, view):
    @query(
        f"node_details{suffix}",
        f"""WITH {_gaps(base)} SELECT domain, process_name, timeperiod, time_qualifier, state, CAST(number_of_failures AS VARCHAR) AS number_of_failures,
           coalesce(number_of_children, 0) AS number_of_children FROM weighed""",
    )
    def _(spark, sf):
        return L.node_details(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN).drop("children")

    @query(
        f"node_children{suffix}",
        f"""WITH {_gaps(base)} SELECT w.domain, p.parent_process AS process_name, {V.cast_by('p.parent_qualifier', 'w.timeperiod')} AS timeperiod, w.timeperiod AS child,
            CASE WHEN w.held THEN w.state ELSE 'NA' END AS state
            FROM whole w JOIN procs p USING (process_name) JOIN {base} m ON m.domain = w.domain AND m.process_name = p.parent_process
            AND m.timeperiod = {V.cast_by('p.parent_qualifier', 'w.timeperiod')}""",
    )
    def _(spark, sf):
        rows = L.node_details(view(spark, sf), SITE_SUITE, by=BY, span=_SPAN).select(*_KEY, F.explode("children").alias("c"))
        return rows.select(*_KEY, F.col("c.timeperiod").alias("child"), F.col("c.state").alias("state"))


for _each in _LEDGERS:
    _detailing(*_each)


@query(
    "node_event_log",
    f"""WITH logged AS (SELECT domain, 'site_hourly' AS process_name, strftime(ts, '%Y%m%d%H') AS timeperiod, ts, event_type || ' ' || event_id AS message FROM ev
          UNION ALL SELECT domain, 'site_monthly', strftime(ts, '%Y%m0000'), ts, event_type || ' ' || event_id FROM ev)
        SELECT domain, process_name, timeperiod, CAST(row_number() OVER w - 1 AS INT) AS position, message FROM logged
        WINDOW w AS (PARTITION BY domain, process_name, timeperiod ORDER BY ts DESC, message DESC) QUALIFY row_number() OVER w <= {L.MAX_EVENTS + 1}""",
)
def _(spark, sf):
    out = L.node_details(V.ledger_table(spark, sf), SITE_SUITE, by=BY, events=V.bucket_log(spark, sf))
    return out.select(*_KEY, F.posexplode("event_log").alias("position", "e")).select(*_KEY, "position", F.col("e.message").alias("message"))


_DAYS = [f"202401{d:02d}00" for d in range(1, 21)]


@query(
    "state_matrix_wide",
    f"""SELECT d.domain, p.process_name, {', '.join(f"max(state) FILTER (WHERE timeperiod = '{d}') AS \"{d}\"" for d in _DAYS)}
        FROM (SELECT DISTINCT domain FROM ledger) d CROSS JOIN (SELECT process_name FROM procs WHERE time_qualifier = '_daily') p LEFT JOIN ledger USING (domain, process_name) GROUP BY ALL""",
)
def _(spark, sf):
    return L.state_matrix_wide(V.ledger(spark, sf), SITE_SUITE, P.DAILY, V.SPINE_START, V.LEDGER_NOW, by=BY)


_KINDS = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'daemon' ELSE 'managed' END"


def _definitions(spark, sf):
    """Declared definitions from customers with money, stored ones from all who ordered."""
    customers = V.table(spark, sf, "customer")
    declared = customers.where("c_acctbal >= 0").select(
        F.col("c_name").alias("process_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "daemon").otherwise("managed").alias("kind"),
        F.lit("every 60").alias("trigger_frequency"),
    )
    orders = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    stored = orders.where("n >= 10").join(customers, "c_custkey").select(
        F.col("c_name").alias("process_name"), F.lit("managed").alias("kind"), F.concat(F.lit("every "), F.col("n").cast("string")).alias("trigger_frequency")
    )
    return declared, stored


_DEFS = f"""declared AS (SELECT c_name AS process_name, {_KINDS} AS kind, 'every 60' AS trigger_frequency FROM customer WHERE c_acctbal >= 0),
  stored AS (SELECT c_name AS process_name, 'managed' AS kind, 'every ' || n AS trigger_frequency FROM customer JOIN
    (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10) ON o_custkey = c_custkey)"""


@query(
    "reconcile_definitions",
    f"""WITH {_DEFS} SELECT d.process_name, d.kind, CASE WHEN d.kind = 'managed' THEN coalesce(s.trigger_frequency, d.trigger_frequency) ELSE d.trigger_frequency END AS trigger_frequency
        FROM declared d LEFT JOIN stored s USING (process_name)""",
)
def _(spark, sf):
    return L.reconcile_dim(*_definitions(spark, sf))[0]


@query(
    "reconcile_left_out",
    f"""WITH {_DEFS} SELECT s.process_name, CASE WHEN d.kind IS NULL THEN 'undeclared' ELSE 'other_kind' END AS reason
        FROM stored s LEFT JOIN declared d USING (process_name) WHERE d.kind IS NULL OR d.kind <> 'managed'""",
)
def _(spark, sf):
    return L.reconcile_dim(*_definitions(spark, sf))[1]


_TRIGGERS = ", ".join(f"('{n}', {SITE_SUITE.processes[n].trigger.split()[1]})" for n in SITE_SUITE.tree_of)


@query(
    "process_overview",
    f"""WITH {_next('ledger')}, {_candidates(_OVERVIEW_SINCE)}, {_TRIAGE.format(source='cand', now='2024-01-20 12:30:00')}, q AS (SELECT domain, process_name, string_agg(timeperiod, ',' ORDER BY timeperiod) AS queue FROM
          (SELECT DISTINCT domain, process_name, timeperiod FROM tri WHERE action = 'resubmit') GROUP BY 1, 2)
        , trig(process_name, seconds) AS (VALUES {_TRIGGERS})
        SELECT u.domain, u.process_name, strftime({_NOW} + to_seconds(t.seconds), '%Y%m%d%H%M%S') AS next_trigger, u.tp AS next_timeperiod, coalesce(q.queue, '') AS reprocessing_queue, p.blocking_type,
          CASE WHEN p.tree_name = 'tree_site' THEN 'tree_client' ELSE '' END AS dependent_trees
        FROM upcoming u JOIN procs p USING (process_name) JOIN trig t USING (process_name) LEFT JOIN q USING (domain, process_name)""",
)
def _(spark, sf):
    out = L.process_overview(
        V.ledger_table(spark, sf), V.attempts_of(spark, sf), SITE_SUITE, V.LEDGER_NOW, since=_OVERVIEW_SINCE, by=BY, start=V.SPINE_START
    )
    return out.select(
        "domain", "process_name", P.to_period(P.REAL_TIME, "next_trigger").alias("next_trigger"), "next_timeperiod", F.array_join("reprocessing_queue", ",").alias("reprocessing_queue"),
        "blocking_type", "dependent_trees",
    )


@query(
    "refresh_targets",
    f"""SELECT l.domain, l.process_name, l.timeperiod, w.process_name AS target FROM ledger l JOIN waits w ON w.depends_on = l.process_name
        WHERE l.state IN {_DONE} AND w.process_name = 'client_daily'""",
)
def _(spark, sf):
    return L.refresh_targets(V.ledger(spark, sf), SITE_SUITE, by=BY)


@query(
    "ledger_since",
    """SELECT domain, process_name, timeperiod FROM ledger WHERE timeperiod >= CASE time_qualifier WHEN '_monthly' THEN '2024010000' WHEN '_yearly' THEN '2024000000' ELSE '2024011300' END""",
)
def _(spark, sf):
    return ledger_since(V.ledger(spark, sf), "2024011300").select(*_KEY)


