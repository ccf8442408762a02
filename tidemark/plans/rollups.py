"""Queries: sessions, roll-ups, owners and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.operators import compare, rollup, sessions
from tidemark.operators.stats import throughput
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.sources import shared

LEVELS = (P.YEARLY, P.MONTHLY, P.DAILY, P.HOURLY)

_SUMS = """CAST(sum(number_of_visits) AS BIGINT) AS number_of_visits,
  CAST(sum(number_of_pageviews) AS BIGINT) AS number_of_pageviews, CAST(sum(total_duration) AS BIGINT) AS total_duration"""


@query("sessions", "SELECT * FROM sessions")
def _(spark, sf):
    return V.sessions_of(spark, sf)


@query(
    "session_entries",
    """SELECT domain, session_id, row_number() OVER (PARTITION BY domain, session_id ORDER BY ts, event_id) - 1 AS entry_index,
       strftime(ts, '%Y%m%d%H%M%S') AS entry_timestamp FROM hits""",
)
def _(spark, sf):
    return sessions.session_entries(V.hits_of(spark, sf))


def _site(spark, sf):
    return rollup.site_hourly(V.sessions_of(spark, sf))


def _hist(spark, sf):
    return rollup.site_hourly_histograms(V.sessions_of(spark, sf))


@query("site_hourly", "SELECT * FROM site")
def _(spark, sf):
    return _site(spark, sf)


@query("site_hist_hourly", "SELECT * FROM hist")
def _(spark, sf):
    return _hist(spark, sf)


def _register_level(q: str) -> None:
    label, tp = q.strip("_"), V._cast(q, "timeperiod")

    # any level is a sum of any finer one, so each is taken straight from the sessions' hours
    @query(f"site_{label}", f"SELECT domain, {tp} AS timeperiod, {_SUMS} FROM site GROUP BY 1, 2")
    def _(spark, sf):
        hours = V.sessions_of(spark, sf).withColumn("timeperiod", P.coarsen_period(q, "timeperiod"))
        return rollup.site_hourly(hours)

    @query(
        f"site_hist_{label}",
        f"SELECT domain, {tp} AS timeperiod, family, key, CAST(sum(cnt) AS BIGINT) AS cnt FROM hist GROUP BY 1, 2, 3, 4",
    )
    def _(spark, sf):
        hours = V.sessions_of(spark, sf).withColumn("timeperiod", P.coarsen_period(q, "timeperiod"))
        return rollup.site_hourly_histograms(hours)

    if q == P.DAILY:
        owned = "SELECT client_id, domain, substr(timeperiod,1,8)||'00' AS timeperiod, number_of_visits, number_of_pageviews, total_duration FROM site JOIN owners USING (domain)"
    else:
        owned = f"SELECT client_id, domain, {tp} AS timeperiod, number_of_visits, number_of_pageviews, total_duration FROM site JOIN owners USING (domain)"

    @query(f"client_{label}", f"SELECT client_id, timeperiod, {_SUMS} FROM ({owned}) GROUP BY 1, 2")
    def _(spark, sf):
        days = rollup.rollup_periods(_site(spark, sf), P.DAILY)
        clients = compare.client_daily(days, V.owners(spark, sf))
        return clients if q == P.DAILY else rollup.rollup_periods(clients, q)


for _q in (P.DAILY, P.MONTHLY, P.YEARLY):
    _register_level(_q)


@query(
    "client_hist_daily",
    """SELECT client_id, substr(timeperiod,1,8)||'00' AS timeperiod, family, key, CAST(sum(cnt) AS BIGINT) AS cnt
       FROM hist JOIN owners USING (domain) GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    days = rollup.rollup_histograms(_hist(spark, sf), P.DAILY)
    return compare.client_daily_histograms(days, V.owners(spark, sf))


def _register_client_histograms(q: str) -> None:
    @query(
        f"client_hist_{q.strip('_')}",
        f"""SELECT client_id, {V._cast(q, 'timeperiod')} AS timeperiod, family, key, CAST(sum(cnt) AS BIGINT) AS cnt
            FROM hist JOIN owners USING (domain) GROUP BY 1, 2, 3, 4""",
    )
    def _(spark, sf):
        days = rollup.rollup_histograms(_hist(spark, sf), P.DAILY)
        clients = compare.client_daily_histograms(days, V.owners(spark, sf))
        return rollup.rollup_histograms(clients, q)


for _q in (P.MONTHLY, P.YEARLY):
    _register_client_histograms(_q)


@query(
    "owner_rejects",
    f"""SELECT domain, substr(timeperiod,1,8)||'00' AS timeperiod, {_SUMS} FROM site
        WHERE domain NOT IN (SELECT domain FROM owners) GROUP BY 1, 2""",
)
def _(spark, sf):
    days = rollup.rollup_periods(_site(spark, sf), P.DAILY)
    return compare.assign_owner(days, V.owners(spark, sf))[1]


_ALL_LEVELS = " UNION ALL ".join(
    f"SELECT domain, '{q}' AS time_qualifier, {V._cast(q, 'timeperiod')} AS timeperiod, {_SUMS} FROM site GROUP BY 1, 2, 3"
    for q in LEVELS
)


@query("rollup_all_levels", _ALL_LEVELS)
def _(spark, sf):
    return rollup.rollup_levels(_site(spark, sf), LEVELS)


@query("rollup_chain_hour_to_year", _ALL_LEVELS)
def _(spark, sf):
    tables = rollup.rollup_chain(_site(spark, sf), LEVELS, store=shared.fresh_dir(spark, "chain"))
    out = None
    for q, df in tables.items():
        df = df.withColumn("time_qualifier", F.lit(q))
        out = df if out is None else out.unionByName(df)
    return out


def _orders_spec(q: str) -> rollup.AggSpec:
    return rollup.AggSpec(
        keys={"segment": F.col("c_mktsegment"), "timeperiod": P.to_period(q, "o_orderdate")},
        measures={
            "orders": F.count(F.lit(1)),
            "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")),
        },
        families={"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")},
    )


def _segment_orders(spark, sf):
    orders, customers = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"


def _register_orders(q: str, pattern: str) -> None:
    label = q.strip("_")

    @query(
        f"orders_{label}",
        f"""SELECT c_mktsegment AS segment, strftime(o_orderdate, '{pattern}') AS timeperiod, count(*) AS orders,
            CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents {_ORDERS} GROUP BY 1, 2""",
    )
    def _(spark, sf):
        return _orders_spec(q).counters(_segment_orders(spark, sf))

    @query(
        f"orders_hist_{label}",
        f"""SELECT segment, timeperiod, family, key, count(*) AS cnt FROM (
            SELECT c_mktsegment AS segment, strftime(o_orderdate, '{pattern}') AS timeperiod, 'status' AS family, o_orderstatus AS key {_ORDERS}
            UNION ALL SELECT c_mktsegment, strftime(o_orderdate, '{pattern}'), 'priority', o_orderpriority {_ORDERS}) GROUP BY ALL""",
    )
    def _(spark, sf):
        return _orders_spec(q).histograms(_segment_orders(spark, sf))


_register_orders(P.MONTHLY, "%Y%m0000")
_register_orders(P.YEARLY, "%Y000000")


@query(
    "lineitem_chain",
    """SELECT l_returnflag, time_qualifier, timeperiod, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM (
       SELECT l_returnflag, l_quantity, '_daily' AS time_qualifier, strftime(l_shipdate, '%Y%m%d00') AS timeperiod FROM lineitem
       UNION ALL SELECT l_returnflag, l_quantity, '_monthly', strftime(l_shipdate, '%Y%m0000') FROM lineitem
       UNION ALL SELECT l_returnflag, l_quantity, '_yearly', strftime(l_shipdate, '%Y000000') FROM lineitem) GROUP BY ALL""",
)
def _(spark, sf):
    days = (
        V.table(spark, sf, "lineitem")
        .groupBy("l_returnflag", P.to_period(P.DAILY, "l_shipdate").alias("timeperiod"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )
    return rollup.rollup_levels(days, (P.DAILY, P.MONTHLY, P.YEARLY), values=("lines", "quantity"))


@query("sum_maps", "SELECT domain, family, key, CAST(sum(cnt) AS BIGINT) AS cnt FROM hist GROUP BY 1, 2, 3")
def _(spark, sf):
    packed = rollup.pack_maps(_hist(spark, sf), ["domain", "timeperiod"])
    return rollup.sum_maps(packed, ["domain"], {f: F.col(f) for f in rollup.FAMILIES})


_WEEK = """WITH days AS (SELECT domain, substr(timeperiod,1,8)||'00' AS timeperiod, sum(number_of_visits) AS v, sum(number_of_pageviews) AS p
  FROM site GROUP BY 1, 2), pairs AS (SELECT a.domain, a.timeperiod, a.v, a.p, b.v AS bv, b.p AS bp FROM days a JOIN days b
  ON a.domain = b.domain AND strptime(substr(b.timeperiod,1,8), '%Y%m%d') = strptime(substr(a.timeperiod,1,8), '%Y%m%d') - INTERVAL 7 DAY)"""


@query(
    "alert_weekly",
    _WEEK
    + """ SELECT domain, timeperiod, CAST(v - bv AS BIGINT) AS number_of_visits, CAST(p - bp AS BIGINT) AS number_of_pageviews
  FROM pairs WHERE bv <> 0 AND bp <> 0 AND (v::DOUBLE / bv < 0.8 OR v::DOUBLE / bv > 1.2 OR p::DOUBLE / bp < 0.8 OR p::DOUBLE / bp > 1.2)""",
)
def _(spark, sf):
    return compare.period_alert(rollup.rollup_periods(_site(spark, sf), P.DAILY))


@query("alert_rejects", _WEEK + " SELECT domain, timeperiod FROM pairs WHERE bv = 0 OR bp = 0")
def _(spark, sf):
    return compare.alert_rejects(rollup.rollup_periods(_site(spark, sf), P.DAILY))


def _register_throughput(name: str, width: str, unit: str) -> None:
    @query(
        name,
        f"""SELECT strftime(date_trunc('{unit}', ts), '%Y%m%d%H%M%S') AS tick, count(*) FILTER (WHERE event_type <> 'error') AS success,
            count(*) FILTER (WHERE event_type = 'error') AS failure FROM ev GROUP BY 1""",
    )
    def _(spark, sf):
        counts = throughput(V.table(spark, sf, "events"), width, ok=F.col("event_type") != "error")
        return counts.withColumn("tick", P.to_period(P.REAL_TIME, "tick"))


_register_throughput("throughput_tick", "60 seconds", "minute")
_register_throughput("throughput_day", "24 hours", "day")
