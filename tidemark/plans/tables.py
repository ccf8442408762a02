"""Queries: scans, keyed changes and bucket writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import text as T
from tidemark.operators import rollup
from tidemark.operators.stats import RangeJob, attempt_row
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.sources import envelope, keyed, scans, shared, writes
from tidemark.streaming import sessions as stream_sessions


def _orders(spark, sf):
    """Orders keyed by day, with money in whole cents."""
    return V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"),
        P.to_period(P.DAILY, "o_orderdate").alias("timeperiod"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_orderdate").alias("created_at"),
    )


_O = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS custkey, strftime(o_orderdate, '%Y%m%d00') AS timeperiod, o_orderstatus AS status,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS created_at FROM orders)"""
_COLS = "id, custkey, timeperiod, status, cents"


@query("scan_periods", f"{_O} SELECT {_COLS} FROM o WHERE timeperiod >= '1996010100' AND timeperiod < '2000010100'")
def _(spark, sf):
    return scans.scan_periods(_orders(spark, sf), "1996010100", "2000010100", ts="created_at").drop("created_at")


@query(
    "scan_keys",
    f"{_O} SELECT {_COLS} FROM o WHERE id BETWEEN 100 AND 1000000000 AND timeperiod >= '1996010100' AND timeperiod < '2000010100'",
)
def _(spark, sf):
    return scans.scan_keys(_orders(spark, sf), 100, 1_000_000_000, "1996010100", "2000010100", ts="created_at").drop("created_at")


@query(
    "key_bounds",
    f"{_O} SELECT min(id) AS lowest_key, max(id) AS highest_key FROM o WHERE timeperiod >= '1996010100' AND timeperiod < '2000010100'",
)
def _(spark, sf):
    return scans.key_bounds(_orders(spark, sf), "1996010100", "2000010100", ts="created_at")


@query("scan_since", f"{_O} SELECT {_COLS} FROM o WHERE timeperiod >= '1998060000'")
def _(spark, sf):
    return scans.scan_since(_orders(spark, sf), "1998060000", ts="created_at").drop("created_at")


@query("predicate_scan", f"{_O} SELECT {_COLS} FROM o WHERE status IN ('F', 'P') AND cents >= 1000000")
def _(spark, sf):
    return _orders(spark, sf).where(F.col("status").isin("F", "P") & (F.col("cents") >= 1000000)).drop("created_at")


def _wanted(spark, sf):
    """Keys to look up: the order of every shipped line, and one beyond each, some of which do not exist."""
    lines = V.table(spark, sf, "lineitem").select(F.explode(F.array("l_orderkey", F.col("l_orderkey") + 1)).alias("id"))
    return lines


_WANTED = "(SELECT l_orderkey AS id FROM lineitem UNION SELECT l_orderkey + 1 FROM lineitem)"


@query("lookup_keys", f"{_O} SELECT {_COLS} FROM o WHERE id IN (SELECT id FROM {_WANTED})")
def _(spark, sf):
    return scans.lookup(_orders(spark, sf), _wanted(spark, sf), ["id"]).drop("created_at")


@query("lookup_misses", f"{_O} SELECT id FROM {_WANTED} WHERE id NOT IN (SELECT id FROM o)")
def _(spark, sf):
    return scans.lookup_misses(_orders(spark, sf), _wanted(spark, sf), ["id"])


@query("retention", f"{_O} SELECT {_COLS} FROM o WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY")
def _(spark, sf):
    return scans.expire(_orders(spark, sf), "created_at", 365, datetime(2001, 8, 1)).drop("created_at")


@query("duplicate_keys", f"{_O} SELECT custkey, timeperiod, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return scans.duplicate_keys(_orders(spark, sf), ["custkey", "timeperiod"])


@query(
    "run_statistics",
    _O + """, years AS (SELECT unnest(range((SELECT year(min(created_at)) FROM o), (SELECT year(max(created_at)) + 1 FROM o))) AS y)
      SELECT y || '010100' AS start_timeperiod, 'state_processed' AS state, count(id) AS number_of_processed_documents,
        count(DISTINCT substr(timeperiod, 1, 6)) AS number_of_aggregated_documents FROM years LEFT JOIN o ON year(created_at) = y GROUP BY y""",
)
def _(spark, sf):
    """Runs of a monthly sum, one for each year of the table, each counting what it reads and writes."""
    base, orders = shared.fresh_dir(spark, "runs"), _orders(spark, sf)

    def months(rows, start, end):
        return rows.groupBy(P.coarsen_period(P.MONTHLY, "timeperiod").alias("timeperiod")).agg(F.sum("cents").alias("cents"))

    first, last = orders.agg(F.min("created_at"), F.max("created_at")).first()
    out = []
    for year in range(first.year, last.year + 1) if first else ():
        start, end = f"{year}010100", f"{year + 1}010100"
        job = RangeJob(months, lambda df, start=start: df.write.parquet(f"{base}/start={start}"), ts="created_at")
        out.append(attempt_row(job.run(orders, start, end), P.MONTHLY, start))
    columns = "start_timeperiod string, state string, number_of_processed_documents long, number_of_aggregated_documents long"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in columns.split(", ")) for r in out], columns)


# ---- keyed changes -------------------------------------------------------------------


_SPLIT = "1998060000"


def _held_and_new(spark, sf):
    """Customers with their orders up to a date (the table), and every later order (the changes, several a customer)."""
    orders = _orders(spark, sf)
    held = orders.where(F.col("timeperiod") < _SPLIT).groupBy("custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("id").alias("id")
    )
    return held, orders.where(F.col("timeperiod") >= _SPLIT).select("custkey", F.lit(1).cast("bigint").alias("n"), "cents", "id")


_FO = (
    _O
    + f""", t AS (SELECT custkey, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(id) AS id FROM o WHERE timeperiod < '{_SPLIT}' GROUP BY 1),
  c AS (SELECT custkey, CAST(1 AS BIGINT) AS n, cents, id, row_number() OVER (PARTITION BY custkey ORDER BY id) AS nth,
    count(*) OVER (PARTITION BY custkey) AS of FROM o WHERE timeperiod >= '{_SPLIT}')"""
)
_KEYS = ["custkey"]
_IN_C = "t.custkey IN (SELECT custkey FROM c)"
_IN_T = "c.custkey IN (SELECT custkey FROM t)"


@query("upsert_rows", f"{_FO} SELECT * FROM t WHERE NOT {_IN_C} UNION ALL SELECT custkey, n, cents, id FROM c WHERE nth = of")
def _(spark, sf):
    return writes.upsert(*_held_and_new(spark, sf), _KEYS, ["id"])


@query("insert_new", f"{_FO} SELECT custkey, n, cents, id FROM c WHERE NOT {_IN_T} AND nth = 1")
def _(spark, sf):
    return writes.insert_new(*_held_and_new(spark, sf), _KEYS, ["id"])[0]


@query(
    "insert_existing",
    f"{_FO} SELECT * FROM t WHERE {_IN_C} UNION ALL SELECT custkey, n, cents, id FROM c WHERE NOT {_IN_T} AND nth = 1 AND of > 1",
)
def _(spark, sf):
    return writes.insert_new(*_held_and_new(spark, sf), _KEYS, ["id"])[1]


@query("delete_keys", f"{_FO} SELECT * FROM t WHERE NOT {_IN_C}")
def _(spark, sf):
    return writes.delete_keys(*_held_and_new(spark, sf), _KEYS)


def _keyed(spark, sf):
    """The held customers in ranges of 100 or a multiple, and the changes."""
    held, new = _held_and_new(spark, sf)
    table = keyed.KeyedTable(shared.fresh_dir(spark, "keyed"), "custkey", 100)
    table.upsert(held)
    return table, new


@query("keyed_upsert", f"{_FO} SELECT * FROM t WHERE NOT {_IN_C} UNION ALL SELECT custkey, n, cents, id FROM c WHERE nth = of")
def _(spark, sf):
    table, new = _keyed(spark, sf)
    table.upsert(new, ["id"])
    return table.read(spark, new.schema)


@query(
    "keyed_insert_refused",
    f"{_FO} SELECT custkey, n, cents, id, CASE WHEN {_IN_T} THEN 'held' ELSE 'repeated' END AS reason FROM c WHERE {_IN_T} OR nth > 1",
)
def _(spark, sf):
    """Later orders of customers the table holds, and all but the first of those it doesn't."""
    table, new = _keyed(spark, sf)
    return table.insert(new, ["id"])


@query("keyed_lookup", f"{_FO} SELECT * FROM t WHERE {_IN_C}")
def _(spark, sf):
    table, new = _keyed(spark, sf)
    return table.lookup(new, new.schema)


def _log(spark, sf, old: bool | None = None):
    """All events as messages, or those of the kinds that are logged already, or all others."""
    events = V.table(spark, sf, "events")
    if old is not None:
        kind = F.col("event_type").isin("error", "purchase")
        events = events.where(kind if old else ~kind)
    return events.select(
        V.domain().alias("parent_object_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" "), "props").alias("message")
    )


_LOG = "SELECT domain AS parent_object_id, ev.event_id AS seq, ev.event_type || ' ' || e.props AS message FROM ev JOIN events e USING (event_id)"


@query("append_log", _LOG)
def _(spark, sf):
    return writes.append_log(_log(spark, sf, True), _log(spark, sf, False))


@query(
    "attach_log",
    f"{_LOG} WHERE domain NOT IN (SELECT 'domain_' || c_custkey FROM customer WHERE c_acctbal < 0)",
)
def _(spark, sf):
    debtors = V.table(spark, sf, "customer").where("c_acctbal < 0")
    parents = debtors.select(F.concat(F.lit("domain_"), F.col("c_custkey").cast("string")).alias("parent_object_id"))
    return writes.attach_log(_log(spark, sf), parents)


@query(
    "write_buckets",
    """WITH d AS (SELECT domain, substr(timeperiod,1,8)||'00' AS timeperiod, CAST(sum(number_of_visits) AS BIGINT) AS number_of_visits,
       CAST(sum(number_of_pageviews) AS BIGINT) AS number_of_pageviews, CAST(sum(total_duration) AS BIGINT) AS total_duration FROM site GROUP BY 1, 2)
       SELECT * FROM d WHERE timeperiod NOT BETWEEN '2024010500' AND '2024011400' OR (timeperiod >= '2024011000' AND number_of_visits > 2)""",
)
def _(spark, sf):
    """All days, then ten of them anew: five lose some rows, five lose all."""
    days = rollup.rollup_periods(rollup.site_hourly(V.sessions_of(spark, sf)), P.DAILY)
    path = shared.fresh_dir(spark, "site-daily")
    writes.write_buckets(days, path)
    schema = "domain string, number_of_visits long, number_of_pageviews long, total_duration long, timeperiod string"
    again = writes.read_buckets(spark, path, schema).where("timeperiod between '2024010500' and '2024011400'")
    left = writes.read_buckets(spark, path, schema).where("timeperiod between '2024011000' and '2024011400' and number_of_visits > 2")
    redone = shared.fresh_dir(spark, "site-redone")  # a job never overwrites files that it reads
    left.write.parquet(redone)
    writes.write_buckets(spark.read.schema(schema).parquet(redone), path, recomputed=again.select("timeperiod").distinct())
    return writes.read_buckets(spark, path, schema)


@query("replace_table", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    base = shared.fresh_dir(spark, "customers")
    definition = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    writes.replace_table(definition.where("c_acctbal < 0"), base, "1")
    writes.replace_table(definition, base, "2")
    return writes.read_version(spark, base, "2")


# ---- messages and text ---------------------------------------------------------------


_HIT = ["event_id", "domain", "session_id", "ip", "screen_x", "screen_y", "os", "browser", "language", "country", "is_page_view"]


@query("json_round_trip", f"SELECT {', '.join(_HIT)}, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS sent_at FROM hits")
def _(spark, sf):
    """Every hit written to files as a message, and read back from them."""
    path = shared.fresh_dir(spark, "messages")
    envelope.to_envelope(V.hits_of(spark, sf)).write.text(path)
    good, _ = envelope.split_bad_records(spark.read.text(path))
    return good.select(*_HIT, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sent_at"))


@query("stream_json_sessions", "SELECT domain, session_id, number_of_entries, number_of_pageviews, total_duration FROM sessions")
def _(spark, sf):
    """The same files read as a stream of messages."""
    path, base = shared.fresh_dir(spark, "message-stream"), shared.fresh_dir(spark, "json-sessions")
    envelope.to_envelope(V.hits_of(spark, sf)).write.text(path)
    stream_sessions.stream_messages(envelope.read_messages(spark, path), base).awaitTermination()
    return stream_sessions.read_sessions(spark, base).select("domain", "session_id", "number_of_entries", "number_of_pageviews", "total_duration")


@query(
    "json_strings",
    """SELECT event_id, '{"event_id":"' || event_id || '","os":"' || coalesce(os, 'None') || '","is_page_view":"' ||
       CASE WHEN is_page_view THEN 'True' ELSE 'False' END || '","screen":{"x":"' || coalesce(CAST(screen_x AS VARCHAR), 'None') ||
       '","y":"' || coalesce(CAST(screen_y AS VARCHAR), 'None') || '"}}' AS json FROM hits""",
)
def _(spark, sf):
    hits = V.hits_of(spark, sf)
    screen = F.struct(F.col("screen_x").alias("x"), F.col("screen_y").alias("y")).alias("screen")
    return T.stringify_json(hits.select("event_id", "os", "is_page_view", screen), "event_id")


@query(
    "utf8_truncate",
    """SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 21), lambda k: strlen(substr(text, 1, k)) <= 20))) AS head,
       substr(text, 1, list_max(list_filter(range(0, 8), lambda k: strlen(substr(text, 1, k)) <= 7))) AS shorter FROM documents""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", T.utf8_truncate("text", 20).alias("head"), T.utf8_truncate("text", 7).alias("shorter"))


@query(
    "partition_uris",
    """WITH u AS (SELECT doc_id, 's3://' || source || '/' || lang || '/' || doc_id AS uri FROM documents)
       SELECT doc_id, uri, regexp_extract(uri, '^(.*)/([^/]*/[^/]*)$', 1) AS root, regexp_extract(uri, '^(.*)/([^/]*/[^/]*)$', 2) AS path FROM u""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents")
    uris = docs.select("doc_id", T.partition_uri("source", "lang", F.col("doc_id").cast("string")).alias("uri"))
    return uris.withColumn("_s", T.split_uri("uri")).select("doc_id", "uri", "_s.root", "_s.path")


@query(
    "composite_names",
    """WITH n AS (SELECT event_id, coalesce(os, 'None') || '::' || coalesce(browser, 'None') || '::' || language AS name FROM hits)
       SELECT event_id, name, split_part(name, '::', 1) AS prefix, substr(name, length(split_part(name, '::', 1)) + 3) AS suffix FROM n""",
)
def _(spark, sf):
    pair = T.build_name("os", F.concat(F.coalesce("browser", F.lit("None")), F.lit("::"), F.col("language")))
    names = V.hits_of(spark, sf).select("event_id", pair.alias("name"))
    return names.withColumn("_s", T.split_name("name")).select("event_id", "name", "_s.prefix", "_s.suffix")


@query("name_like", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, 'CUSTOMER#0000000*', 'i')")
def _(spark, sf):
    customers = V.table(spark, sf, "customer").select("c_custkey", "c_name")
    return customers.where(T.name_like("c_name", "CUSTOMER#0000000"))


@query(
    "overlay_maps",
    """SELECT event_id, 'os' AS name, coalesce(os, 'none') AS value FROM hits
       UNION ALL SELECT event_id, 'language', language FROM hits
       UNION ALL SELECT event_id, 'country', CASE WHEN is_page_view THEN 'view' ELSE country END FROM hits""",
)
def _(spark, sf):
    lit = F.lit
    process = F.create_map(lit("os"), lit("none"), lit("country"), F.col("country"))
    entry = F.create_map(lit("os"), F.coalesce("os", lit("none")), lit("language"), F.col("language"))
    request = F.when(F.col("is_page_view"), F.create_map(lit("country"), lit("view")))
    merged = V.hits_of(spark, sf).select("event_id", T.overlay_maps(process, entry, request).alias("m"))
    return merged.select("event_id", F.explode("m").alias("name", "value"))
