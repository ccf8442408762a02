"""Questions asked of a ledger of (process, bucket) states.

A ledger row is ``[by...], process_name, timeperiod, state, number_of_failures``. The
``by`` columns scope it (for example one ledger per site), so the ledger grows with the
data while the catalog of processes stays as small as its declaration. A null state
means the bucket is known but has no record yet; it counts as the initial state.

A bucket's key (scope, process, period) is unique, so no join here is skewed, and all
parents and siblings are found by equality on computed keys: no range join, no cross
join, no collected history.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.functions.schedule import next_trigger
from tidemark.operators.spine import Span, expected_children, in_span, level_bounds, period_spine
from tidemark.plans import catalog as C
from tidemark.plans.catalog import Catalog

MAX_FAILURES = 3  # Fixed value: a bucket that failed more often is given up.
LIFE_SUPPORT_HOURS = 48  # Fixed value: an attempt older than this is cancelled.
RESUBMIT_AFTER_HOURS = 1  # Fixed value: an attempt idle longer than this is sent again.
LAG_MINUTES = 5  # Fixed value: lateness allowed before a bucket closes.
MAX_EVENTS = 128  # Fixed value: entries of an event log at which no more are kept.


def _key(by: tuple[str, ...]) -> list[str]:
    return [*by, "process_name", "timeperiod"]


def _state() -> Column:
    return F.coalesce("state", F.lit(S.EMBRYO))


def _dim(ledger: DataFrame, catalog: Catalog, *columns: str) -> DataFrame:
    """Ledger rows of known processes with columns of the catalog beside them."""
    dim = catalog.process_dim(ledger.sparkSession).select("process_name", *columns)
    kept = [c for c in ledger.columns if c not in columns]
    return ledger.select(*kept).join(dim, "process_name")


# ---- children and dependencies -----------------------------------------------------
#
# ``span`` is the first period of all trees and the clock. Buckets between them exist by the
# calendar, so one without a row counts as in the initial state. How many children a bucket
# should have follows from its period alone and is compared with the number of those that
# have a row: no missing bucket is ever built.


def _relations(ledger: DataFrame, catalog: Catalog, by: tuple[str, ...], span: Span | None, waits: bool = True) -> DataFrame:
    """What each bucket hears from its children and from the buckets it waits for.

    Every row sends its state to its parent and to those that wait for it, and the messages are
    summed per receiver: one scan and one shuffle that combines on the map side, no self-join.
    """
    rows = []
    for name in catalog.tree_of:
        parent = catalog.parent(name)
        rows.append((name, parent, catalog.processes[parent].qualifier if parent else None, ",".join(catalog.dependents(name))))
    dim = C.inline(ledger.sparkSession, "process_name string, _parent string, _parent_q string, _heard_by string", rows)
    sent = ledger.select(*_key(by), "state", "number_of_failures").join(dim, "process_name")
    inside = in_span(catalog, span) if span else F.lit(True)
    up = F.struct(F.col("_parent").alias("to"), P.coarsen_period_by("_parent_q", "timeperiod").alias("at"), F.lit(True).alias("child"))
    across = F.transform(F.split("_heard_by", ","), lambda d: F.struct(d.alias("to"), F.col("timeperiod").alias("at"), F.lit(False).alias("child")))
    messages = F.concat(F.array(up), across) if waits else F.array(up)
    each = sent.withColumn("_inside", inside).withColumn("_m", F.explode(F.filter(messages, lambda m: F.coalesce(m["to"] != "", F.lit(False)))))
    child, wait = F.col("_m.child"), ~F.col("_m.child")
    state = _state()
    done = state.isin(S.PROCESSED, S.NOOP)
    given_up = (F.col("number_of_failures") > MAX_FAILURES) | S.is_skipped("state")
    spoiled = F.col("state").isNotNull() & F.coalesce(given_up, F.lit(False))
    return each.groupBy(*by, F.col("_m.to").alias("process_name"), F.col("_m.at").alias("timeperiod")).agg(
        F.count_if(child).alias("number_of_children"),
        F.count_if(child & F.col("_inside")).alias("_in_span"),
        F.bool_and(F.when(child, S.is_finished(state))).alias("children_finished"),
        F.bool_or(F.when(child, S.is_active(state))).alias("child_active"),
        F.bool_and(F.when(child, S.is_skipped(state))).alias("children_skipped"),
        F.bool_and(F.when(child, spoiled)).alias("children_spoiled"),
        F.count_if(wait).alias("_heard"),
        F.bool_and(F.when(wait, S.is_finished(state))).alias("all_finished"),
        F.bool_and(F.when(wait, done)).alias("all_processed"),
        F.bool_or(F.when(wait, S.is_skipped(state))).alias("skipped_present"),
    )


_CHILDREN = ("number_of_children", "children_finished", "child_active", "children_skipped", "children_spoiled")
_WAITS = ("all_finished", "all_processed", "skipped_present")


def _completed(rows: DataFrame, catalog: Catalog, span: Span | None) -> DataFrame:
    """Sums of ``_relations`` with the children that the calendar expects but that have no row."""
    seen = F.coalesce("_in_span", F.lit(0))
    absent = F.greatest(expected_children(catalog, span) - seen, F.lit(0)) if span else F.lit(0)
    rows = rows.withColumn("_absent", absent)
    none_absent = F.col("_absent") == 0
    number = F.coalesce("number_of_children", F.lit(0)) + F.col("_absent")
    some = number > 0
    filled = {
        "number_of_children": F.when(some, number.cast("bigint")),
        "children_finished": F.when(some, F.coalesce("children_finished", F.lit(True)) & none_absent),
        "child_active": F.when(some, F.coalesce("child_active", F.lit(False)) | ~none_absent),
        "children_skipped": F.when(some, F.coalesce("children_skipped", F.lit(True)) & none_absent),
        "children_spoiled": F.when(some, F.coalesce("children_spoiled", F.lit(True)) & none_absent),
    }
    return rows.withColumns(filled)


def children_summary(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """What a parent bucket needs to know of its children; a parent of which none has a row is absent."""
    summed = _relations(ledger, catalog, by, span, waits=False)
    return _completed(summed, catalog, span).select(*_key(by), *_CHILDREN)


def _judged(ledger: DataFrame, catalog: Catalog, by: tuple[str, ...], span: Span | None, *, waits: bool = True) -> DataFrame:
    """Ledger rows with what they hear; a column is null where a bucket has no children, or waits for nothing."""
    given = [c for c in ledger.columns if c not in (*_CHILDREN, *_WAITS)]
    heard = _relations(ledger, catalog, by, span, waits)
    joined = _completed(ledger.select(*given).join(heard, _key(by), "left"), catalog, span)
    if not waits:
        return joined.select(*given, *_CHILDREN)
    asked = F.lit(0)
    for name in catalog.tree_of:
        if catalog.dependencies(name):
            asked = F.when(F.col("process_name") == name, len(catalog.dependencies(name))).otherwise(asked)
    # a bucket that is waited for and has no row is in the initial state
    silent = asked > F.coalesce("_heard", F.lit(0))
    filled = {c: F.coalesce(c, F.lit(True)) & ~silent for c in ("all_finished", "all_processed")}
    return joined.withColumns(filled).select(*given, *_CHILDREN, *_WAITS)


def counterparts(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The same bucket in each tree a row waits for, with its state.

    A tree without that granularity is no dependency; an absent row is in the initial state. Rows send
    their state to those that wait for them, and to themselves as a sign that they exist; a receiver
    hears from as many as its process declares, so what is gathered per bucket is bounded by the catalog.
    """
    spark = ledger.sparkSession
    rows = [(name, ",".join(catalog.dependents(name)), bool(catalog.dependencies(name))) for name in catalog.tree_of]
    dim = C.inline(spark, "process_name string, _heard_by string, _waits boolean", rows)
    none = F.lit(None).cast("string")
    message = lambda to, source, state: F.struct(to.alias("to"), source.alias("source"), state.alias("state"))
    me = F.when(F.col("_waits"), F.array(message(F.col("process_name"), none, none)))
    across = F.transform(F.filter(F.split("_heard_by", ","), lambda d: d != ""), lambda d: message(d, F.col("process_name"), _state()))
    each = ledger.select(*_key(by), "state").join(dim, "process_name").select(
        *by, "timeperiod", F.inline(F.concat(F.coalesce(me, F.array().cast(_MESSAGES)), across))
    )
    heard = each.groupBy(*by, F.col("to").alias("process_name"), "timeperiod").agg(
        F.bool_or(F.col("source").isNull()).alias("_exists"), F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "state"))).alias("_heard")
    )
    asked = heard.where("_exists").join(catalog.dependency_dim(spark), "process_name")
    state = F.get(F.filter("_heard", lambda h: h["source"] == F.col("depends_on")), F.lit(0))["state"]
    return asked.select(*_key(by), "depends_on", "depends_on_tree", F.coalesce(state, F.lit(S.EMBRYO)).alias("depends_on_state"))


_MESSAGES = "array<struct<to:string,source:string,state:string>>"


def dependents(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The same bucket in each tree that waits for a row."""
    pairs = catalog.dependency_dim(ledger.sparkSession).select(
        F.col("depends_on").alias("process_name"),
        F.col("process_name").alias("dependent"),
    )
    return ledger.select(*_key(by)).join(pairs, "process_name").select(*_key(by), "dependent")


def dependency_summary(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Per row that waits for something: who blocks it and how. Lists hold one entry per tree."""
    state = F.col("depends_on_state")
    done = state.isin(S.PROCESSED, S.NOOP)
    unfinished = ~S.is_finished(state)
    unhealthy = ~(S.is_active(state) | done)

    def names(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, F.col("depends_on"))))

    return (
        counterparts(ledger, catalog, by=by)
        .groupBy(*_key(by))
        .agg(
            names(unfinished).alias("unfinished"),
            names(~done).alias("unprocessed"),
            names(unhealthy).alias("unhealthy"),
            names(S.is_skipped(state)).alias("skipped"),
            F.bool_and(~unfinished).alias("all_finished"),
            F.bool_and(done).alias("all_processed"),
            F.bool_and(~unhealthy).alias("all_healthy"),
            F.bool_or(S.is_skipped(state)).alias("skipped_present"),
        )
    )


def readiness(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """Adds what blocks each row, and ``ready``: dependencies and children finished, row active."""
    yes, no = F.lit(True), F.lit(False)
    judged = _judged(ledger, catalog, by, span).drop(*[c for c in _CHILDREN if c != "children_finished"])
    return (
        judged.withColumn("children_finished", F.coalesce("children_finished", yes))
        .withColumn("skipped_present", F.coalesce("skipped_present", no))
        .withColumn("ready", F.col("all_finished") & F.col("children_finished") & S.is_active(_state()))
    )


def gate(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """Adds ``decision``: run, wait or skip, by the blocking type of the process; done where it is finished."""
    judged = _dim(readiness(ledger, catalog, by=by, span=span), catalog, "blocking_type")
    kind = F.col("blocking_type")
    waits = F.when(F.col("all_processed"), "run").when(F.col("skipped_present"), "skip").otherwise("wait")
    decision = (
        F.when(S.is_finished(_state()), "done")
        .when(kind == C.BLOCKING_NORMAL, "run")
        .when(kind == C.BLOCKING_CHILDREN, F.when(F.col("ready"), "run").otherwise("wait"))
        .when(kind == C.BLOCKING_DEPENDENCIES, waits)
    )
    return judged.withColumn("decision", decision)


# ---- bucket time ---------------------------------------------------------------------


def _span(start: str | None, now: datetime) -> Span | None:
    return (start, now) if start else None


def is_closed(q: Column | str, c: Column | str, now: datetime, lag_minutes: int = LAG_MINUTES) -> Column:
    """True once a bucket's end plus the allowed lateness has passed."""
    granularity = F.lit(q) if isinstance(q, str) and q in P.RANK else q
    following = P.shift_start_by(granularity, c, 1)
    zero = F.lit(0)
    return P.ntz(now) > following + F.make_dt_interval(zero, zero, F.lit(lag_minutes))


def closed_buckets(ledger: DataFrame, catalog: Catalog, now: datetime, lag_minutes: int = LAG_MINUTES) -> DataFrame:
    """Adds ``may_start``: processes that need whole buckets wait until the bucket has closed."""
    dim = _dim(ledger, catalog, "time_qualifier", "runs_on_open_bucket")
    return dim.withColumn(
        "may_start", F.col("runs_on_open_bucket") | is_closed("time_qualifier", F.col("timeperiod"), now, lag_minutes)
    )


def bucket_status(
    ledger: DataFrame, catalog: Catalog, now: datetime, *, by: tuple[str, ...] = (), start: str | None = None
) -> DataFrame:
    """Adds ``status``: done, open (current or not ready), ready (past, one final run), future.

    With ``start``, buckets between it and ``now`` that have no row count as in the initial state.
    """
    judged = _dim(readiness(ledger, catalog, by=by, span=_span(start, now)), catalog, "time_qualifier")
    current = P.current_period_by("time_qualifier", now)
    status = (
        F.when(S.is_finished(_state()), "done")
        .when((F.col("timeperiod") == current) | ~F.col("ready"), "open")
        .when(F.col("timeperiod") < current, "ready")
        .otherwise("future")
    )
    return judged.withColumn("status", status)


def mark_noop(ledger: DataFrame, catalog: Catalog) -> DataFrame:
    """Active buckets between the labels of a grouped process need no work."""
    between = F.lit(False)
    for p in catalog.processes.values():
        if p.grouping > 1:
            hit = P.is_between_group(p.qualifier, p.grouping, "timeperiod")
            between = F.when(F.col("process_name") == p.name, hit).otherwise(between)
    return ledger.withColumn("state", F.when(between & S.is_active(_state()), F.lit(S.NOOP)).otherwise(F.col("state")))


# ---- propagation -----------------------------------------------------------------------


def propagate_dirty(
    changes: DataFrame, catalog: Catalog, ledger: DataFrame, *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Buckets to redo when ``changes`` changed: their ancestors and dependents, each once.

    The process graph is walked once, over the declaration; its closure is an inline
    table. Every bucket then maps to its targets row by row, with one ``distinct``.
    Rows in the initial state are listed with action ``none``.
    """
    reach = catalog.reach_dim(ledger.sparkSession, up=True)
    targets = (
        changes.select(*_key(by))
        .join(reach, "process_name")
        .select(
            *by,
            F.col("target").alias("process_name"),
            P.coarsen_period_by("target_qualifier", "timeperiod").alias("timeperiod"),
        )
        .distinct()
    )
    held = targets.join(ledger.select(*_key(by), "state"), _key(by), "left")
    action = F.when(S.is_embryo(_state()), "none").otherwise("reprocess")
    return held.select(*_key(by), _state().alias("state"), action.alias("action"))


def propagate_skip(
    changes: DataFrame, catalog: Catalog, ledger: DataFrame, *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Ledger rows to skip along with ``changes``: their descendants and dependents.

    Each ledger row computes the buckets it would be skipped with, and looks them up by
    equality, so a coarse bucket never fans out on one task. Finished rows are listed
    with action ``none``.
    """
    reach = catalog.reach_dim(ledger.sparkSession, up=False).select(
        F.col("target").alias("process_name"), F.col("process_name").alias("source"), "source_qualifier"
    )
    marked = changes.select(
        *by, F.col("process_name").alias("source"), F.col("timeperiod").alias("source_period")
    ).distinct()
    candidates = (
        ledger.select(*_key(by), "state")
        .join(reach, "process_name")
        .withColumn("source_period", P.coarsen_period_by("source_qualifier", "timeperiod"))
    )
    hit = candidates.join(marked, [*by, "source", "source_period"], "left_semi")
    # the marks themselves and what has the same bucket are listed even where the ledger has no row
    same = F.array().cast("array<string>")
    for name in catalog.tree_of:
        q = catalog.processes[name].qualifier
        targets = [t for t in catalog.reach_down(name) if catalog.processes[t].qualifier == q]
        same = F.when(F.col("process_name") == name, F.array(*map(F.lit, targets))).otherwise(same)
    named = changes.select(*_key(by)).distinct().select(*by, F.explode(same).alias("process_name"), "timeperiod").distinct()
    named = named.join(ledger.select(*_key(by), "state"), _key(by), "left")
    both = hit.select(*_key(by), "state").unionByName(named.select(*_key(by), "state"))
    action = F.when(S.is_finished(_state()), "none").otherwise("skip")
    return both.select(*_key(by), _state().alias("state"), action.alias("action")).distinct()


# ---- what to do next -----------------------------------------------------------------


def should_skip(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """Adds ``skippable``.

    Finished rows are. A row of the finest level is once it failed too often. Any other
    row is when all its children failed too often or were skipped, and, by the same
    rule, when it has no children at all. A bucket without a record is not, and keeps its
    parent from being so.
    """
    joined = _dim(_judged(ledger, catalog, by, span, waits=False), catalog, "child_process")
    skippable = (
        F.when(F.col("state").isNull(), F.lit(False))
        .when(S.is_finished("state"), F.lit(True))
        .when(F.col("child_process").isNull(), F.col("number_of_failures") > MAX_FAILURES)
        .otherwise(F.coalesce("children_spoiled", F.lit(True)))
    )
    return joined.withColumn("skippable", skippable).drop("child_process", *_CHILDREN)


_BLOCK = 32  # buckets of a process that share a word of flags
_FAR = 1 << 30


def _bits(low: Column, high: Column) -> Column:
    """Flags from bit ``low`` to bit ``high``, both within a block and clipped to it; none where they cross."""
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(_BLOCK - 1))
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1
    return F.when(high >= low, ones(high + 1) - ones(low)).otherwise(F.lit(0).cast("bigint"))


def _lowest(flags: Column) -> Column:
    return F.bit_count(flags.bitwiseAND(-flags) - 1)


def next_period(
    ledger: DataFrame, catalog: Catalog, now: datetime, *, by: tuple[str, ...] = (), start: str | None = None
) -> DataFrame:
    """The bucket each process works on next.

    From the coarsest level down: the earliest bucket without a record, or active and not
    skippable, under the bucket chosen one level up or a later sibling of that bucket.
    Where there is none, the current bucket. With ``start``, buckets between it and ``now``
    exist by the calendar, whether they have a row or not.

    The ledger is first reduced to two words of flags per 32 buckets of a process: which have a
    row, and which of those are open. What is left per scope is a thirty-second of what the
    calendar allows; the levels are walked on that row, and gaps are the flags that are not set.
    """
    span = _span(start, now)
    bounds = level_bounds(catalog, span) if span else {}
    open_rows = F.col("state").isNull() | (S.is_active("state") & ~F.col("skippable"))
    number = F.lit(None).cast("int")
    for name in catalog.tree_of:
        number = F.when(F.col("process_name") == name, P.period_number(catalog.processes[name].qualifier, "timeperiod")).otherwise(number)
    rows = should_skip(ledger, catalog, by=by, span=span).select(*by, "process_name", open_rows.alias("_open"), number.alias("_n"))
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_n", F.lit(_BLOCK)).cast("int"))
    words = rows.groupBy(*by, "process_name", F.floor(F.col("_n") / _BLOCK).cast("int").alias("block")).agg(
        F.bit_or(flag).alias("held"), F.bit_or(F.when(F.col("_open"), flag).otherwise(F.lit(0).cast("bigint"))).alias("open")
    )
    # scopes whose rows are all of unknown processes have next buckets too
    scopes = ledger.select(*by).distinct() if by else ledger.sparkSession.range(1).select()
    none = {c: F.lit(None).cast(t) for c, t in words.dtypes if c not in by}
    both = words.unionByName(scopes.select(*by, *[v.alias(c) for c, v in none.items()]))
    packed = F.collect_list(F.when(F.col("block").isNotNull(), F.struct("process_name", "block", "held", "open")))
    out = both.groupBy(*by).agg(packed.alias("_words"))

    picks = []
    for tree in catalog.trees.values():
        levels = catalog.levels(tree)
        for depth, name in enumerate(levels):
            q, chosen = catalog.processes[name].qualifier, f"_{name}"
            low, high = F.lit(-_FAR), F.lit(_FAR)
            if depth:
                above = catalog.processes[levels[depth - 1]].qualifier
                parent = P.numbered_period(above, F.col(f"_{levels[depth - 1]}"))
                low = P.child_numbers(above, q, parent)[0]
                if depth > 1:  # on to later siblings of the parent, not beyond its own parent
                    family = catalog.processes[levels[depth - 2]].qualifier
                    high = P.child_numbers(family, q, P.coarsen_period(family, parent))[1]
            out = out.withColumns({"_low": low, "_high": high})
            out = out.withColumn("_mine", _words_of(name))
            first = _first_open()
            if name in bounds:
                first = F.least(first, _first_gap(*bounds[name]))
            out = out.withColumn(chosen, F.coalesce(first, F.lit(P.moment_number(q, now))))
            picks.append(F.struct(F.lit(name).alias("process_name"), P.numbered_period(q, F.col(chosen)).alias("timeperiod")))
    return out.select(*by, F.inline(F.array(*picks)))


def _words_of(name: str) -> Column:
    return F.filter("_words", lambda w: w["process_name"] == name)


def _within(block: Column, low: Column, high: Column) -> Column:
    return _bits(low - block * _BLOCK, high - block * _BLOCK)


def _first_open() -> Column:
    """Number of the first open bucket of ``_mine`` from ``_low`` to ``_high``."""
    low, high = F.col("_low"), F.col("_high")
    near = F.filter("_mine", lambda w: (w["block"] >= F.floor(low / _BLOCK)) & (w["block"] <= F.floor(high / _BLOCK)))
    flags = F.transform(near, lambda w: F.struct(w["block"].alias("block"), w["open"].bitwiseAND(_within(w["block"], low, high)).alias("flags")))
    return F.array_min(F.transform(F.filter(flags, lambda w: w["flags"] != 0), lambda w: w["block"] * _BLOCK + _lowest(w["flags"])))


def _first_gap(first: int, last: int) -> Column:
    """Number of the first bucket without a row, of those that the calendar has from ``_low`` to ``_high``."""
    low, high = F.greatest("_low", F.lit(first)), F.least("_high", F.lit(last))
    blocks = F.sequence(F.floor(low / _BLOCK).cast("int"), F.floor(high / _BLOCK).cast("int"))
    held = lambda b: F.coalesce(F.get(F.filter("_mine", lambda w: w["block"] == b), F.lit(0))["held"], F.lit(0).cast("bigint"))
    flags = F.transform(blocks, lambda b: F.struct(b.alias("block"), _within(b, low, high).bitwiseAND(F.bitwise_not(held(b))).alias("flags")))
    gaps = F.filter(flags, lambda w: w["flags"] != 0)
    return F.when(low <= high, F.array_min(F.transform(gaps, lambda w: w["block"] * _BLOCK + _lowest(w["flags"]))))


def has_next_sibling(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """Adds ``younger_sibling``: the following bucket exists under the same parent, by its row or by the calendar."""
    rows = _dim(ledger.select(*_key(by)), catalog, "time_qualifier", "parent_qualifier")
    before = P.shift_period_by("time_qualifier", "timeperiod", -1)
    same_parent = F.col("parent_qualifier").isNull() | (
        P.coarsen_period_by("parent_qualifier", "timeperiod") == P.coarsen_period_by("parent_qualifier", before)
    )
    older = rows.where(same_parent).select(
        *by, "process_name", before.alias("timeperiod"), F.lit(True).alias("younger_sibling")
    )
    joined = ledger.join(older, _key(by), "left").withColumn("younger_sibling", F.coalesce("younger_sibling", F.lit(False)))
    if not span:
        return joined
    after, family = F.lit(None).cast("string"), F.lit(True)
    for name in level_bounds(catalog, span):
        following, parent = P.shift_period(catalog.processes[name].qualifier, "timeperiod", 1), catalog.parent(name)
        mine = F.col("process_name") == name
        after = F.when(mine, following).otherwise(after)
        if parent:
            above = catalog.processes[parent].qualifier
            family = F.when(mine, P.coarsen_period(above, following) == P.coarsen_period(above, "timeperiod")).otherwise(family)
    dated = joined.withColumns({"_after": after, "_family": family})
    due = in_span(catalog, span, "_after") & F.col("_family")
    return dated.withColumn("younger_sibling", F.col("younger_sibling") | F.coalesce(due, F.lit(False))).drop("_after", "_family")


def audit(ledger: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = (), span: Span | None = None) -> DataFrame:
    """Rows whose state contradicts their children, with the action that repairs them."""
    judged = _judged(ledger, catalog, by, span, waits=False).where("number_of_children > 0")
    # only rows whose children were all skipped need to know of a sibling
    asking = has_next_sibling(ledger.select(*_key(by)), catalog, by=by, span=span)
    joined = judged.join(asking, _key(by))
    action = F.when(S.is_finished(_state()) & F.col("child_active"), "reprocess").when(
        F.col("children_skipped") & F.col("younger_sibling") & ~S.is_skipped(_state()), "skip"
    )
    return joined.select(*_key(by), _state().alias("state"), action.alias("action")).where("action is not null")


# ---- attempts -----------------------------------------------------------------------------


def current_attempts(ledger: DataFrame, attempts: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Finished managed attempts that their ledger row still points at."""
    mine = attempts.where(S.is_finished("state", attempt=True) & (F.col("unit_of_work_type") == S.MANAGED))
    mine = mine.select(*_key(by), F.col("attempt_id").alias("related_unit_of_work"), F.col("state").alias("attempt_state"))
    return ledger.join(mine, [*_key(by), "related_unit_of_work"])


def settle(ledger: DataFrame, attempts: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Ledger rows whose current attempt ended, in the state the attempt gives them."""
    current = current_attempts(ledger, attempts, by=by)
    return current.withColumn("state", S.terminal_state("attempt_state", "state")).drop("attempt_state")


def _in_hand(catalog: Catalog) -> Column:
    """Managed attempts that are not finished, of declared processes that are switched on."""
    on = [p.name for p in catalog.processes.values() if p.is_on]
    return F.col("state").isin(S.IN_PROGRESS, S.INVALID, S.REQUESTED) & (F.col("unit_of_work_type") == S.MANAGED) & F.col("process_name").isin(*on)


def reprocess_candidates(attempts: DataFrame, catalog: Catalog, since: str | None = None) -> DataFrame:
    """Unfinished managed attempts of enabled processes, from the bucket that holds ``since`` in each granularity.

    The year bound is a plain filter on the stored column, so it reaches the scan.
    """
    open_attempts = attempts.where(_in_hand(catalog))
    if since is None:
        return open_attempts
    rows = [
        (p.name, P.HOURLY if p.qualifier == P.REAL_TIME else p.qualifier)
        for p in catalog.processes.values()
    ]
    dim = C.inline(attempts.sparkSession, "process_name string, _q string", rows)
    bounded = open_attempts.where(F.col("start_timeperiod") >= f"{since[:4]}000000").join(dim, "process_name")
    bound = P.cast_period_by("_q", F.lit(since))
    return bounded.where(bound <= F.col("start_timeperiod")).drop("_q")


def triage(
    attempts: DataFrame,
    catalog: Catalog,
    now: datetime,
    *,
    life_support_hours: int = LIFE_SUPPORT_HOURS,
    resubmit_after_hours: int = RESUBMIT_AFTER_HOURS,
) -> DataFrame:
    """Adds ``action`` and applies it: cancel what is too old, resubmit what is idle or invalid.

    Attempts that are finished, run freely or belong to a process that is unknown or off are kept as they are.
    """
    zero = F.lit(0)

    def older(ts: str, hours: int) -> Column:
        return F.col(ts) < P.ntz(now) - F.make_dt_interval(zero, F.lit(hours))

    action = (
        F.when(~F.coalesce(_in_hand(catalog), F.lit(False)), "keep")
        .when(older("created_at", life_support_hours), "cancel")
        .when(older("submitted_at", resubmit_after_hours) | S.is_invalid("state"), "resubmit")
        .otherwise("keep")
    )
    resubmit = F.col("action") == "resubmit"
    judged = attempts.withColumn("action", action)
    retries = F.when(resubmit & S.is_invalid("state"), F.col("number_of_retries") + 1)
    state = F.when(F.col("action") == "cancel", F.lit(S.CANCELED)).when(resubmit, F.lit(S.REQUESTED))
    return (
        judged.withColumn("number_of_retries", retries.otherwise(F.col("number_of_retries")))
        .withColumn("submitted_at", F.when(resubmit, P.ntz(now)).otherwise(F.col("submitted_at")))
        .withColumn("state", state.otherwise(F.col("state")))
    )


def count_failures(ledger: DataFrame, lookups: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Ledger with one failure more per failed source lookup."""
    failed = lookups.groupBy(*_key(by)).agg(F.count_if("failed").alias("_failed"))
    joined = ledger.join(failed, _key(by), "left")
    total = F.col("number_of_failures") + F.coalesce("_failed", F.lit(0))
    return joined.withColumn("number_of_failures", total).drop("_failed")


def filter_states(
    df: DataFrame,
    since: str | None = None,
    *,
    running: bool = False,
    processed: bool = False,
    noop: bool = False,
    failed: bool = False,
    attempt: bool = False,
) -> DataFrame:
    """Rows in the states the flags select; the attempts variant reads free runs only."""
    states = S.wanted_states(running=running, processed=processed, noop=noop, failed=failed, attempt=attempt)
    out = df.where(F.col("state").isin(*states)) if states else df.where(F.lit(False))
    if attempt:
        out = out.where(F.col("unit_of_work_type") == S.FREERUN)
    return out if since is None else out.where(F.col("timeperiod") >= since)


def known_only(df: DataFrame, process_dim: DataFrame, *, include_disabled: bool = False) -> DataFrame:
    """Rows of declared processes, by default of enabled ones only."""
    dim = process_dim if include_disabled else process_dim.where("is_on")
    return df.join(dim, "process_name", "left_semi")


def with_details(ledger: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows with log or attempt columns beside them where there are any.

    Rows without a key, which may be most, stay out of the join: a shuffle would send
    them all to one task.
    """
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    joined = ledger.where(keyed).join(details, keys, "left")
    return joined.unionByName(ledger.where(~keyed), allowMissingColumns=True)


def cap_events(events: DataFrame, key: list[str], ts: str, tie: str, n: int) -> DataFrame:
    """The newest events per key. One more than ``n`` stays, because the cap is checked before
    an event is added. Ranked with a limit, so each map task forwards at most that many rows
    of a key."""
    return newest(events, key, [F.desc(ts), F.desc(tie)], n + 1)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in the given order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


# ---- reports --------------------------------------------------------------------------------


def ledger_orphans(ledger: DataFrame, catalog: Catalog) -> DataFrame:
    """Rows per process that no tree covers, or whose granularity is not the process's own."""
    dim = catalog.process_dim(ledger.sparkSession).select("process_name", F.col("time_qualifier").alias("_declared"))
    joined = ledger.join(dim, "process_name", "left")
    reason = F.when(F.col("_declared").isNull(), "no_tree").when(
        F.col("_declared") != F.col("time_qualifier"), "other_granularity"
    )
    return (
        joined.withColumn("reason", reason)
        .where("reason is not null")
        .groupBy("process_name", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def jobs_by_process(ledger: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Ledger rows grouped per process and sorted by period: a range-partitioned global sort,
    so a process with most of the rows spreads over many tasks."""
    return ledger.orderBy("process_name", *by, "timeperiod")


def state_matrix(ledger: DataFrame, catalog: Catalog, start: str, now: datetime, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Every declared process of each scope against its own buckets from ``start`` to ``now``, empty cells kept.

    The axis of a granularity comes from the calendar, generated on the row of each scope.
    """
    scopes = ledger.select(*by).distinct() if by else ledger.sparkSession.range(1).select()
    cells = period_spine(scopes, catalog, start, now).select(*_key(by))
    inside = ledger.where(F.col("timeperiod") >= f"{start[:4]}000000").select(*_key(by), "state")
    return cells.join(inside, _key(by), "left")


def state_matrix_wide(
    ledger: DataFrame, catalog: Catalog, q: str, start: str, now: datetime, *, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per scope and process of granularity ``q``, one column per bucket from ``start`` to ``now``.

    Columns come from the calendar, so they are known without a look at the data; a cell is the state
    of that bucket, null where it has no row. The pivot is one aggregation that combines on the map side.
    """
    q = P.qualifier(q)
    low, high = P.moment_number(q, P.moment(start)), P.moment_number(q, now)
    names = [n for n in catalog.tree_of if catalog.processes[n].qualifier == q]
    spark = ledger.sparkSession
    periods = [r[0] for r in spark.range(low, high + 1).select(P.numbered_period(q, F.col("id"))).orderBy("id").collect()]
    cells = [F.max(F.when(F.col("timeperiod") == tp, F.col("state"))).alias(tp) for tp in periods]
    scopes = ledger.select(*by).distinct() if by else spark.range(1).select()
    every = scopes.select(*by, F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("process_name"))
    inside = ledger.where(F.col("process_name").isin(*names) & F.col("timeperiod").between(periods[0], periods[-1]) if periods else F.lit(False))
    rows = inside.select(*_key(by), "state").unionByName(every, allowMissingColumns=True)
    return rows.groupBy(*by, "process_name").agg(*cells) if cells else every


def node_details(
    ledger: DataFrame,
    catalog: Catalog,
    *,
    by: tuple[str, ...] = (),
    span: Span | None = None,
    events: DataFrame | None = None,
    max_events: int = MAX_EVENTS,
) -> DataFrame:
    """Each bucket with its children: their number and a list no longer than the calendar allows.

    With ``span``, children that the calendar has and the ledger hasn't are listed without a state.
    ``events`` (the key of a bucket, ``logged_at``, ``message``) adds the newest ``max_events`` + 1 of
    them, newest first; map tasks forward no more of a bucket than that.
    """
    na = F.lit("NA")
    child = _dim(ledger, catalog, "parent_process", "parent_qualifier").where(F.col("parent_process").isNotNull())
    entry = F.struct(
        "timeperiod",
        "process_name",
        F.coalesce("state", na).alias("state"),
        F.coalesce(F.col("number_of_failures").cast("string"), na).alias("number_of_failures"),
    )
    parent_period = P.coarsen_period_by("parent_qualifier", "timeperiod")
    lists = child.groupBy(*by, F.col("parent_process").alias("process_name"), parent_period.alias("timeperiod")).agg(
        F.array_sort(F.collect_list(entry)).alias("children")
    )
    rows = _dim(ledger, catalog, "time_qualifier").join(lists, _key(by), "left")
    if span:
        rows = rows.withColumn("children", _with_absent(catalog, span))
    shown = [
        *_key(by),
        F.coalesce("time_qualifier", na).alias("time_qualifier"),
        F.coalesce("state", na).alias("state"),
        F.coalesce(F.col("number_of_failures").cast("string"), na).alias("number_of_failures"),
        F.coalesce(F.size("children"), F.lit(0)).cast("bigint").alias("number_of_children"),
        "children",
    ]
    if events is None:
        return rows.select(*shown)
    kept = cap_events(events, _key(by), "logged_at", "message", max_events)
    log = F.sort_array(F.collect_list(F.struct("logged_at", "message")), asc=False)
    logs = kept.groupBy(*_key(by)).agg(log.alias("event_log"))
    return rows.join(logs, _key(by), "left").select(*shown, F.coalesce("event_log", F.array().cast(logs.schema["event_log"].dataType)).alias("event_log"))


def _with_absent(catalog: Catalog, span: Span) -> Column:
    """``children`` with the buckets of the calendar that are not among them; null where there is none."""
    out = F.col("children")
    for child, bounds in level_bounds(catalog, span).items():
        name = catalog.parent(child)
        if name:
            q, parent_q = catalog.processes[child].qualifier, catalog.processes[name].qualifier
            out = F.when(F.col("process_name") == name, _listed(child, q, parent_q, *bounds)).otherwise(out)
    return out


def _listed(child: str, q: str, parent_q: str, first: int, last: int) -> Column:
    na = F.lit("NA")
    held = F.coalesce(F.transform("children", lambda c: c["timeperiod"]), F.array().cast("array<string>"))
    low, high = P.child_numbers(parent_q, q, "timeperiod")
    low, high = F.greatest(low, F.lit(first)), F.least(high, F.lit(last))
    due = F.transform(F.sequence(low, F.greatest(low, high)), lambda n: P.numbered_period(q, n))
    entry = lambda tp: F.struct(tp.alias("timeperiod"), F.lit(child).alias("process_name"), na.alias("state"), na.alias("number_of_failures"))
    listed = F.concat(F.coalesce("children", F.array().cast(_CHILD_LIST)), F.transform(F.array_except(due, held), entry))
    return F.when(low <= high, F.array_sort(listed)).otherwise(F.col("children"))


_CHILD_LIST = "array<struct<timeperiod:string,process_name:string,state:string,number_of_failures:string>>"


def reconcile_dim(declared: DataFrame, stored: DataFrame, *, key: str = "process_name") -> tuple[DataFrame, DataFrame]:
    """Definitions after a sync, and the stored ones that were left out with the reason.

    A stored definition replaces the declared one of the same name and kind, whole.
    Stored names nobody declared are skipped, and so are names declared as another kind.
    """
    columns = declared.columns
    row = F.struct(*columns)
    none = F.lit(None).cast(declared.select(row).schema[0].dataType)
    sides = declared.select(key, row.alias("_declared"), none.alias("_stored")).unionByName(
        stored.select(key, none.alias("_declared"), row.alias("_stored"))
    )
    # both definitions of a name meet in one aggregation: no join, and one shuffle for both results
    met = sides.groupBy(key).agg(F.max("_declared").alias("_declared"), F.max("_stored").alias("_stored"))
    kind = F.col("_declared.kind")
    reason = F.when(F.col("_declared").isNull(), "undeclared").when(kind != "managed", "other_kind")
    kept = F.when(reason.isNull() & F.col("_stored").isNotNull(), F.col("_stored")).otherwise(F.col("_declared"))
    synced = met.where("_declared is not null").select(kept.alias("_row")).select("_row.*")
    return synced, met.where("_stored is not null").select(key, reason.alias("reason")).where("reason is not null")


def process_overview(
    ledger: DataFrame,
    attempts: DataFrame,
    catalog: Catalog,
    now: datetime,
    *,
    since: str | None = None,
    by: tuple[str, ...] = (),
    start: str | None = None,
) -> DataFrame:
    """Per process: next bucket, schedule, next trigger from ``now``, stale buckets in order, and trees that wait for it.

    The stale list holds distinct buckets, so its length is bounded by the calendar.
    """
    upcoming = next_period(ledger, catalog, now, by=by, start=start).withColumnRenamed("timeperiod", "next_timeperiod")
    stale = (
        triage(reprocess_candidates(attempts, catalog, since), catalog, now)
        .where(F.col("action") == "resubmit")
        .groupBy(*by, "process_name")
        .agg(F.array_sort(F.collect_set("timeperiod")).alias("reprocessing_queue"))
    )
    rows = upcoming.join(stale, [*by, "process_name"], "left")
    rows = _dim(rows, catalog, "time_qualifier", "time_grouping", "blocking_type", "is_on", "trigger_frequency", "dependent_trees")
    none = F.array().cast("array<string>")
    trigger = F.when(F.col("is_on"), next_trigger(P.ntz(now), "trigger_frequency"))
    return rows.withColumns({"reprocessing_queue": F.coalesce("reprocessing_queue", none), "next_trigger": trigger})


def refresh_targets(
    status: DataFrame, catalog: Catalog, *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Dependents to trigger for finished buckets, without those that run on open buckets anyway.

    A join with the inline catalog, so it works on a stream of status rows as well.
    """
    live = {p.name for p in catalog.processes.values() if p.runs_on_open_bucket}
    pairs = [(n, d) for n in catalog.tree_of for d in catalog.dependents(n) if d not in live]
    dim = C.inline(status.sparkSession, "process_name string, target string", pairs)
    done = status.where(S.is_finished("state"))
    return done.join(dim, "process_name").select(*_key(by), "target")
