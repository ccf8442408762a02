"""Which buckets should exist, and which are missing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions import states as S
from tidemark.plans.catalog import Catalog


Span = tuple[str, datetime]  # the first period of all trees, and the clock


def level_bounds(catalog: Catalog, span: Span) -> dict[str, tuple[int, int]]:
    """Running numbers of the first and last bucket that each process should have; none where the span is empty.

    The finest level of a tree starts with the bucket that holds the start, coarser ones with its ancestors.
    """
    first, now = P.moment(span[0]), span[1]
    out = {}
    for name, tree in catalog.tree_of.items():
        q, fine = (catalog.processes[p].qualifier for p in (name, catalog.levels(tree)[-1]))
        if P.moment_number(fine, first) <= P.moment_number(fine, now):
            out[name] = P.moment_number(q, first), P.moment_number(q, now)
    return out


def expected_children(catalog: Catalog, span: Span) -> Column:
    """How many children the calendar gives the bucket of a row (``process_name, timeperiod``), within the span."""
    bounds = level_bounds(catalog, span)
    out = F.lit(0)
    for name in catalog.tree_of:
        child = catalog.child(name)
        if child in bounds:
            first, last = P.child_numbers(catalog.processes[name].qualifier, catalog.processes[child].qualifier, "timeperiod")
            lo, hi = bounds[child]
            count = F.greatest(F.least(last, F.lit(hi)) - F.greatest(first, F.lit(lo)) + 1, F.lit(0))
            out = F.when(F.col("process_name") == name, count).otherwise(out)
    return out


def in_span(catalog: Catalog, span: Span, period: str = "timeperiod") -> Column:
    """Whether the calendar has the bucket of a row within the span; by text, whose order is that of time."""
    out = F.lit(False)
    for name, (lo, hi) in level_bounds(catalog, span).items():
        q = catalog.processes[name].qualifier
        first, last = (P.numbered_period(q, F.lit(n)) for n in (lo, hi))
        out = F.when(F.col("process_name") == name, F.col(period).between(first, last)).otherwise(out)
    return out


def period_spine(
    entities: DataFrame, catalog: Catalog, start: str, now: datetime, *, resume: str | None = None
) -> DataFrame:
    """Every bucket that should exist per entity: the finest level of each tree, with its ancestors.

    ``entities`` has the key columns of a ledger's scope, one row each; a ledger without
    scope passes a one-row table. ``resume`` continues from the last build. Buckets are
    generated on each row from their running numbers: nothing is joined or collected.
    """
    by = entities.columns
    parts = []
    for name, (lowest, highest) in level_bounds(catalog, (resume or start, now)).items():
        parts.append(
            F.struct(
                F.lit(name).alias("process_name"),
                F.lit(catalog.processes[name].qualifier).alias("time_qualifier"),
                F.lit(lowest).cast("bigint").alias("lo"),
                F.lit(highest).cast("bigint").alias("hi"),
            )
        )
    rows = entities.select(*by, F.inline(F.array(*parts)))
    numbered = rows.select(*by, "process_name", "time_qualifier", F.explode(F.sequence("lo", "hi")).alias("_n"))
    period = P.numbered_period_by("time_qualifier", F.col("_n"))
    return numbered.select(*by, "process_name", "time_qualifier", period.alias("timeperiod"))


def with_ancestors(df: DataFrame, levels: list[str], *, period: str = "timeperiod") -> DataFrame:
    """Add the coarser period of each level that a period lies in, each once."""
    levels = [P.qualifier(q) for q in levels]
    tagged = F.array(
        *[F.struct(F.lit(q).alias("time_qualifier"), P.cast_period(q, period).alias("tp")) for q in levels]
    )
    other = [c for c in df.columns if c not in (period, "time_qualifier")]
    rows = df.select(*other, F.explode(tagged).alias("_l"))
    return rows.select(*other, "_l.time_qualifier", F.col("_l.tp").alias(period)).distinct()


def missing_periods(spine: DataFrame, ledger: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Buckets without a ledger row, as new rows in the initial state."""
    gaps = spine.join(ledger, [*by, "process_name", "timeperiod"], "left_anti")
    return gaps.select(
        *by,
        "process_name",
        "time_qualifier",
        "timeperiod",
        F.lit(S.EMBRYO).alias("state"),
        F.lit(0).cast("bigint").alias("number_of_failures"),
    )
