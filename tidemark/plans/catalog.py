"""Declared processes and trees: what runs at which granularity, and what it waits for.

A catalog is written in code, so its size is that of its source text (tens of rows).
It is handed to Spark as inline tables, whose exact size the optimizer knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import period as P

# How a process is gated, and which processes may run on an open bucket.
BLOCKING_NORMAL = "blocking_normal"
BLOCKING_CHILDREN = "blocking_children"
BLOCKING_DEPENDENCIES = "blocking_dependencies"
DISCRETE = "discrete"
CONTINUOUS = "continuous"
RECOMPUTING = "recomputing"


@dataclass(frozen=True)
class Process:
    name: str
    qualifier: str
    source: str | None = None
    sink: str | None = None
    state_machine: str = CONTINUOUS
    blocking: str = BLOCKING_NORMAL
    trigger: str = "every 3600"
    grouping: int = 1
    is_on: bool = True

    @property
    def runs_on_open_bucket(self) -> bool:
        return self.state_machine != DISCRETE


@dataclass(frozen=True)
class Tree:
    """Processes of one hierarchy, at most one per granularity, and the trees it waits for."""

    name: str
    processes: tuple[str, ...]
    depends_on: tuple[str, ...] = ()


class Catalog:
    def __init__(self, processes: Iterable[Process], trees: Iterable[Tree]):
        self.processes = {p.name: p for p in processes}
        self.trees = {t.name: t for t in trees}
        self.tree_of: dict[str, Tree] = {}
        for tree in self.trees.values():
            levels = [self.processes[p].qualifier for p in tree.processes]
            if len(set(levels)) != len(levels):
                raise ValueError(f"tree {tree.name} has two processes of one granularity")
            for name in tree.processes:
                P.check_grouping(self.processes[name].qualifier, self.processes[name].grouping)
                self.tree_of[name] = tree

    # ---- the process graph ----

    def levels(self, tree: Tree) -> list[str]:
        """Processes of a tree from coarse to fine."""
        return sorted(tree.processes, key=lambda p: -P.RANK[self.processes[p].qualifier])

    def depth(self, name: str) -> int:
        return self.levels(self.tree_of[name]).index(name)

    def parent(self, name: str) -> str | None:
        levels = self.levels(self.tree_of[name])
        at = levels.index(name)
        return levels[at - 1] if at else None

    def child(self, name: str) -> str | None:
        levels = self.levels(self.tree_of[name])
        at = levels.index(name) + 1
        return levels[at] if at < len(levels) else None

    def counterpart(self, name: str, tree: Tree) -> str | None:
        """Process of the same granularity in another tree."""
        q = self.processes[name].qualifier
        return next((p for p in tree.processes if self.processes[p].qualifier == q), None)

    def dependencies(self, name: str) -> list[str]:
        found = [self.counterpart(name, self.trees[t]) for t in self.tree_of[name].depends_on]
        return [p for p in found if p]

    def dependents(self, name: str) -> list[str]:
        here = self.tree_of[name].name
        found = [self.counterpart(name, t) for t in self.trees.values() if here in t.depends_on]
        return [p for p in found if p]

    def reach(self, name: str, step: Callable[[str], list[str]]) -> list[str]:
        """A process and all that ``step`` leads to from it, each once."""
        seen = [name]
        for at in seen:
            seen += [p for p in step(at) if p not in seen]
        return seen

    def reach_up(self, name: str) -> list[str]:
        """Processes to redo when a bucket of ``name`` changes: ancestors and dependents."""
        return self.reach(name, lambda p: [x for x in [self.parent(p)] if x] + self.dependents(p))

    def reach_down(self, name: str) -> list[str]:
        """Processes to skip along with a bucket of ``name``: descendants and dependents."""
        return self.reach(name, lambda p: [x for x in [self.child(p)] if x] + self.dependents(p))

    def level_rows(self) -> list[tuple]:
        """Tree, depth, process, granularity and parent granularity of every process in a tree."""
        out = []
        for name, tree in self.tree_of.items():
            parent = self.parent(name)
            out.append((tree.name, self.depth(name), name, self.processes[name].qualifier, self.processes[parent].qualifier if parent else None))
        return out

    # ---- inline tables ----

    def process_dim(self, spark: SparkSession) -> DataFrame:
        """One row per process that belongs to a tree."""
        rows = []
        for name, tree in self.tree_of.items():
            p, parent, child = self.processes[name], self.parent(name), self.child(name)
            rows.append(
                (
                    name,
                    p.qualifier,
                    p.grouping,
                    tree.name,
                    self.depth(name),
                    parent,
                    self.processes[parent].qualifier if parent else None,
                    child,
                    p.blocking,
                    p.runs_on_open_bucket,
                    p.is_on,
                    p.trigger,
                    p.source,
                    p.sink,
                    ",".join(sorted({self.tree_of[d].name for d in self._dependent_trees(tree)})),
                )
            )
        return inline(
            spark,
            "process_name string, time_qualifier string, time_grouping int, tree_name string, depth int, "
            "parent_process string, parent_qualifier string, child_process string, blocking_type string, "
            "runs_on_open_bucket boolean, is_on boolean, trigger_frequency string, source string, sink string, "
            "dependent_trees string",
            rows,
        )

    def _dependent_trees(self, tree: Tree) -> list[str]:
        return [p for t in self.trees.values() if tree.name in t.depends_on for p in t.processes]

    def dependency_dim(self, spark: SparkSession) -> DataFrame:
        """Process and the process of the same granularity it waits for."""
        rows = [(n, d, self.tree_of[d].name) for n in self.tree_of for d in self.dependencies(n)]
        return inline(spark, "process_name string, depends_on string, depends_on_tree string", rows)

    def reach_dim(self, spark: SparkSession, *, up: bool) -> DataFrame:
        """Process, and each process reached from it with both granularities."""
        walk = self.reach_up if up else self.reach_down
        rows = [
            (n, t, self.processes[t].qualifier, self.processes[n].qualifier) for n in self.tree_of for t in walk(n)
        ]
        return inline(
            spark, "process_name string, target string, target_qualifier string, source_qualifier string", rows
        )


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table written out in the plan, so that its size is known when joins are planned."""
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def cell(value: object, dtype: str) -> str:
        if value is None:
            return f"cast(null as {dtype})"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"cast({str(value).lower()} as {dtype})"

    names = ", ".join(n for n, _ in fields)
    if not rows:
        nulls = ", ".join(f"cast(null as {t}) as {n}" for n, t in fields)
        return spark.sql(f"select {nulls} where false")
    values = ", ".join("(" + ", ".join(cell(v, t) for v, (_, t) in zip(r, fields)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({names})")


# Names of processes and trees. The intervals are our own.
SITE_SUITE = Catalog(
    processes=[
        Process("site_hourly", P.HOURLY, "single_session", "site_hourly", RECOMPUTING, BLOCKING_NORMAL, "every 240"),
        Process("site_daily", P.DAILY, "site_hourly", "site_daily", RECOMPUTING, BLOCKING_CHILDREN, "every 1200"),
        Process("site_monthly", P.MONTHLY, "site_daily", "site_monthly", CONTINUOUS, BLOCKING_NORMAL, "every 7200"),
        Process("site_yearly", P.YEARLY, "site_monthly", "site_yearly", CONTINUOUS, BLOCKING_NORMAL, "every 28800"),
        Process("client_daily", P.DAILY, "site_daily", "client_daily", DISCRETE, BLOCKING_DEPENDENCIES, "every 7200"),
        Process("client_monthly", P.MONTHLY, "client_daily", "client_monthly", CONTINUOUS, BLOCKING_NORMAL, "every 28800"),
        Process("client_yearly", P.YEARLY, "client_monthly", "client_yearly", CONTINUOUS, BLOCKING_NORMAL, "every 57600"),
        Process("alert_daily", P.DAILY, "site_daily", "alert_daily", DISCRETE, BLOCKING_DEPENDENCIES, "every 28800"),
    ],
    trees=[
        Tree("tree_site", ("site_yearly", "site_monthly", "site_daily", "site_hourly")),
        Tree("tree_client", ("client_yearly", "client_monthly", "client_daily"), ("tree_site",)),
        Tree("tree_alert", ("alert_daily",)),
    ],
)
