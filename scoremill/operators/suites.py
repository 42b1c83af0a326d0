"""Named suites of tasks and their scores.

A suite is ``AVG`` (mean of all its leaf tasks), ``AOA`` (mean of its children, each child suite
counting once), ``VIEW`` (the children of an AOA without a column of its own) or ``LIST`` (a
selection that is never averaged). Averages are strict: one missing leaf makes them null.

Nested averages are linear in the leaves. So each suite is flattened on the driver into one weight
per leaf, and all suites of a table are scored in one pass, whatever the nesting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremill.functions.patterns import Filter
from scoremill.session import local_table, stage

KINDS = ("AVG", "AOA", "VIEW", "LIST")
EDGE_TYPE = "suite string, kind string, ord int, child string, child_is_suite boolean"
USES = "array<struct<column:string,weight:double,n_leaves:int>>"
USE_TYPE = f"task string, uses {USES}"
Combine = Callable[[DataFrame, "SuiteBook", str], DataFrame | None]


@dataclass(frozen=True)
class Suite:
    name: str
    kind: str
    children: tuple[str, ...]
    suites: frozenset[str]  # the children that are suites; the others are tasks


@dataclass
class SuiteBook:
    """Suites by name, in the order of registration. A child suite must be registered first."""

    suites: dict[str, Suite] = field(default_factory=dict)
    combiners: dict[str, Combine] = field(default_factory=dict)

    def register_suite(
        self, name: str, kind: str, children: Iterable[str], tasks: Iterable[str] = ()
    ) -> None:
        """Add a suite. A child is a suite if one of that name exists, unless listed in ``tasks``."""
        if kind not in KINDS and kind not in self.combiners:
            raise ValueError(f"unknown kind {kind!r}")
        children, tasks = tuple(children), set(tasks)
        nested = frozenset(c for c in children if c in self.suites and c not in tasks)
        self.suites[name] = Suite(name, kind, children, nested)

    def register_kind(self, kind: str, combine: Combine) -> None:
        """Add a kind with its own ``combine(cells, book, name)``; None means not combinable."""
        self.combiners[kind] = combine

    def names(self) -> list[str]:
        return list(self.suites)

    def exists(self, name: Filter) -> bool:
        return bool(self.search(name))

    def search(self, name: Filter) -> list[str]:
        """Suites of exactly this name, or all that contain a match of a compiled pattern."""
        if isinstance(name, re.Pattern):
            return [s for s in self.suites if name.search(s) is not None]
        return [s for s in self.suites if s == name]

    def get(self, name: str) -> Suite:
        if name not in self.suites:
            raise ValueError(f"suite {name!r} not found")
        return self.suites[name]

    def leaves(self, name: str) -> list[str]:
        """Distinct leaf tasks in declaration order."""
        suite = self.get(name)
        found: dict[str, None] = {}
        for child in suite.children:
            found.update(dict.fromkeys(self.leaves(child) if child in suite.suites else (child,)))
        return list(found)

    def expand(self, names: Iterable[str]) -> list[str]:
        """Sorted distinct tasks of suites and plain task names."""
        tasks: set[str] = set()
        for name in names:
            tasks.update(self.leaves(name) if name in self.suites else (name,))
        return sorted(tasks)

    def own_weights(self, name: str, view_in_view_is_null: bool = True) -> dict[str, float] | None:
        """Weight of each leaf in the suite's own average; None when that average is always null.

        A VIEW has no column, so as a child of an AOA or VIEW it contributes a null column, which
        makes a parent average null. With ``view_in_view_is_null=False`` it counts as an AOA.
        """
        suite = self.get(name)
        if suite.kind == "LIST":
            raise TypeError(f"suite {name!r} cannot be averaged")
        if suite.kind == "AVG":
            leaves = self.leaves(name)
            return {leaf: 1.0 / len(leaves) for leaf in leaves}
        children = list(dict.fromkeys(suite.children))
        total: dict[str, float] = {}
        for child in children:
            weights = self.column_weights(suite, child, view_in_view_is_null)
            if weights is None:
                return None
            for leaf, weight in weights.items():
                total[leaf] = total.get(leaf, 0.0) + weight / len(children)
        return total

    def column_weights(
        self, suite: Suite, child: str, view_in_view_is_null: bool = True
    ) -> dict[str, float] | None:
        if child not in suite.suites:
            return {child: 1.0}
        if self.suites[child].kind == "VIEW" and view_in_view_is_null:
            return None
        return self.own_weights(child, view_in_view_is_null)

    def columns(self, name: str, view_in_view_is_null: bool = True) -> dict[str, dict[str, float] | None]:
        """Columns a combined suite shows, in order, with their leaf weights.

        AVG: its leaves and itself. AOA: its direct children and itself. VIEW: its direct children.
        """
        suite = self.get(name)
        if suite.kind == "AVG":
            shown: dict = {leaf: {leaf: 1.0} for leaf in self.leaves(name)}
        else:
            shown = {c: self.column_weights(suite, c, view_in_view_is_null) for c in suite.children}
        if suite.kind != "VIEW":
            shown[name] = self.own_weights(name, view_in_view_is_null)
        return shown

    def edges(self, spark: SparkSession) -> DataFrame:
        """The book as a table ``suite, kind, ord, child, child_is_suite``."""
        rows = [
            (s.name, s.kind, i, child, child in s.suites)
            for s in self.suites.values()
            for i, child in enumerate(s.children)
        ]
        return local_table(spark, rows, EDGE_TYPE)


def book_from_edges(edges: DataFrame, names: Sequence[str]) -> SuiteBook:
    """Book of the named suites, and those inside them, of an edge table ``suite, kind, ord, child, child_is_suite``.

    A dashboard names its columns, so the definitions behind them come to the driver, one nesting level at a
    time; other suites stay in the table. :func:`suite_weights` and :func:`score_weights` score suites of any
    number as data.
    """
    rows, known, wanted = [], set(), set(names)
    while wanted:
        found = edges.filter(F.col("suite").isin(*wanted)).select("suite", "kind", "ord", "child", "child_is_suite").collect()
        rows += found
        known |= wanted
        wanted = {r["child"] for r in found if r["child_is_suite"]} - known
    book = SuiteBook()
    for row in sorted(rows, key=lambda r: (r["suite"], r["ord"])):
        known = book.suites.get(row["suite"], Suite(row["suite"], row["kind"], (), frozenset()))
        nested = known.suites | ({row["child"]} if row["child_is_suite"] else set())
        book.suites[row["suite"]] = Suite(row["suite"], row["kind"], (*known.children, row["child"]), nested)
    return book


def score_columns(
    cells: DataFrame,
    columns: dict[str, dict[str, float] | None],
    direct: Column | None = None,
) -> DataFrame:
    """``model, task, score`` of weighted columns, dense over every model of ``cells``.

    A score is null unless the model has all leaves of the column. Cells for which ``direct`` holds
    are also passed through under their own task name; a stored cell then wins over the weighted
    column of the same name, even when it is null.

    The cells are read once. Each cell meets a table with one row per leaf (local data, so Spark
    broadcasts it or not by its true size), partial sums go to one row per model and column, and
    the columns a model lacks are added when its row is put together. That row is never longer
    than the list of columns.
    """
    entries: dict[str, list[tuple[str, float, int]]] = {}
    for column, weights in columns.items():
        for leaf, weight in (weights or {}).items():
            entries.setdefault(leaf, []).append((column, weight, len(weights)))
    rows = [
        (task, [dict(zip(("column", "weight", "n_leaves"), use)) for use in found])
        for task, found in entries.items()
    ]
    uses = local_table(cells.sparkSession, rows, USE_TYPE)

    none = F.array().cast(USES)
    into = F.coalesce("uses", none)
    if direct is not None:  # a use without a weight passes the cell through under its own name
        own = F.struct(
            F.col("task").alias("column"),
            F.lit(None).cast("double").alias("weight"),
            F.lit(None).cast("int").alias("n_leaves"),
        )
        into = F.concat(into, F.when(direct, F.array(own)).otherwise(none))
    passed = F.col("use.column").isNotNull() & F.col("use.weight").isNull()
    by_column = (
        cells.join(uses, "task", "left")
        .select("model", "score", F.explode_outer(into).alias("use"))
        .select(
            "model",
            F.col("use.column").alias("task"),
            F.col("use.n_leaves").alias("n_leaves"),
            (F.col("score") * F.col("use.weight")).alias("part"),
            F.when(passed, F.col("score")).alias("own"),
            passed.cast("int").alias("passed"),
        )
        .groupBy("model", "task")
        .agg(
            F.when(F.max("passed") == 1, F.max("own"))
            .when(F.count("part") == F.max("n_leaves"), F.sum("part"))
            .alias("score")
        )
    )
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    return _dense(by_column, names)


def score_weights(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """``model, suite, score`` for a weight table ``suite, task, weight`` of any size.

    The same pass as :func:`score_columns` for suites that are data: the leaves of a suite are counted
    from the table, and every model gets every suite, null unless it has all leaves.
    """
    sizes = weights.groupBy("suite").agg(F.count(F.lit(1)).alias("n_leaves"))
    sized = weights.join(sizes, "suite").select("suite", "task", "weight", "n_leaves")
    by_suite = (
        cells.join(sized, "task", "left")
        .groupBy("model", F.col("suite").alias("task"))
        .agg(
            F.when(
                F.count(F.col("score") * F.col("weight")) == F.max("n_leaves"),
                F.sum(F.col("score") * F.col("weight")),
            ).alias("score")
        )
    )
    names = weights.agg(F.collect_set("suite")).scalar()
    return _dense(by_suite, names).withColumnRenamed("task", "suite")


def _dense(by_column: DataFrame, names: Column) -> DataFrame:
    """Add the missing columns of every model with null; a null task only marks that a model exists."""
    found = F.collect_list(F.when(F.col("task").isNotNull(), F.struct("task", "score")))
    absent = F.array_except(names, F.transform("found", lambda c: c["task"]))
    blank = F.transform(
        "absent", lambda name: F.struct(name.alias("task"), F.lit(None).cast("double").alias("score"))
    )
    return (
        by_column.groupBy("model")
        .agg(found.alias("found"))
        .withColumn("absent", absent)
        .select("model", F.explode(F.concat("found", blank)).alias("c"))
        .select("model", "c.task", "c.score")
    )


def combine(
    cells: DataFrame, book: SuiteBook, name: str, view_in_view_is_null: bool = True
) -> DataFrame | None:
    """All columns a suite shows, for every model; None for a suite that is only a list."""
    suite = book.get(name)
    if suite.kind in book.combiners:
        return book.combiners[suite.kind](cells, book, name)
    if suite.kind == "LIST":
        return None
    return score_columns(cells, book.columns(name, view_in_view_is_null))


def suite_scores(
    cells: DataFrame, book: SuiteBook, names: Sequence[str] | None = None
) -> DataFrame:
    """Own averages of many suites in one aggregation; views and lists have none."""
    names = book.names() if names is None else names
    wanted = {n: book.own_weights(n) for n in names if book.get(n).kind in ("AVG", "AOA")}
    return score_columns(cells, wanted).withColumnRenamed("task", "suite")


def leaf_closure(edges: DataFrame) -> DataFrame:
    """``suite, task``: distinct leaves of every suite of an edge table."""
    links = edges.select("suite", "child", "child_is_suite", F.lit(1.0).alias("weight"))
    return _expand(links, links).select("suite", "task").distinct()


def suite_weights(edges: DataFrame) -> DataFrame:
    """``suite, task, weight`` of the AVG and AOA suites of an edge table.

    A VIEW among the children has no score of its own: it stays a leaf that no model has, so the
    parent's average is null. A LIST among them fails the query. Runs small jobs over the edges,
    which should be a stored table.
    """
    links = edges.select("suite", "child", "child_is_suite", F.lit(1.0).alias("weight"))
    average = edges.filter("kind = 'AVG'").select("suite").distinct()
    flat = _expand(links.join(average, "suite"), links).select(
        "suite", F.col("task").alias("child"), F.lit(False).alias("child_is_suite")
    )
    kinds = edges.select(F.col("suite").alias("child"), F.col("kind").alias("child_kind")).distinct()
    a_list = F.raise_error(F.concat(F.col("child"), F.lit(" is a list and cannot be averaged")))
    opens = F.when(F.col("child_kind") == "LIST", a_list.cast("boolean")).otherwise(
        F.col("child_kind").isin("AVG", "AOA")
    )
    nested = edges.filter("kind = 'AOA'").join(kinds, "child", "left").select(
        "suite", "child", (F.col("child_is_suite") & F.coalesce(opens, F.lit(False))).alias("child_is_suite")
    )
    both = flat.unionByName(nested).distinct()
    sizes = both.groupBy("suite").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    weighted = stage(both.join(sizes, "suite"))
    return _expand(weighted, weighted).groupBy("suite", "task").agg(F.sum("weight").alias("weight"))


def _expand(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``suite, task, weight``: replace child suites by their own links, multiplying weights.

    Both inputs are ``(suite, child, child_is_suite, weight)``. One join per nesting level, whose
    result is staged; stops when no suite is left to expand.
    """
    inner = links.select(
        F.col("suite").alias("_parent"),
        F.col("child").alias("_child"),
        F.col("child_is_suite").alias("_is_suite"),
        F.col("weight").alias("_weight"),
    )
    _refuse_cycles(links)
    leaves = roots.filter(~F.col("child_is_suite")).select("suite", F.col("child").alias("task"), "weight")
    pending = roots.filter("child_is_suite").select("suite", "child", "weight")
    while not pending.isEmpty():
        step = pending.join(inner, F.col("child") == F.col("_parent")).groupBy(
            "suite", "_child", "_is_suite"
        ).agg(F.sum(F.col("weight") * F.col("_weight")).alias("weight"))
        step = stage(step)
        leaves = leaves.unionByName(
            step.filter(~F.col("_is_suite")).select("suite", F.col("_child").alias("task"), "weight")
        )
        pending = step.filter("_is_suite").select("suite", F.col("_child").alias("child"), "weight")
    return leaves


def _refuse_cycles(links: DataFrame) -> None:
    """Raise when a suite reaches itself: suites without open child suites are taken off until none are left."""
    inner = stage(links.filter("child_is_suite").select("suite", "child").distinct())
    left = inner.count()
    while left:
        opens = inner.select(F.col("suite").alias("_open")).distinct()
        inner = stage(inner.join(opens, F.col("child") == F.col("_open"), "left_semi"))
        before, left = left, inner.count()
        if left == before:
            raise ValueError(f"suite {inner.first()['suite']} is part of a cycle or holds one")


def member_cells(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Inner join of cells with a membership table ``suite, task``; no size is assumed."""
    return cells.join(members, "task").select("suite", "model", "task", "score")
