"""Registered queries: every operator over the shared test tables, with its SQL twin.

Each query reads whole tables. The SQL is what another engine computes on the same tables; queries
whose result it cannot express have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremill.functions import display, metrics, names, paths, tags
from scoremill.functions.patterns import compile_filters
from scoremill.operators import cells as cell_ops
from scoremill.operators import contamination, coverage, manifest, mixture, ordering, quality, sequences, suites
from scoremill.operators import experiments as exp
from scoremill.operators.newest import newest
from scoremill.plans import bindings as b
from scoremill.plans import dashboard, mixes
from scoremill.session import local_table, shared_dir, stage
from scoremill.sources import export, landing, manifests, records, token_shards
from scoremill.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
EVENT_RECORDS = f"""
SELECT event_id, 'm' || user_id AS model, event_type || ':' || ({K} % 4) AS task,
       value / 1000 AS score, ts
FROM events"""
EVENT_CELLS = f"""
SELECT model, task, score FROM (
  SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY ts DESC, event_id DESC) AS n
  FROM ({EVENT_RECORDS}) AS r) AS x
WHERE n = 1"""
NULL_CELLS = f"SELECT model, task, CASE WHEN score <= 0.22 THEN score END AS score FROM ({EVENT_CELLS}) AS c"
LINEITEM_CELLS = """
SELECT model, task, score, l_shipdate FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS model, l_returnflag || l_linestatus AS task,
         l_discount AS score, l_shipdate,
         row_number() OVER (PARTITION BY l_suppkey, l_returnflag || l_linestatus
           ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC,
                    l_discount DESC) AS n
  FROM lineitem) AS x
WHERE n = 1"""
EXPERIMENTS = f"""
SELECT CAST(event_id AS VARCHAR) AS experiment_id, 'm' || user_id AS model_name, event_type, {K} AS k,
       event_type || ':' || ({K} % 4) || ',' || event_type || ':mc,extra:' || ({K} % 3) AS task_name,
       ts AS created, event_id
FROM events"""


def registered(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


# ---- newest records and score tables -------------------------------------------------------------


@registered("newest_event_scores", EVENT_CELLS)
def newest_event_scores(spark, d):
    return b.event_cells(spark, d)


@registered("newest_lineitem_scores", LINEITEM_CELLS)
def newest_lineitem_scores(spark, d):
    return b.lineitem_cells(spark, d)


@registered(
    "newest_lineitem_records",
    """SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag
        ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice, l_partkey) AS n FROM lineitem) AS x
    WHERE n = 1""",
)
def newest_lineitem_records(spark, d):
    items = b.table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    order = [F.desc("l_shipdate"), *(F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"))]
    return newest(items, ["l_suppkey", "l_returnflag"], order)


@registered(
    "keep_columns",
    f"SELECT * FROM ({EVENT_CELLS}) AS c WHERE task = 'click:0' OR regexp_matches(task, 'err.*[12]$')",
)
def keep_columns(spark, d):
    return cell_ops.keep_columns(b.event_cells(spark, d), compile_filters(["click:0", "err.*[12]$"]))


@registered(
    "drop_columns",
    f"SELECT * FROM ({EVENT_CELLS}) AS c WHERE NOT (task = 'click:0' OR regexp_matches(task, 'err.*[12]$'))",
)
def drop_columns(spark, d):
    return cell_ops.drop_columns(b.event_cells(spark, d), compile_filters(["click:0", "err.*[12]$"]))


@registered(
    "keep_rows",
    f"SELECT * FROM ({EVENT_CELLS}) AS c WHERE model = 'm7' OR regexp_matches(model, '^m1.$')",
)
def keep_rows(spark, d):
    return cell_ops.keep_rows(b.event_cells(spark, d), compile_filters(["m7", "^m1.$"]))


@registered(
    "drop_rows",
    f"SELECT * FROM ({EVENT_CELLS}) AS c WHERE NOT (model = 'm7' OR regexp_matches(model, '^m1.$'))",
)
def drop_rows(spark, d):
    return cell_ops.drop_rows(b.event_cells(spark, d), compile_filters(["m7", "^m1.$"]))


@registered(
    "drop_empty",
    f"""WITH c AS ({NULL_CELLS}) SELECT * FROM c
    WHERE task NOT IN (SELECT task FROM c WHERE score IS NULL)""",
)
def drop_empty(spark, d):
    return cell_ops.drop_empty(stage(b.nullable_cells(spark, d)))


@registered(
    "keep_matching_tasks",
    f"""WITH p AS (SELECT DISTINCT '^[a-u].*:' || (user_id % 2) || '$' AS pattern FROM events)
    SELECT * FROM ({EVENT_CELLS}) AS c
    WHERE EXISTS (SELECT 1 FROM p WHERE regexp_matches(c.task, p.pattern))""",
)
def keep_matching_tasks(spark, d):
    patterns = b.events(spark, d).select(
        F.concat(F.lit("^[a-u].*:"), (F.col("user_id") % 2).cast("string"), F.lit("$")).alias("pattern")
    )
    return cell_ops.keep_matching_tasks(stage(b.event_cells(spark, d)), patterns)


def _sides(spark, d):
    cells = stage(b.nullable_cells(spark, d))
    left = cells.filter(~F.col("task").startswith("view"))
    right = cells.filter(~F.col("task").startswith("click")).withColumn("score", F.col("score") + 1)
    return left, right


SIDES = f"""c AS ({NULL_CELLS}),
    l AS (SELECT * FROM c WHERE task NOT LIKE 'view%'),
    r AS (SELECT model, task, score + 1 AS score FROM c WHERE task NOT LIKE 'click%')"""


@registered(
    "overlay",
    f"""WITH {SIDES} SELECT * FROM r UNION ALL
    SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model = l.model AND r.task = l.task)""",
)
def overlay(spark, d):
    return cell_ops.overlay(*_sides(spark, d))


@registered(
    "fill_without_overwrite",
    f"""WITH {SIDES} SELECT coalesce(l.model, r.model) AS model, coalesce(l.task, r.task) AS task,
      coalesce(l.score, r.score) AS score
    FROM l FULL JOIN r ON l.model = r.model AND l.task = r.task""",
)
def fill_without_overwrite(spark, d):
    return cell_ops.fill(*_sides(spark, d))


@registered(
    "put_cells",
    f"""SELECT * FROM ({EVENT_CELLS}) AS c WHERE NOT (model = 'm1' AND task IN ('click:0', 'new'))
    UNION ALL SELECT 'm1', 'click:0', CAST(NULL AS DOUBLE) UNION ALL SELECT 'm1', 'new', 0.5""",
)
def put_cells(spark, d):
    return cell_ops.put(b.event_cells(spark, d), ("m1", "click:0", None), ("m1", "new", 0.5))


@registered(
    "densify",
    f"""WITH c AS ({EVENT_CELLS}), m AS (SELECT DISTINCT model FROM c),
      t(task) AS (VALUES ('click:0'), ('error:3'), ('never:0'))
    SELECT m.model, t.task, c.score FROM m CROSS JOIN t
    LEFT JOIN c ON c.model = m.model AND c.task = t.task""",
)
def densify(spark, d):
    return cell_ops.densify(b.event_cells(spark, d), ["click:0", "error:3", "never:0"])


@registered(
    "missing_per_row",
    f"""WITH c AS ({NULL_CELLS}), m AS (SELECT DISTINCT model FROM c), t AS (SELECT DISTINCT task FROM c)
    SELECT m.model, coalesce(string_agg(CASE WHEN c.score IS NULL THEN t.task END, ',' ORDER BY t.task), '') AS missing
    FROM m CROSS JOIN t LEFT JOIN c ON c.model = m.model AND c.task = t.task GROUP BY 1""",
)
def missing_per_row(spark, d):
    rows = cell_ops.missing_per_row(stage(b.nullable_cells(spark, d)))
    return rows.withColumn("missing", F.array_join("missing", ","))


@registered(
    "shape",
    f"""SELECT count(*) AS n_columns, max(n) AS n_rows
    FROM (SELECT task, count(*) AS n FROM ({NULL_CELLS}) AS c GROUP BY 1) AS x""",
)
def shape(spark, d):
    return cell_ops.shape(b.nullable_cells(spark, d))


@registered(
    "column_sets",
    f"""WITH {SIDES} SELECT 'difference' AS op, task FROM (SELECT task FROM l EXCEPT SELECT task FROM r) AS x
    UNION ALL SELECT 'intersection', task FROM (SELECT task FROM l INTERSECT SELECT task FROM r) AS x
    UNION ALL SELECT 'union', task FROM (SELECT task FROM l UNION SELECT task FROM r) AS x""",
)
def column_sets(spark, d):
    left, right = _sides(spark, d)
    named = {
        "difference": cell_ops.column_difference(left, right),
        "intersection": cell_ops.column_intersection(left, right),
        "union": cell_ops.column_union(left, right),
    }
    parts = [frame.select(F.lit(op).alias("op"), "task") for op, frame in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered(
    "append_new_columns",
    f"""WITH {SIDES} SELECT * FROM l UNION ALL
    SELECT * FROM r WHERE task NOT IN (SELECT task FROM l)""",
)
def append_new_columns(spark, d):
    return cell_ops.append_new_columns(*_sides(spark, d))


# ---- suites and the dashboard --------------------------------------------------------------------


def _dense_suite(members: list[str]) -> str:
    listed = ", ".join(f"'{m}'" for m in members)
    return f"""SELECT m.model, CASE WHEN count(c.score) = {len(members)} THEN avg(c.score) END AS score
      FROM m LEFT JOIN c ON c.model = m.model AND c.task IN ({listed}) GROUP BY 1"""


EVENT_SUITES = f"""c AS ({EVENT_CELLS}), m AS (SELECT DISTINCT model FROM c),
  click AS ({_dense_suite([f"click:{i}" for i in range(4)])}),
  view_ AS ({_dense_suite([f"view:{i}" for i in range(4)])}),
  one AS (SELECT m.model, max(CASE WHEN task = 'signup:0' THEN score END) AS signup0,
      max(CASE WHEN task = 'error:0' THEN score END) AS error0,
      max(CASE WHEN task = 'error:1' THEN score END) AS error1
    FROM m LEFT JOIN c ON c.model = m.model GROUP BY 1),
  s AS (SELECT one.*, click.score AS click, view_.score AS view_,
      (click.score + view_.score + signup0) / 3 AS engage
    FROM one JOIN click USING (model) JOIN view_ USING (model))"""


@registered(
    "suite_average",
    f"""WITH {EVENT_SUITES} SELECT model, task, round(score, 9) AS score FROM (
      SELECT model, 'click' AS task, click AS score FROM s UNION ALL
      SELECT m.model, t.task, c.score FROM m
        CROSS JOIN (VALUES ('click:0'), ('click:1'), ('click:2'), ('click:3')) AS t(task)
        LEFT JOIN c ON c.model = m.model AND c.task = t.task) AS x""",
)
def suite_average(spark, d):
    return _rounded(suites.combine(b.event_cells(spark, d), b.event_suites(), "click"))


@registered(
    "lineitem_suite_average",
    f"""WITH c AS ({LINEITEM_CELLS}), m AS (SELECT DISTINCT model FROM c)
    SELECT m.model, 'returned' AS suite,
      round(CASE WHEN count(c.score) = 2 THEN avg(c.score) END, 9) AS score
    FROM m LEFT JOIN c ON c.model = m.model AND c.task IN ('RF', 'RO') GROUP BY 1
    UNION ALL
    SELECT m.model, 'everything', round(CASE WHEN count(c.score) = 6 THEN avg(c.score) END, 9)
    FROM m LEFT JOIN c ON c.model = m.model AND c.task IN ('AF', 'AO', 'NF', 'NO', 'RF', 'RO') GROUP BY 1""",
)
def lineitem_suite_average(spark, d):
    book = suites.SuiteBook()
    book.register_suite("returned", "AVG", ["RF", "RO"])
    book.register_suite("everything", "AVG", ["AF", "AO", "NF", "NO", "RF", "RO"])
    cells = b.lineitem_cells(spark, d)
    return _rounded(suites.suite_scores(cells, book))


@registered(
    "average_of_averages",
    f"""WITH {EVENT_SUITES} SELECT model, 'click' AS task, round(click, 9) AS score FROM s
    UNION ALL SELECT model, 'view', round(view_, 9) FROM s
    UNION ALL SELECT model, 'signup:0', round(signup0, 9) FROM s
    UNION ALL SELECT model, 'engage', round(engage, 9) FROM s""",
)
def average_of_averages(spark, d):
    return _rounded(suites.combine(b.event_cells(spark, d), b.event_suites(), "engage"))


@registered(
    "suite_view",
    f"""WITH {EVENT_SUITES} SELECT model, 'engage' AS task, round(engage, 9) AS score FROM s
    UNION ALL SELECT model, 'error:0', round(error0, 9) FROM s""",
)
def suite_view(spark, d):
    return _rounded(suites.combine(b.event_cells(spark, d), b.event_suites(), "board"))


@registered(
    "nested_view",
    f"""WITH {EVENT_SUITES} SELECT model, 'board' AS task, CAST(NULL AS DOUBLE) AS score FROM s
    UNION ALL SELECT model, 'click', round(click, 9) FROM s
    UNION ALL SELECT model, 'error:1', round(error1, 9) FROM s""",
)
def nested_view(spark, d):
    return _rounded(suites.combine(b.event_cells(spark, d), b.event_suites(), "overview"))


@registered(
    "suite_members",
    f"""WITH c AS ({EVENT_CELLS})
    SELECT DISTINCT split_part(task, ':', 1) AS suite, model, task, score FROM c
    UNION ALL SELECT DISTINCT 'class' || split_part(task, ':', 2), model, task, score FROM c
    UNION ALL SELECT DISTINCT 'all', model, task, score FROM c""",
)
def suite_members(spark, d):
    closure = suites.leaf_closure(b.event_edges(spark, d))
    return suites.member_cells(b.event_cells(spark, d), stage(closure))


@registered(
    "leaf_closure",
    f"""WITH t AS (SELECT DISTINCT event_type, ({K} % 4) AS c, event_type || ':' || ({K} % 4) AS task FROM events)
    SELECT event_type AS suite, task FROM t UNION ALL SELECT 'class' || c, task FROM t
    UNION ALL SELECT 'all', task FROM t""",
)
def leaf_closure(spark, d):
    return suites.leaf_closure(b.event_edges(spark, d))


@registered(
    "suites_from_edges",
    f"""WITH c AS ({EVENT_CELLS}), m AS (SELECT DISTINCT model FROM c),
      t AS (SELECT DISTINCT event_type AS suite, event_type || ':' || ({K} % 4) AS task FROM events),
      x AS (SELECT m.model, t.suite, CASE WHEN count(c.score) = count(*) THEN avg(c.score) END AS score
        FROM m CROSS JOIN t LEFT JOIN c ON c.model = m.model AND c.task = t.task GROUP BY 1, 2)
    SELECT model, suite, round(score, 9) AS score FROM x UNION ALL
    SELECT model, 'all', round(CASE WHEN count(score) = count(*) THEN avg(score) END, 9) FROM x GROUP BY 1""",
)
def suites_from_edges(spark, d):
    weights = stage(suites.suite_weights(b.event_edges(spark, d)))
    return _rounded(suites.score_weights(b.event_cells(spark, d), weights))


DASHBOARD_TASKS = ["engage", "board", "extras", "purchase:[12]", "click:0"]


@registered(
    "dashboard_results",
    f"""WITH {EVENT_SUITES} SELECT model, 'click' AS task, round(click, 9) AS score FROM s
    UNION ALL SELECT model, 'view', round(view_, 9) FROM s
    UNION ALL SELECT model, 'signup:0', round(signup0, 9) FROM s
    UNION ALL SELECT model, 'engage', round(engage, 9) FROM s
    UNION ALL SELECT model, 'error:0', round(error0, 9) FROM s
    UNION ALL SELECT model, task, round(score, 9) FROM c
      WHERE task IN ('purchase:0', 'purchase:1', 'purchase:2', 'click:0')""",
)
def dashboard_results(spark, d):
    return _rounded(dashboard.results(b.event_cells(spark, d), DASHBOARD_TASKS, b.event_suites()))


@registered(
    "dashboard_for_models",
    f"""WITH {EVENT_SUITES} SELECT model, 'engage' AS task, round(engage, 9) AS score FROM s
      WHERE regexp_matches(model, '^m1[0-9]$')
    UNION ALL SELECT model, 'click', round(click, 9) FROM s WHERE regexp_matches(model, '^m1[0-9]$')
    UNION ALL SELECT model, 'view', round(view_, 9) FROM s WHERE regexp_matches(model, '^m1[0-9]$')
    UNION ALL SELECT model, 'signup:0', round(signup0, 9) FROM s WHERE regexp_matches(model, '^m1[0-9]$')""",
)
def dashboard_for_models(spark, d):
    cells = b.event_cells(spark, d)
    return _rounded(dashboard.results(cells, ["engage"], b.event_suites(), ["^m1[0-9]$"]))


@registered(
    "dashboard_report",
    f"""WITH {EVENT_SUITES} SELECT model, round(engage, 9) AS engage, round(error0, 9) AS "error:0",
      round(click, 9) AS click, round(view_, 9) AS "view", round(signup0, 9) AS "signup:0" FROM s""",
)
def dashboard_report(spark, d):
    report = dashboard.report(stage(b.event_cells(spark, d)), ["engage", "board"], b.event_suites())
    return report.select("model", *(F.round(F.col(f"`{c}`"), 9).alias(c) for c in report.columns[1:]))


@registered(
    "custom_combine",
    f"""WITH c AS ({EVENT_CELLS}) SELECT model, 'best' AS task, max(score) AS score FROM c
    WHERE task IN ('click:0', 'view:0') GROUP BY 1""",
)
def custom_combine(spark, d):
    def best(cells, book, name):
        mine = cell_ops.keep_columns(cells, book.leaves(name))
        return mine.groupBy("model").agg(F.max("score").alias("score")).select(
            "model", F.lit(name).alias("task"), "score"
        )

    book = b.event_suites()
    book.register_kind("MAX", best)
    book.register_suite("best", "MAX", ["click:0", "view:0"])
    return dashboard.results(b.event_cells(spark, d), ["best"], book)


@registered(
    "suite_listing",
    f"""WITH t AS (SELECT DISTINCT event_type, ({K} % 4) AS c, event_type || ':' || ({K} % 4) AS task FROM events),
      l AS (SELECT event_type AS suite, task FROM t UNION ALL SELECT 'class' || c, task FROM t
        UNION ALL SELECT 'all', task FROM t),
      shown AS (SELECT * FROM l WHERE suite = 'click' OR regexp_matches(suite, 'class[01]')
        OR regexp_matches(task, 'view:.*')  OR regexp_matches(task, 'class[01]'))
    SELECT shown.suite, shown.task, count(*) OVER (PARTITION BY shown.suite) AS matched, n.total
    FROM shown JOIN (SELECT suite, count(*) AS total FROM l GROUP BY 1) AS n ON n.suite = shown.suite""",
)
def suite_listing(spark, d):
    closure = stage(suites.leaf_closure(b.event_edges(spark, d)))
    return coverage.list_suites(closure, compile_filters(["click", "class[01]", "view:.*"]))


# ---- coverage ------------------------------------------------------------------------------------

MISSING_COLUMNS = ["engage", "click", "view", "signup:0", "error:0"]
MISSING_SQL = f"""{EVENT_SUITES},
  gap AS (SELECT model, 'engage' AS col FROM s WHERE engage IS NULL UNION ALL
    SELECT model, 'click' FROM s WHERE click IS NULL UNION ALL
    SELECT model, 'view' FROM s WHERE view_ IS NULL UNION ALL
    SELECT model, 'signup:0' FROM s WHERE signup0 IS NULL UNION ALL
    SELECT model, 'error:0' FROM s WHERE error0 IS NULL),
  leaf(col, task) AS (VALUES ('signup:0', 'signup:0'), ('error:0', 'error:0'), ('engage', 'signup:0'),
    ('click', 'click:0'), ('click', 'click:1'), ('click', 'click:2'), ('click', 'click:3'),
    ('engage', 'click:0'), ('engage', 'click:1'), ('engage', 'click:2'), ('engage', 'click:3'),
    ('view', 'view:0'), ('view', 'view:1'), ('view', 'view:2'), ('view', 'view:3'),
    ('engage', 'view:0'), ('engage', 'view:1'), ('engage', 'view:2'), ('engage', 'view:3')),
  missing AS (SELECT gap.model, gap.col, leaf.task FROM gap JOIN leaf ON leaf.col = gap.col)"""


def _event_results(spark, d):
    return dashboard.results(b.event_cells(spark, d), ["engage", "board"], b.event_suites())


@registered(
    "missing_tasks", f'WITH {MISSING_SQL} SELECT model, col AS "column", task FROM missing'
)
def missing_tasks(spark, d):
    return coverage.missing_tasks(_event_results(spark, d), MISSING_COLUMNS, b.event_suites())


@registered(
    "missing_leaves",
    f"""WITH {MISSING_SQL} SELECT model, col AS "column", task FROM missing
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.model = missing.model AND c.task = missing.task)""",
)
def missing_leaves(spark, d):
    cells = stage(b.event_cells(spark, d))
    book = b.event_suites()
    table = stage(cell_ops.overlay(dashboard.results(cells, ["engage", "board"], book), cells))
    return coverage.missing_tasks(table, MISSING_COLUMNS, book, scope="leaf")


@registered(
    "missing_report",
    f"""WITH {MISSING_SQL}, x AS (SELECT DISTINCT model, task FROM missing
      WHERE (regexp_matches(task, '^view:[0-9]') OR task LIKE 'click:%' OR task = 'signup:0')
        AND regexp_matches(model, '^m.*[0-4]$'))
    SELECT model, count(*) AS n_missing, string_agg(task, ',' ORDER BY task) AS tasks FROM x GROUP BY 1""",
)
def missing_report(spark, d):
    book = b.event_suites()
    missing = coverage.missing_tasks(_event_results(spark, d), MISSING_COLUMNS, book)
    report = coverage.missing_report(missing, ["^view:[0-9]", "click", "signup:0"], book, ["^m.*[0-4]$"])
    return report.select(
        "model", F.col("n_missing").cast("bigint").alias("n_missing"), F.array_join("tasks", ",").alias("tasks")
    )


@registered(
    "work_list",
    f"""WITH r AS (SELECT DISTINCT 'm' || user_id AS model,
        CASE {K} % 4 WHEN 0 THEN event_type || ':rc::set' WHEN 1 THEN event_type || ':mc::set'
          WHEN 2 THEN 'fim_' || event_type ELSE event_type || ':' || {K} END
        || CASE WHEN {K} % 10 = 9 THEN ':pass_at_4' ELSE '' END AS task FROM events),
      t AS (SELECT model, task, CASE WHEN task LIKE '%:rc::%' THEN 'rc' WHEN task LIKE '%:mc::%' THEN 'mc'
        WHEN task LIKE '%fim\\_%' ESCAPE '\\' THEN 'fim' ELSE 'gen' END AS launch_class FROM r
        WHERE NOT regexp_matches(task, '^.*:pass_at_.*$'))
    SELECT model, launch_class, CAST((row_number() OVER (PARTITION BY model, launch_class ORDER BY task) - 1) // 3
      AS INTEGER) AS chunk, task FROM t""",
)
def work_list(spark, d):
    k, kind = F.col("k"), F.col("event_type")
    task = (
        F.when(k % 4 == 0, F.concat(kind, F.lit(":rc::set")))
        .when(k % 4 == 1, F.concat(kind, F.lit(":mc::set")))
        .when(k % 4 == 2, F.concat(F.lit("fim_"), kind))
        .otherwise(F.concat(kind, F.lit(":"), k.cast("string")))
    )
    task = F.concat(task, F.when(k % 10 == 9, ":pass_at_4").otherwise(""))
    missing = b.events(spark, d).select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), task.alias("task")
    )
    return coverage.work_list(missing, 3)


@registered(
    "backfill",
    f"""WITH {MISSING_SQL}, todo AS (SELECT DISTINCT model, task FROM missing
        WHERE model = (SELECT min(model) FROM s WHERE engage IS NULL))
    SELECT model, 'gen' AS launch_class,
      CAST((row_number() OVER (PARTITION BY model ORDER BY task) - 1) // 2 AS INTEGER) AS chunk, task FROM todo""",
)
def backfill(spark, d):
    cells, book = stage(b.event_cells(spark, d)), b.event_suites()
    tasks = ["engage", "board"]
    engage = suites.suite_scores(cells, book, ["engage"])
    model = engage.filter(F.col("score").isNull()).agg(F.min("model")).first()[0]
    return dashboard.backfill(cells, model, tasks, book, MISSING_COLUMNS, 2)


# ---- order, statistics, top-k --------------------------------------------------------------------


@registered(
    "sort_by_column",
    f"""WITH c AS ({NULL_CELLS}) SELECT c.*, k.sort_key FROM c JOIN (
      SELECT model, coalesce(max(CASE WHEN task = 'click:0' AND score <> 0 THEN score END),
        CAST('-infinity' AS DOUBLE)) AS sort_key FROM c GROUP BY 1) AS k ON k.model = c.model""",
)
def sort_by_column(spark, d):
    return ordering.sort_rows(stage(b.nullable_cells(spark, d)), "column", "click:0", ascending=False)


@registered(
    "sort_by_average",
    f"""WITH c AS ({NULL_CELLS}) SELECT c.model, c.task, c.score, round(k.sort_key, 9) AS sort_key
    FROM c JOIN (SELECT model, coalesce(sum(score), 0) / (SELECT count(DISTINCT task) FROM c) AS sort_key
      FROM c GROUP BY 1) AS k ON k.model = c.model""",
)
def sort_by_average(spark, d):
    cells = ordering.sort_rows(stage(b.nullable_cells(spark, d)), "average")
    return cells.withColumn("sort_key", F.round("sort_key", 9))


@registered("sort_by_name", f"SELECT *, model AS sort_key FROM ({NULL_CELLS}) AS c")
def sort_by_name(spark, d):
    return ordering.sort_rows(b.nullable_cells(spark, d), "name")


@registered(
    "row_means",
    f"""WITH c AS ({NULL_CELLS}) SELECT model,
      round(coalesce(sum(score), 0) / (SELECT count(DISTINCT task) FROM c), 9) AS mean FROM c GROUP BY 1""",
)
def row_means(spark, d):
    means = ordering.row_means(stage(b.nullable_cells(spark, d)))
    return means.withColumn("mean", F.round("mean", 9))


@registered(
    "first_seen_order",
    f"""WITH r AS ({EVENT_RECORDS}), t AS (SELECT task, min(event_id) AS pos FROM r GROUP BY 1),
      m AS (SELECT r.model, t.pos AS column_pos, min(r.event_id) AS pos FROM r JOIN t ON t.task = r.task GROUP BY 1, 2)
    SELECT model, column_pos, pos FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY column_pos, pos) AS n
      FROM m) AS x WHERE n = 1""",
)
def first_seen_order(spark, d):
    return ordering.row_order(b.event_records(spark, d), "event_id")


@registered(
    "overlay_column_order",
    f"""WITH r AS ({EVENT_RECORDS}),
      l AS (SELECT task, min(event_id) AS pos FROM r WHERE task NOT LIKE 'view%' GROUP BY 1),
      g AS (SELECT task, min(event_id) AS pos FROM r WHERE task NOT LIKE 'click%' GROUP BY 1)
    SELECT task, 0 AS side, pos FROM l UNION ALL
    SELECT task, 1, pos FROM g WHERE task NOT IN (SELECT task FROM l)""",
)
def overlay_column_order(spark, d):
    records_ = b.event_records(spark, d)
    left = ordering.column_order(records_.filter(~F.col("task").startswith("view")), "event_id")
    right = ordering.column_order(records_.filter(~F.col("task").startswith("click")), "event_id")
    return ordering.overlay_order(left, right)


@registered(
    "results_table",
    f"""WITH {EVENT_SUITES} SELECT model, round(engage, 9) AS engage, round(click, 9) AS click,
      round(view_, 9) AS "view", round(signup0, 9) AS "signup:0" FROM s""",
)
def results_table(spark, d):
    cells = dashboard.results(b.event_cells(spark, d), ["engage"], b.event_suites())
    return export.wide_sorted(_rounded(cells), ["engage", "click", "view", "signup:0"], "engage")


@registered(
    "weight_stats",
    """WITH w AS (SELECT lang AS mix, source, sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang) AS weight
      FROM documents GROUP BY 1, 2)
    SELECT mix, count(weight) AS count, round(avg(weight), 9) AS mean, round(stddev_samp(weight), 9) AS std,
      round(min(weight), 9) AS min, round(max(weight), 9) AS max FROM w GROUP BY 1""",
)
def weight_stats(spark, d):
    weights = mixture.domain_weights(b.table(spark, d, "documents"), "lang", "source", "n_chars")
    return _rounded(ordering.group_stats(weights, "mix", "weight"), "mean", "std", "min", "max")


@registered(
    "lineitem_stats",
    """SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean,
      round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max
    FROM lineitem GROUP BY 1""",
)
def lineitem_stats(spark, d):
    stats = ordering.group_stats(b.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@registered(
    "top_domains",
    """WITH w AS (SELECT lang AS mix, source AS domain,
        sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang) AS weight
      FROM documents GROUP BY 1, 2)
    SELECT mix, domain, round(weight, 9) AS weight, CAST(n AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY mix ORDER BY weight DESC, domain) AS n FROM w) AS x WHERE n <= 5""",
)
def top_domains(spark, d):
    weights = mixture.domain_weights(b.table(spark, d, "documents"), "lang", "source", "n_chars")
    return _rounded(ordering.top_k(weights, "mix", [F.desc("weight"), F.asc("domain")], 5), "weight")


@registered(
    "top_lineitems",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(n AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) AS x WHERE n <= 3""",
)
def top_lineitems(spark, d):
    items = b.table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return ordering.top_k(items, "l_suppkey", order, 3)


# ---- experiments, records, tags ------------------------------------------------------------------


@registered(
    "find_experiments",
    f"""SELECT experiment_id, model_name, task_name, created FROM ({EXPERIMENTS}) AS e
    WHERE event_type = 'click' AND created >= TIMESTAMP '2024-01-10'
    ORDER BY created DESC, experiment_id LIMIT 100""",
)
def find_experiments(spark, d):
    found = exp.find_experiments(b.event_experiments(spark, d), "click", limit=100, created_from="2024-01-10")
    return found.select("experiment_id", "model_name", "task_name", "created")


@registered(
    "find_all_experiments",
    f"""SELECT experiment_id, model_name, task_name, created FROM ({EXPERIMENTS}) AS e WHERE event_type = 'click'""",
)
def find_all_experiments(spark, d):
    found = exp.find_experiments(b.event_experiments(spark, d), "click")
    return found.select("experiment_id", "model_name", "task_name", "created")


@registered(
    "metrics_of_experiments",
    f"""WITH e AS (SELECT event_id FROM ({EXPERIMENTS}) AS x WHERE event_type = 'click' AND model_name = 'm3')
    SELECT r.* FROM ({EVENT_RECORDS}) AS r WHERE event_id IN (SELECT event_id FROM e)""",
)
def metrics_of_experiments(spark, d):
    found = exp.find_experiments(
        b.event_experiments(spark, d), "click", "m3"
    )
    recs = b.event_records(spark, d).withColumn("experiment_id", F.col("event_id").cast("string"))
    return exp.metrics_of(recs, found).drop("experiment_id")


@registered(
    "experiment_listing",
    f"""WITH e AS (SELECT *, CASE WHEN k % 3 = 1 THEN ',extra:1' ELSE '' END AS extra FROM ({EXPERIMENTS}) AS x
        WHERE model_name = 'm5')
    SELECT experiment_id, model_name, event_type || ':mc' || extra AS tasks,
      'dashboard=' || event_type || ',k=' || k AS tags, 1 + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS n_tasks
    FROM e""",
)
def experiment_listing(spark, d):
    listed = exp.list_experiments(b.event_experiments(spark, d), "m5", [":mc$", "^extra:1"])
    return listed.withColumn("tasks", F.array_join("tasks", ","))


@registered(
    "add_to_dashboard",
    f"""SELECT experiment_id, 'dashboard=' || event_type || ',k=' || k
        || CASE WHEN model_name = 'm7' AND event_type = 'view' THEN ',dashboard=click' ELSE '' END AS tags,
      model_name = 'm7' AND event_type = 'view' AS changed FROM ({EXPERIMENTS}) AS e""",
)
def add_to_dashboard(spark, d):
    tagged = exp.add_to_dashboard(b.event_experiments(spark, d), "m7", "click", source_dashboard="view")
    return tagged.select("experiment_id", tags.render_tags(F.col("tags")).alias("tags"), "changed")


@registered(
    "remove_from_dashboard",
    f"""SELECT experiment_id, CASE WHEN model_name LIKE '%m7%' AND event_type = 'click' THEN ''
        ELSE 'dashboard=' || event_type || ',' END || 'k=' || k AS tags,
      model_name LIKE '%m7%' AND event_type = 'click' AS changed FROM ({EXPERIMENTS}) AS e""",
)
def remove_from_dashboard(spark, d):
    tagged = exp.remove_from_dashboard(b.event_experiments(spark, d), "m7", "click", fuzzy=True)
    return tagged.select("experiment_id", tags.render_tags(F.col("tags")).alias("tags"), "changed")


RECORD_ALIAS = f"""event_type || CASE {K} % 5 WHEN 0 THEN ':rc::set' WHEN 1 THEN ':mc' WHEN 2 THEN '::suite' ELSE '' END"""
RAW_CONFIG = f"""'{{"metadata":{{' || CASE WHEN {K} % 7 <> 0 THEN '"alias":"' || {RECORD_ALIAS} || '"' ELSE '"kind":"plain"' END
  || CASE WHEN {K} % 11 = 0 THEN ',"num_tasks":3' ELSE '' END || '}},"k":' || {K} || '}}'"""
DESCRIBED = f"""
SELECT event_id, 'm' || user_id || CASE WHEN {K} % 2 = 0 THEN ':r2' ELSE '' END AS model,
  CASE WHEN {K} % 7 <> 0 THEN {RECORD_ALIAS} ELSE event_type || '-' || substr(sha256({RAW_CONFIG}), 1, 6) END AS alias,
  {K} % 11 = 0 AS is_aggregate, ts, {K} AS k,
  CASE WHEN {K} % 13 <> 0 THEN value / 1000 END AS primary_score,
  CASE WHEN {K} % 4 <> 0 THEN CAST({K} % 4 AS DOUBLE) ELSE 0.5 END AS bpb,
  CASE WHEN {K} % 3 = 0 THEN CAST(0.75 AS DOUBLE) ELSE 0.25 END AS pass_at_4,
  CASE WHEN {K} % 6 = 0 THEN CAST(0.875 AS DOUBLE) END AS pass_at_16
FROM events"""


@registered(
    "describe_records",
    f"""SELECT event_id, model, alias, is_aggregate, primary_score, bpb, pass_at_4, pass_at_16,
      CAST(CASE WHEN k % 6 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_extra FROM ({DESCRIBED}) AS r""",
)
def describe_records(spark, d):
    recs = exp.describe_records(records.accept(records.parse_records(b.event_lines(spark, d))))
    recs, m = metrics.with_metrics(recs), F.col("metrics")
    return recs.select(
        "event_id", "model", "alias", "is_aggregate",
        m["primary_score"].alias("primary_score"),
        metrics.bits_per_byte(m).alias("bpb"),
        metrics.pass_at(m, 4).alias("pass_at_4"),
        metrics.pass_at(m, 16).alias("pass_at_16"),
        F.size(m["extra_metrics"]).alias("n_extra"),
    )


DASHBOARD_CELLS = f"""
WITH d AS (SELECT * FROM ({DESCRIBED}) AS r WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'click')),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, alias
      ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS n FROM d) AS x WHERE n = 1 AND NOT is_aggregate),
  all_cells AS (SELECT model, alias AS task, primary_score AS score, 0 AS rank, ts, event_id FROM latest
    UNION ALL SELECT model, CASE WHEN contains(alias, ':rc') THEN replace(alias, ':rc', ':bpb')
        WHEN contains(alias, '::') THEN regexp_replace(alias, '(::.+)$', ':bpb\\1') ELSE alias || ':bpb' END,
      bpb, 1, ts, event_id FROM latest WHERE NOT contains(alias, ':mc')
    UNION ALL SELECT model, alias || ':pass_at_4', pass_at_4, 2, ts, event_id FROM latest
    UNION ALL SELECT model, alias || ':pass_at_16', pass_at_16, 3, ts, event_id FROM latest
      WHERE pass_at_16 IS NOT NULL)
SELECT model, task, score FROM (SELECT *, row_number() OVER (PARTITION BY model, task
  ORDER BY rank, ts DESC, CAST(event_id AS VARCHAR)) AS n FROM all_cells) AS x WHERE n = 1"""


@registered("dashboard_cells", DASHBOARD_CELLS)
def dashboard_cells(spark, d):
    recs = records.accept(records.parse_records(b.event_lines(spark, d)))
    return dashboard.dashboard_cells(b.event_experiments(spark, d), recs, "click")


@registered(
    "score_fixes",
    f"""SELECT event_id, CASE {K} % 4 WHEN 0 THEN 'minerva_math_' || event_type || '::zero_shot'
        WHEN 1 THEN 'alpaca_' || event_type || '::tulu' WHEN 2 THEN 'styled_math500_' || event_type || '::tulu'
        ELSE 'wildchat_masked_ppl' END AS alias,
      round(CASE {K} % 4 WHEN 0 THEN CASE WHEN {K} % 3 = 0 THEN 0.5 END WHEN 1 THEN value / 100
        WHEN 2 THEN CASE WHEN {K} % 3 = 0 THEN 0.5 END ELSE value END, 9) AS score,
      {K} % 2 = 0 AND {K} % 3 <> 0 AS fix_missing FROM events""",
)
def score_fixes(spark, d):
    k, kind = F.col("k"), F.col("event_type")
    alias = (
        F.when(k % 4 == 0, F.concat(F.lit("minerva_math_"), kind, F.lit("::zero_shot")))
        .when(k % 4 == 1, F.concat(F.lit("alpaca_"), kind, F.lit("::tulu")))
        .when(k % 4 == 2, F.concat(F.lit("styled_math500_"), kind, F.lit("::tulu")))
        .otherwise("wildchat_masked_ppl-67b0e9")
    )
    extra = F.when(k % 3 == 0, '"exact_match_flex":0.5').otherwise('"f1":0.25')
    text = F.concat(F.lit('{"primary_score":'), F.col("value").cast("string"), F.lit(","), extra, F.lit("}"))
    recs = metrics.with_metrics(
        b.events(spark, d).select("event_id", alias.alias("alias"), text.alias("metrics"))
    )
    own = metrics.ScoreRule(("minerva_math", "zero_shot"), "extra", "exact_match_flex")
    fixed = metrics.fix_scores(recs, [own, *metrics.SCORE_RULES])
    return _rounded(fixed.select("event_id", "alias", "score", "fix_missing"))


@registered(
    "skip_on_fail",
    "SELECT (SELECT count(*) FROM events) AS n_records, (SELECT count(*) FROM pages) AS n_dropped",
)
def skip_on_fail(spark, d):
    path = shared_dir(spark)
    broken = b.table(spark, d, "pages").select(F.concat(F.lit('{"url": "'), "url").alias("text"))
    b.event_lines(spark, d).select("text").unionByName(broken).write.text(path)
    return records.count_dropped(records.read_records(spark, path))


LANDED = f"SELECT r.*, CAST(floor(r.event_id / 20) AS BIGINT) AS experiment_id, r.event_id AS task_idx FROM ({EVENT_RECORDS}) AS r"
# experiments with a click or an error; evicting one takes all its records
CLICKED = f"(SELECT experiment_id FROM ({LANDED}) AS r WHERE task LIKE 'click%')"
FAILED = f"(SELECT experiment_id FROM ({LANDED}) AS r WHERE task_idx % 97 = 0)"


def _landing_source(spark, d):
    """A record per event; twenty events are one experiment, whose records arrive in several batches."""
    return b.event_records(spark, d).withColumns(
        {"experiment_id": F.floor(F.col("event_id") / 20), "task_idx": F.col("event_id"), "task_hash": F.lit(None).cast("string")}
    )


@registered(
    "landing",
    f"""SELECT experiment_id, task_idx, score, CASE WHEN task LIKE 'click%' OR task LIKE 'view%' THEN 0 ELSE 1 END AS batch
    FROM ({LANDED}) AS r""",
)
def landing_batches(spark, d):
    table, source = shared_dir(spark), _landing_source(spark, d)
    landing.land(spark, table, source.filter(F.col("task").rlike("^(click|view)")), 0)
    landing.land(spark, table, source, 1)
    return landing.landed(spark, table).select("experiment_id", "task_idx", "score", "batch")


@registered(
    "landing_force_and_evict",
    f"""SELECT experiment_id, task_idx, score + CASE WHEN task LIKE 'click%' THEN 1 ELSE 0 END AS score,
      CASE WHEN task LIKE 'click%' THEN 1 ELSE 0 END AS batch FROM ({LANDED}) AS r
    WHERE experiment_id NOT IN {FAILED} AND (task LIKE 'click%' OR experiment_id NOT IN {CLICKED})""",
)
def landing_force_and_evict(spark, d):
    table, source = shared_dir(spark), _landing_source(spark, d)
    landing.land(spark, table, source, 0)
    again = source.filter(F.col("task").startswith("click")).withColumn("score", F.col("score") + 1)
    landing.land(spark, table, again, 1, force=True)
    landing.evict(spark, table, source.filter(F.col("task_idx") % 97 == 0))
    return landing.landed(spark, table).select("experiment_id", "task_idx", "score", "batch")


@registered("landing_stream", f"SELECT experiment_id, task_idx, score FROM ({LANDED}) AS r")
def landing_stream(spark, d):
    base, source = shared_dir(spark), _landing_source(spark, d)
    inbox, table = f"{base}/inbox", f"{base}/table"
    clicks = F.col("task").startswith("click")
    for part in (source.filter(clicks), source):  # the second arrival brings the clicks again
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(source.schema).parquet(inbox)
        incremental.land_stream(stream, table, f"{base}/checkpoint").awaitTermination()
    return landing.landed(spark, table).select("experiment_id", "task_idx", "score")


@registered("newest_stream", EVENT_CELLS)
def newest_stream(spark, d):
    base, source = shared_dir(spark), b.event_records(spark, d)
    inbox, table = f"{base}/inbox", f"{base}/updates"
    late = F.col("event_id") % 2 == 0  # older and newer events arrive interleaved, in two runs
    for part in (source.filter(~late), source.filter(late)):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(source.schema).parquet(inbox)
        updates = incremental.newest_stream(
            stream, ["model", "task"], ["score"], [F.col("ts"), F.col("event_id")]
        )
        incremental.write_updates(updates, table, f"{base}/checkpoint").awaitTermination()
    return incremental.read_newest(spark, table, ["model", "task"]).select("model", "task", "score")


@registered("compacted_updates", EVENT_CELLS)
def compacted_updates(spark, d):
    base, source = shared_dir(spark), b.event_records(spark, d)
    inbox, table = f"{base}/inbox", f"{base}/updates"
    early = F.col("event_id") % 3 != 0
    for number, part in enumerate((source.filter(early), source.filter(~early))):  # each with a checkpoint of its own
        part.write.parquet(f"{inbox}/{number}")
        stream = spark.readStream.schema(source.schema).parquet(f"{inbox}/{number}")
        updates = incremental.newest_stream(
            stream, ["model", "task"], ["score"], [F.col("ts"), F.col("event_id")]
        )
        incremental.write_updates(updates, table, f"{base}/checkpoint{number}").awaitTermination()
        incremental.compact(spark, table, ["model", "task"])
    return spark.read.parquet(table).select("model", "task", "score")


# ---- names, paths, tags --------------------------------------------------------------------------


@registered(
    "metric_names",
    f"""WITH a AS (SELECT event_id, event_type || CASE {K} % 6 WHEN 0 THEN ':rc' WHEN 1 THEN ':rc::set'
        WHEN 2 THEN ':mc:v2' WHEN 3 THEN '::set:rcx' WHEN 4 THEN ':bpb::set' ELSE ':mcx' END AS alias FROM events)
    SELECT event_id, alias, CASE WHEN contains(alias, ':bpb') THEN NULL WHEN regexp_matches(alias, ':mc($|:)') THEN NULL
      WHEN regexp_matches(alias, ':rc($|:)') THEN regexp_replace(alias, ':rc($|:)', ':bpb\\1')
      WHEN regexp_matches(alias, '::.+$') THEN regexp_replace(alias, '(::.+)$', ':bpb\\1')
      ELSE alias || ':bpb' END AS bpb_name, alias || ':pass_at_4' AS pass_at_4_name FROM a""",
)
def metric_names(spark, d):
    k = F.col("k") % 6
    ends = {0: ":rc", 1: ":rc::set", 2: ":mc:v2", 3: "::set:rcx", 4: ":bpb::set"}
    end = F.coalesce(*(F.when(k == i, text) for i, text in ends.items()), F.lit(":mcx"))
    alias = F.col("alias")
    return b.events(spark, d).select(
        "event_id", F.concat("event_type", end).alias("alias")
    ).select(
        "event_id",
        "alias",
        names.bpb_name(alias).alias("bpb_name"),
        names.pass_at_name(alias, 4).alias("pass_at_4_name"),
    )


@registered(
    "eval_run_names",
    r"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/step' || page_id || '-hf/'
        WHEN 1 THEN url || '/' ELSE url END AS path FROM pages),
      x AS (SELECT *, rtrim(regexp_replace(regexp_replace(path, '^[A-Za-z]+://', ''), '[?#].*$', ''), '/') AS bare FROM p)
    SELECT page_id, CASE WHEN regexp_matches(path, '/step[0-9]+[^/]*/?$')
        THEN regexp_extract(bare, '([^/]*)/+[^/]*$', 1) || '_' || regexp_extract(bare, '([^/]*)$', 1)
        ELSE regexp_extract(bare, '([^/]*)$', 1) END || '_bos_s5_x' AS run_name FROM x""",
)
def eval_run_names(spark, d):
    step = F.concat("url", F.lit("/step"), F.col("page_id").cast("string"), F.lit("-hf/"))
    path = F.when(F.col("page_id") % 3 == 0, step).when(
        F.col("page_id") % 3 == 1, F.concat("url", F.lit("/"))
    ).otherwise(F.col("url"))
    return b.table(spark, d, "pages").select(
        "page_id", names.eval_run_name(path, bos=True, shots=5, suffix="x").alias("run_name")
    )


@registered(
    "run_paths",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'team/mix/' || page_id WHEN 1 THEN 'a/b/' || page_id
      ELSE 'run-' || page_id END AS run FROM pages""",
)
def run_paths(spark, d):
    i = F.col("page_id").cast("string")
    link = F.concat(F.lit(f"https://{names.RUN_HOST}/team/mix/runs/"), i, F.lit("/overview?tab=1"))
    text = F.when(F.col("page_id") % 3 == 0, link).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("/a/b/"), i, F.lit("/"))
    ).otherwise(F.concat(F.lit("run-"), i))
    return b.table(spark, d, "pages").select("page_id", names.run_path(text).alias("run"))


@registered(
    "storage_paths",
    r"""WITH n AS (SELECT page_id, url, ltrim(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/')
        AS norm FROM pages)
    SELECT page_id, norm, CASE WHEN contains(norm, '/') THEN regexp_replace(norm, '/[^/]*$', '') ELSE norm END AS base,
      regexp_replace(url, '/+[^/]*$', '') AS folder,
      CASE WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS label FROM n""",
)
def storage_paths(spark, d):
    normal = b.table(spark, d, "pages").withColumn("norm", paths.storage_path(F.col("url")))
    return normal.select(
        "page_id",
        "norm",
        paths.base_path(F.col("norm")).alias("base"),
        paths.folder(F.col("url")).alias("folder"),
        names.short_label(F.col("url")).alias("label"),
    )


@registered(
    "located_paths",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS rest FROM pages),
      q AS (SELECT page_id, regexp_replace(rest, '[?#].*$', '') AS bare, rest FROM p),
      x AS (SELECT page_id,
        CASE page_id % 5 WHEN 0 THEN 's3' WHEN 1 THEN 'gs' WHEN 2 THEN 'file' ELSE 'weka' END AS prot,
        CASE page_id % 5 WHEN 0 THEN bare WHEN 1 THEN bare WHEN 2 THEN '/' || rest
          ELSE '/shared-data/' || CASE WHEN page_id % 5 = 3 THEN bare ELSE rest END END AS path FROM q)
    SELECT page_id, prot, path, CASE WHEN prot <> 'file' THEN split_part(ltrim(path, '/'), '/', 1) END AS bucket,
      CASE WHEN prot <> 'file' THEN regexp_replace(ltrim(path, '/'), '^[^/]*/*', '') END AS prefix,
      CASE WHEN prot IN ('file', 'weka') THEN path END AS local,
      CASE WHEN prot <> 'file' THEN prot || '://' || ltrim(path, '/') END AS remote, md5(prot || path) AS hash FROM x""",
)
def located_paths(spark, d):
    rest = F.regexp_replace("url", "^https?://", "")
    i = F.col("page_id") % 5
    heads = {0: "s3n://", 1: "gcs://", 2: "/", 3: "weka://shared-data/"}
    head = F.coalesce(*(F.when(i == n, text) for n, text in heads.items()), F.lit("/weka/shared-data/"))
    listed = b.table(spark, d, "pages").select("page_id", F.concat(head, rest).alias("path"))
    return paths.with_location(listed, name="l", mounts=["shared-data"]).select(
        "page_id", "l.prot", "l.path", "l.bucket", "l.prefix", "l.local", "l.remote", "l.hash"
    )


@registered(
    "source_paths",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?', 's3')
      WHEN 1 THEN rtrim(regexp_replace(url, '^https?://', '/weka/'), '/')
      ELSE rtrim(regexp_replace(url, '^https?://', '/data/'), '/') END AS path FROM pages""",
)
def source_paths(spark, d):
    i = F.col("page_id") % 3
    head = F.when(i == 0, "s3://").when(i == 1, "weka://").otherwise("/data/")
    path = F.concat(head, F.regexp_replace("url", "^https?://", ""))
    return b.table(spark, d, "pages").select("page_id", paths.source_path(path).alias("path"))


@registered(
    "tags",
    f"""SELECT event_id, 'dashboard=' || event_type || ',flag,k=' || {K} AS text, CAST(3 AS INTEGER) AS n_tags,
      event_type = 'view' AS on_view, 'dashboard=' || event_type || ',flag' AS without_k FROM events""",
)
def tag_texts(spark, d):
    text = F.concat(
        F.lit(" dashboard="), "event_type", F.lit(",flag=flag,k="), F.col("k").cast("string"), F.lit("\n")
    )
    parsed = tags.parse_tags(text)
    return b.events(spark, d).select(
        "event_id",
        tags.render_tags(parsed).alias("text"),
        F.size(parsed).alias("n_tags"),
        tags.has_tag(parsed, "dashboard", "view").alias("on_view"),
        tags.render_tags(F.filter(parsed, lambda t: t["key"] != "k")).alias("without_k"),
    )


@registered(
    "percent_text",
    "SELECT event_id, printf('%.2f', floor(value) / 1000 * 100) AS percent FROM events",
)
def percent_text(spark, d):
    return b.events(spark, d).select(
        "event_id", display.percent_text(F.floor("value") / 1000).alias("percent")
    )


@registered(
    "flattened_settings",
    f"""SELECT CAST(event_id AS VARCHAR) AS config, 'props.k' AS key, CAST({K} AS VARCHAR) AS value FROM events
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'name', event_type FROM events
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'list', '[1, ' || {K} || ']' FROM events""",
)
def flattened_settings(spark, d):
    k = F.col("k").cast("string")
    text = F.concat(
        F.lit('{"name":"'), "event_type", F.lit('","props":'), "props",
        F.lit(',"none":{},"list":[1,'), k, F.lit("]}"),
    )
    configs = b.events(spark, d).select(
        F.col("event_id").cast("string").alias("config"), text.alias("text")
    )
    return manifests.flatten(configs)


# ---- manifests and configuration differences -----------------------------------------------------

PAGE_BASE = r"""SELECT split_part(url, ':', 1) AS config, CASE WHEN contains(norm, '/')
    THEN regexp_replace(norm, '/[^/]*$', '') ELSE norm END AS base_path
  FROM (SELECT url, ltrim(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/') AS norm
    FROM pages) AS x"""


@registered(
    "path_counts", f"SELECT config, base_path, count(*) AS n FROM ({PAGE_BASE}) AS p GROUP BY 1, 2"
)
def path_counts(spark, d):
    return manifest.path_counts(b.page_paths(spark, d))


@registered(
    "path_table",
    f"""WITH p AS ({PAGE_BASE}), w AS (SELECT base_path, nullif(count(*) FILTER (config = 'https'), 0) AS https,
        nullif(count(*) FILTER (config = 'http'), 0) AS http FROM p GROUP BY 1)
    SELECT base_path, https, http, https IS NULL OR http IS NULL OR https = http AS match FROM w
    UNION ALL SELECT 'Total', count(*) FILTER (config = 'https'), count(*) FILTER (config = 'http'), NULL FROM p""",
)
def path_table(spark, d):
    return manifest.path_table(manifest.path_counts(b.page_paths(spark, d)))


@registered(
    "path_matches",
    f"""WITH n AS (SELECT config, base_path, count(*) AS n FROM ({PAGE_BASE}) AS p GROUP BY 1, 2)
    SELECT base_path, count(*) AS n_configs, CAST(sum(n) AS BIGINT) AS total, min(n) = max(n) AS match
    FROM n GROUP BY 1""",
)
def path_matches(spark, d):
    return manifest.path_matches(manifest.path_counts(b.page_paths(spark, d)))


@registered(
    "folder_counts",
    """SELECT regexp_replace(url, '/+[^/]*$', '') AS folder, count(*) AS n,
      round(count(*) / (SELECT count(*) FROM pages), 9) AS share FROM pages GROUP BY 1""",
)
def folder_counts(spark, d):
    return _rounded(manifest.folder_counts(b.page_paths(spark, d)), "share")


@registered(
    "side_folder_counts",
    """SELECT split_part(url, ':', 1) AS side, regexp_replace(url, '/+[^/]*$', '') AS folder, count(*) AS n
    FROM pages GROUP BY 1, 2""",
)
def side_folder_counts(spark, d):
    listed = b.page_paths(spark, d).withColumnRenamed("config", "side")
    in_mixture = F.col("path").contains("?")  # pages with a query stand for files of a mixture source
    return manifest.side_folder_counts(listed.filter(~in_mixture), listed.filter(in_mixture))


@registered(
    "run_config_folders",
    """WITH p AS (SELECT 'data' AS side, url AS path FROM pages UNION ALL SELECT 'dataset', url || '/a' FROM pages
      UNION ALL SELECT 'dataset', url || '/b' FROM pages)
    SELECT side, regexp_replace(path, '/+[^/]*$', '') AS folder, count(*) AS n FROM p GROUP BY 1, 2""",
)
def run_config_folders(spark, d):
    url = F.col("url")
    text = F.concat(
        F.lit('{"lr": 0.1, "data": {"paths": ["'), url,
        F.lit('"]}, "dataset": {"paths": ["'), url,
        F.lit('/a"], "source_mixture_config": {"source_configs": [{"name": "x"}, {"paths": ["'), url,
        F.lit('/b"]}]}}}'),
    )
    configs = b.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("config"), text.alias("text")
    )
    listed = stage(manifests.run_config_paths(configs))
    side = F.when(F.col("origin") == "data", "data").otherwise("dataset").alias("side")
    plain = listed.filter("origin <> 'mixture'").select(side, "path")
    return manifest.side_folder_counts(plain, listed.filter("origin = 'mixture'").select(side, "path"))


@registered(
    "mix_list_scan",
    """SELECT 'mix' || (page_id % 2) AS config, url || '.npy' AS path FROM pages WHERE page_id % 5 NOT IN (3, 4)""",
)
def mix_list_scan(spark, d):
    i = F.col("page_id") % 5
    path = F.concat("url", F.lit(".npy"))
    line = (
        F.when(i == 0, F.concat(F.lit("  label,"), path, F.lit(",x ")))
        .when(i == 3, F.concat(F.lit("# "), path))
        .when(i == 4, F.concat(F.lit("label,"), F.col("url"), F.lit(".csv")))
        .otherwise(path)
    )
    lines = b.table(spark, d, "pages").select(
        F.concat(F.lit("mix"), (F.col("page_id") % 2).cast("string")).alias("config"), line.alias("line")
    )
    return manifests.parse_mix_lines(lines)


def _recipe_texts(spark, d):
    """A recipe per language: its sources with a target ratio and one path each, as YAML."""
    source = F.concat(
        F.lit("    - name: "), "source",
        F.lit("\n      target_ratio: 0.05\n      paths:\n        - s3://bucket/"), "source", F.lit("/*.npy\n"),
    )
    named = b.table(spark, d, "documents").select("lang", "source").distinct()
    body = F.array_join(F.array_sort(F.collect_list("text")), "")
    return named.select("lang", source.alias("text")).groupBy("lang").agg(body.alias("body")).select(
        F.col("lang").alias("config"), F.concat(F.lit("name: x\ndataset:\n  sources:\n"), "body").alias("text")
    )


@registered(
    "recipe_scan",
    """SELECT DISTINCT lang AS config, source, CAST(0.05 AS DOUBLE) AS target_ratio,
      CAST(1 AS DOUBLE) AS repetition_factor, CAST(1 AS DOUBLE) AS max_source_ratio, 's3://bucket/' || source || '/*.npy' AS path FROM documents""",
)
def recipe_scan(spark, d):
    return manifests.parse_recipes(_recipe_texts(spark, d))


@registered(
    "file_tokens",
    """SELECT source, CAST(sum(n_chars // 2) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_failed,
      round(sum(n_chars // 2) / (SELECT sum(n_chars // 2) FROM documents), 9) AS ratio FROM documents GROUP BY 1""",
)
def file_tokens(spark, d):
    """Files of their source, at any depth, whose lines hold the whole tokens of its documents; a task writes one per source.

    A document's rows have n_chars bytes, the line end at least. What two bytes leave over in a row makes a token with
    that of the document's next row. A line end by itself, no token, stands for the source.
    """
    path = shared_dir(spark)
    docs = b.table(spark, d, "documents").select("source", "doc_id", F.greatest(F.coalesce("n_chars", F.lit(1)), F.lit(1)).alias("n"))
    left = docs.groupBy("source", "doc_id").agg(F.sum(F.col("n") % 2).alias("n"))
    lines = docs.select("source", "n").unionByName(left.select("source", "n")).where("n > 1")
    # an even number of bytes, one of them the line end
    lines = lines.select("source", (F.col("n") - F.col("n") % 2 - 1).cast("int").alias("n"))
    rows = lines.unionByName(docs.select("source", F.lit(0).alias("n")).distinct())
    written = rows.select("source", F.spark_partition_id().alias("part"), F.repeat(F.lit("x"), F.col("n")).alias("value"))
    written.write.partitionBy("source", "part").text(path)
    names = [r["source"] for r in docs.select("source").distinct().collect()]
    files = manifests.source_files(spark, {name: [f"{path}/source={name}/**/*.txt"] for name in names})
    return _rounded(mixture.token_counts(files, "uint16").select("source", "tokens", "n_failed", "ratio"), "ratio")


@registered(
    "domain_weight_scan",
    """SELECT lang AS mix, source AS domain,
      round(sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang), 9) AS weight FROM documents GROUP BY 1, 2""",
)
def domain_weight_scan(spark, d):
    path = shared_dir(spark)
    weights = mixture.domain_weights(b.table(spark, d, "documents"), "lang", "source", "n_chars")
    weights.write.partitionBy("mix").json(path)
    read = manifests.read_domain_weights(spark, f"{path}/*", folder_per_mix=True)
    return _rounded(read.withColumn("mix", F.regexp_replace("mix", "^mix=", "")), "weight")


@registered(
    "domain_split",
    """SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, CAST(sum(doc_id) AS BIGINT) AS ids
    FROM documents GROUP BY 1""",
)
def domain_split(spark, d):
    path = shared_dir(spark)
    export.write_domains(b.table(spark, d, "documents"), "source", path)
    read = spark.read.parquet(path).groupBy("source")
    return read.agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.sum("doc_id").alias("ids"))


def _event_settings(spark, d):
    """Settings per k class: a key per user and event type, its value the largest k."""
    events = b.events(spark, d).select("user_id", "event_type", "k")
    return events.groupBy(
        F.concat(F.lit("c"), (F.col("k") % 2).cast("string")).alias("config"),
        F.concat_ws(".", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("key"),
    ).agg((F.floor(F.max("k") / 20)).cast("string").alias("value"))


SETTINGS = f"""SELECT 'c' || ({K} % 2) AS config, 'user.' || user_id || '.' || event_type AS key,
    CAST(max({K}) // 20 AS VARCHAR) AS value FROM events GROUP BY 1, 2"""


@registered(
    "settings_diff",
    f"""WITH s AS ({SETTINGS}), l AS (SELECT * FROM s WHERE config = 'c0'), r AS (SELECT * FROM s WHERE config = 'c1')
    SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'left only' WHEN l.key IS NULL THEN 'right only'
      ELSE 'changed' END AS status, l.value AS left_value, r.value AS right_value
    FROM l FULL JOIN r ON l.key = r.key WHERE l.value IS DISTINCT FROM r.value""",
)
def settings_diff(spark, d):
    settings = stage(_event_settings(spark, d))
    sides = [settings.filter(F.col("config") == c).select("key", "value") for c in ("c0", "c1")]
    return manifest.diff_two(*sides)


@registered(
    "many_settings_diff",
    f"""WITH s AS (SELECT event_type AS config, 'user.' || user_id AS key, CAST(max({K}) // 20 AS VARCHAR) AS value
        FROM events GROUP BY 1, 2),
      x AS (SELECT key FROM s GROUP BY 1
        HAVING count(DISTINCT value) > 1 OR count(*) < (SELECT count(DISTINCT config) FROM s))
    SELECT s.* FROM s WHERE key IN (SELECT key FROM x)""",
)
def many_settings_diff(spark, d):
    events = b.events(spark, d).select("user_id", "event_type", "k")
    settings = events.groupBy(
        F.col("event_type").alias("config"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"),
    ).agg(F.floor(F.max("k") / 20).cast("string").alias("value"))
    return manifest.diff_many(stage(settings))


# ---- data mixes ----------------------------------------------------------------------------------


@registered(
    "token_counts",
    """SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) AS n_files, CAST(0 AS BIGINT) AS n_failed,
      round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 9) AS ratio, 'uint32' AS dtype
    FROM documents GROUP BY 1""",
)
def token_counts(spark, d):
    return _rounded(mixture.token_counts(b.document_files(spark, d)), "ratio")


@registered(
    "token_counts_of_listed_files",
    """SELECT source, CAST(coalesce(sum(n_chars) FILTER (quality IS NOT NULL), 0) AS BIGINT) AS tokens,
      count(*) AS n_files, count(*) FILTER (quality IS NULL) AS n_failed
    FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY 1""",
)
def token_counts_of_listed_files(spark, d):
    documents = b.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    listed = documents.select(
        F.col("source").alias("name"), F.concat(F.lit("s3://b/x/"), F.col("doc_id").cast("string")).alias("path")
    )
    labelled = documents.join(b.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    found = labelled.select(
        F.concat(F.lit("s3a://b/x/"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("n_chars") * 4).alias("length"),
    )
    counts = mixture.token_counts(mixture.attach_sizes(listed, found))
    return counts.select("source", "tokens", "n_files", "n_failed")


def _document_sources(spark, d, every: int):
    """Sources of the documents; every ``every``-th by number has no target ratio or 0."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    named = b.table(spark, d, "documents").select("source").distinct()
    target = F.when(number % every == 0, F.lit(0.0)).otherwise(number / 100)
    return named.select(
        F.col("source").alias("name"), target.alias("target_ratio"), F.lit(1.5).alias("repetition_factor")
    )


RATIOS = """SELECT source AS name, CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 = 0
    THEN sum(n_chars) / (SELECT sum(n_chars) FROM documents)
    ELSE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) / 100 END AS ratio, 1.5 AS repetition_factor
  FROM documents GROUP BY source"""


@registered(
    "resolved_ratios",
    f"SELECT name, round(ratio, 9) AS ratio, CAST(repetition_factor AS DOUBLE) AS repetition_factor FROM ({RATIOS}) AS r",
)
def resolved_ratios(spark, d):
    sources = mixture.validate_sources(_document_sources(spark, d, 3))
    priors = mixture.token_counts(b.document_files(spark, d))
    return _rounded(mixture.resolve_ratios(sources, priors), "ratio")


@registered(
    "mix_plan",
    f"""SELECT name, 's3://bucket/' || lang || '/' || name || '.npy' AS path, true AS is_fractional,
      round(ratio, 9) AS ratio, CAST(1.5 AS DOUBLE) AS max_repetition_ratio, CAST(1000000 AS BIGINT) AS max_tokens,
      2048 AS sequence_length, 42 AS seed, 'uint32' AS dtype
    FROM ({RATIOS}) AS r JOIN (SELECT DISTINCT lang, source FROM documents) AS p ON p.source = r.name""",
)
def mix_plan(spark, d):
    ratios = mixture.resolve_ratios(
        _document_sources(spark, d, 3), mixture.token_counts(b.document_files(spark, d))
    )
    listed = b.table(spark, d, "documents").select("lang", "source").distinct()
    path = F.concat(F.lit("s3://bucket/"), "lang", F.lit("/"), "source", F.lit(".npy"))
    listed = listed.select(F.col("source").alias("name"), path.alias("path"))
    return _rounded(mixture.mix_plan(ratios, listed, 1_000_000, 2048), "ratio")


def _listed_files(spark, d):
    """A token file per source and language, four bytes per character."""
    path = F.concat(F.lit("s3a://bucket/"), "source", F.lit("/"), "lang", F.lit(".npy"))
    return b.table(spark, d, "documents").groupBy(path.alias("path")).agg((F.sum("n_chars") * 4).alias("length"))


PLAN_TAIL = """CAST(1 AS DOUBLE) AS max_repetition_ratio, CAST(5000 AS BIGINT) AS max_tokens, 1024 AS sequence_length,
      7 AS seed, 'uint32' AS dtype"""


@registered(
    "recipe_plan",
    f"""WITH p AS (SELECT DISTINCT source, lang FROM documents)
    SELECT c.lang AS config, c.source AS name, 's3://bucket/' || p.source || '/' || p.lang || '.npy' AS path,
      true AS is_fractional, CAST(0.05 AS DOUBLE) AS ratio, {PLAN_TAIL} FROM p AS c JOIN p USING (source)""",
)
def recipe_plan(spark, d):
    recipes = manifests.parse_recipes(_recipe_texts(spark, d))
    return mixes.recipe_plan(recipes, _listed_files(spark, d), 5000, 1024, seed=7)


@registered(
    "recipe_plan_many",
    f"""WITH p AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1),
      total AS (SELECT sum(n) AS n FROM n WHERE source IN (SELECT source FROM p WHERE lang = 'de'))
    SELECT c.lang AS config, c.source AS name, 's3://bucket/' || p.source || '/' || p.lang || '.npy' AS path,
      true AS is_fractional, round(CASE WHEN c.lang = 'de' THEN n.n / (SELECT n FROM total) ELSE ascii(c.lang) / 1000 END, 9) AS ratio,
      {PLAN_TAIL} FROM p AS c JOIN p ON p.source = c.source JOIN n ON n.source = c.source""",
)
def recipe_plan_many(spark, d):
    """The same source names in every recipe, each with a ratio of its own; one recipe uses the natural ones."""
    recipes = manifests.parse_recipes(_recipe_texts(spark, d))
    target = F.when(F.col("config") == "de", F.lit(0.0)).otherwise(F.ascii("config") / 1000)
    plan = mixes.recipe_plan(recipes.withColumn("target_ratio", target), _listed_files(spark, d), 5000, 1024, seed=7)
    return _rounded(plan, "ratio")


@registered(
    "source_schemes",
    """SELECT split_part(split_part(url, '://', 2), '/', 1) || ':' || split_part(url, ':', 1) AS name,
      count(*) AS n_paths, split_part(url, ':', 1) AS scheme FROM pages GROUP BY 1, 3""",
)
def source_schemes(spark, d):
    scheme = F.split("url", ":")[0]
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return mixture.validate_schemes(
        b.table(spark, d, "pages").select(F.concat_ws(":", host, scheme).alias("name"), F.col("url").alias("path"))
    )


@registered(
    "weight_comparison",
    """WITH w AS (SELECT lang, source AS domain, sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang) AS weight
      FROM documents GROUP BY 1, 2)
    SELECT domain, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 9) AS "natural",
      round(max((SELECT avg(weight) FROM w WHERE w.domain = d.domain)), 9) AS target
    FROM (SELECT source AS domain, n_chars FROM documents) AS d GROUP BY 1""",
)
def weight_comparison(spark, d):
    documents = b.table(spark, d, "documents")
    natural = mixture.token_counts(b.document_files(spark, d)).select(
        F.col("source").alias("domain"), F.col("ratio").alias("weight")
    )
    by_language = mixture.domain_weights(documents, "lang", "source", "n_chars")
    target = by_language.groupBy("domain").agg(F.avg("weight").alias("weight"))
    return _rounded(mixture.compare_weights(natural, target), "natural", "target")


# ---- documents for training ----------------------------------------------------------------------

GRAMS = r"""
WITH t AS (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM {table}),
s AS (SELECT *, unnest(range(1, CAST(len(w) AS INTEGER) - 11)) AS i FROM t)
SELECT DISTINCT {id}, array_to_string(w[i:i + 12], ' ') AS gram FROM s"""
HITS = f"""
WITH d AS ({GRAMS.format(id="doc_id", table="documents")}), b AS ({GRAMS.format(id="item_id", table="benchmark")}),
  n AS (SELECT item_id, count(*) AS item_grams FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS hits, max(item_grams) AS item_grams, count(*) / max(item_grams) AS ratio
FROM d JOIN b USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id"""


@registered("contamination", HITS)
def contaminated_pairs(spark, d):
    return contamination.contamination(b.table(spark, d, "documents"), b.table(spark, d, "benchmark"))


@registered("decontaminate", f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({HITS}) AS h)")
def decontaminated(spark, d):
    return contamination.decontaminate(b.table(spark, d, "documents"), b.table(spark, d, "benchmark"))


@registered("decontaminate_half", f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({HITS}) AS h WHERE ratio > 0.5)")
def decontaminated_half(spark, d):
    """Only documents that hold more than half of an item go."""
    return contamination.decontaminate(b.table(spark, d, "documents"), b.table(spark, d, "benchmark"), least=0.5)


LAID = """SELECT doc_id, text, coalesce(n_chars, 0) AS size,
  CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents"""


@registered("size_shards", f'SELECT doc_id, size, start, start // 100000 AS shard FROM ({LAID}) AS l')
def size_shards(spark, d):
    laid = sequences.lay_out(b.table(spark, d, "documents"), F.col("n_chars"))
    return sequences.shards(laid, 100_000).select("doc_id", "size", "start", "shard")


PIECES = f"""
WITH l AS ({LAID}), s AS (SELECT *, unnest(range(start // 2048, (start + size - 1) // 2048 + 1)) AS sequence FROM l WHERE size > 0)
SELECT sequence, greatest(start, sequence * 2048) - sequence * 2048 AS at, doc_id, greatest(start, sequence * 2048) - start AS "begin",
  least(start + size, (sequence + 1) * 2048) - greatest(start, sequence * 2048) AS size FROM s"""


@registered("sequence_pieces", PIECES)
def sequence_pieces(spark, d):
    """Which part of which document lies where in sequences of 2,048, the short one at the end included."""
    laid = stage(sequences.lay_out(b.table(spark, d, "documents"), F.col("n_chars")))
    return sequences.pieces(laid, 2048, tail=True).drop("key", "copy")


@registered(
    "packed_sequences",
    """WITH whole AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents),
    s AS (SELECT t, unnest(range(0, length(t) // 2048)) AS sequence FROM whole)
    SELECT sequence, md5(substring(t, sequence * 2048 + 1, 2048)) AS value FROM s""",
)
def packed_sequences(spark, d):
    packed = sequences.pack(b.table(spark, d, "documents"), "text", 2048)
    return packed.select("sequence", F.md5("value").alias("value"))


@registered(
    "padded_documents",
    r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'), lambda x: unicode(x)) AS w FROM documents)
    SELECT doc_id, array_to_string(list_resize(w[1:256], 256, 0), ',') AS ids, CAST(least(len(w), 256) AS INTEGER) AS n FROM w""",
)
def padded_documents(spark, d):
    """First code points of tokens as ids, one row of 256 per document."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"), F.lit(0))
    ids = b.table(spark, d, "documents").select("doc_id", F.transform(found, F.ascii).alias("w"))
    padded = sequences.pad(F.col("w"), 256, F.lit(0))
    return ids.select("doc_id", F.array_join(padded, ",").alias("ids"), F.least(F.size("w"), F.lit(256)).alias("n"))


@registered(
    "token_shards",
    r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'), lambda x: unicode(x)) AS w FROM documents)
    SELECT doc_id, len(w) AS n, coalesce(CAST(list_sum(w) AS BIGINT), 0) AS total, md5(array_to_string(w[1:50], ',')) AS head FROM w""",
)
def written_token_shards(spark, d):
    """Tokens of all documents written as shards in the order of ids, and read back."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"), F.lit(0))
    tokens = b.table(spark, d, "documents").select("doc_id", F.transform(found, F.ascii).alias("tokens"))
    path = shared_dir(spark)
    token_shards.write(tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path, 100_000)
    back = token_shards.read(spark, path)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    head = F.md5(F.array_join(F.slice("tokens", 1, 50), ","))
    return back.select("doc_id", F.size("tokens").cast("long").alias("n"), total.alias("total"), head.alias("head"))


RULES = (
    ("empty", "text IS NULL OR text = ''"),
    ("short", "n_chars < 200"),
    ("long", "n_chars > 20000"),
    ("no sentence", r"NOT text LIKE '%.%'"),
    ("shouting", "length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) * 10 < length(text) * 9"),
    ("symbols", "length(translate(text, '#{}<>|*', '')) * 50 < length(text) * 49"),
)
REASONS = "SELECT doc_id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULES) + " END AS reason FROM documents"


@registered("rule_reasons", REASONS)
def rule_reasons(spark, d):
    return quality.with_reason(b.table(spark, d, "documents"), RULES).select("doc_id", "reason")


@registered("rule_counts", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({REASONS}) AS r GROUP BY 1")
def rule_counts(spark, d):
    """Counted while the rows are written: the documents are read once."""
    rows, watch = quality.counted(quality.with_reason(b.table(spark, d, "documents"), RULES), RULES)
    stage(rows.where("reason IS NULL").drop("reason"))
    return local_table(spark, [(k, n) for k, n in watch.get.items() if n], "reason string, n long")


@registered(
    "best_share",
    """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r,
      count(*) OVER (PARTITION BY source) AS n FROM documents) AS x WHERE r <= ceil(n * 0.3)""",
)
def best_share(spark, d):
    """The 30 percent of every source with the longest documents."""
    docs = b.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return quality.best_share(docs, 0.3, score="n_chars")


@registered(
    "best_labelled",
    """SELECT doc_id, quality FROM (SELECT d.doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY quality DESC, d.doc_id) AS r,
      count(*) OVER (PARTITION BY source) AS n FROM documents AS d JOIN labels USING (doc_id) WHERE quality IS NOT NULL) AS x
    WHERE r <= ceil(n * 0.5)""",
)
def best_labelled(spark, d):
    """The better half of every source by a score of two values, so that nearly all are ties."""
    docs = b.table(spark, d, "documents").select("doc_id", "source").join(b.table(spark, d, "labels"), "doc_id")
    return quality.best_share(docs, 0.5, score="quality").select("doc_id", "quality")


@registered(
    "exact_copies",
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents",
)
def exact_copies(spark, d):
    return quality.exact_copies(b.table(spark, d, "documents"))


# ---- sinks ---------------------------------------------------------------------------------------


@registered("json_cells", NULL_CELLS)
def json_cells(spark, d):
    path = shared_dir(spark)
    export.write_cells(b.nullable_cells(spark, d), path)
    return spark.read.schema(cell_ops.CELL_TYPE).json(path)


@registered(
    "json_document",
    f"""WITH c AS ({NULL_CELLS}), e AS (SELECT *, row_number() OVER (ORDER BY task, model) AS n,
        row_number() OVER (PARTITION BY task ORDER BY model) AS i,
        count(*) OVER (PARTITION BY task) AS z, count(*) OVER () AS total FROM c)
    SELECT task, model, CASE WHEN n = 1 THEN '{{' ELSE '' END || CASE WHEN i = 1 THEN '"' || task || '": {{' ELSE '' END
      || '"' || model || '": ' || CASE WHEN score IS NULL THEN 'null' ELSE 'number' END
      || CASE WHEN n = total THEN '}}}}' WHEN i = z THEN '}},' ELSE ',' END AS line FROM e""",
)
def json_document(spark, d):
    lines = export.json_lines(stage(b.nullable_cells(spark, d)))
    # engines print doubles differently, so the check looks at everything but the digits
    return lines.withColumn("line", F.regexp_replace("line", r'(": )[0-9.E\-]+', "$1number"))


@registered(
    "csv_table",
    f"""WITH c AS ({EVENT_CELLS}) SELECT model AS name,
      coalesce(printf('%.1f', max(CASE WHEN task = 'click:0' THEN floor(score * 1000) / 1000 * 100 END)) || '0', '-') AS "click:0",
      coalesce(printf('%.1f', max(CASE WHEN task = 'view:1' THEN floor(score * 1000) / 1000 * 100 END)) || '0', '-') AS "view:1"
    FROM c GROUP BY 1""",
)
def csv_table(spark, d):
    path = shared_dir(spark)
    cells = b.event_cells(spark, d)
    cells = cells.withColumn("score", F.floor(F.col("score") * 1000) / 1000)
    export.write_csv(export.wide(cells, ["click:0", "view:1"]), path)
    return spark.read.schema("name string, `click:0` string, `view:1` string").csv(path, header=True)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns or ("score",)})
