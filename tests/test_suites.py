import random
import statistics

import pytest
from pyspark.sql import functions as F

from scoremill.functions.patterns import compile_filters
from scoremill.operators import cells as ops
from scoremill.operators import coverage, suites
from scoremill.plans import dashboard
from scoremill.session import local_table


def as_dict(cells):
    rows = cells.collect()
    found = {(r["model"], r["task"]): r["score"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def book():
    book = suites.SuiteBook()
    book.register_suite("math", "AVG", ["m1", "m2"])
    book.register_suite("code", "AVG", ["c1", "c2", "c3"])
    book.register_suite("all", "AOA", ["math", "code", "qa"])
    book.register_suite("deep", "AOA", ["all", "math"])
    book.register_suite("board", "VIEW", ["all", "m1"])
    book.register_suite("outer", "VIEW", ["board", "math"])
    book.register_suite("extras", "LIST", ["x1", "x2"])
    return book


@pytest.fixture(scope="module")
def cells(spark):
    triples = [("full", t, s) for t, s in zip(("m1", "m2", "c1", "c2", "c3", "qa", "x1"), (0.1, 0.3, 0.2, 0.4, 0.9, 0.5, 0.7))]
    triples += [("part", "m1", 0.4), ("part", "m2", None), ("part", "c1", 0.2), ("idle", "x1", 0.6)]
    return ops.make_cells(spark.range(1), triples)


def test_strict_average(cells, book):
    found = as_dict(suites.combine(cells, book, "math"))
    assert set(found) == {(m, t) for m in ("full", "part", "idle") for t in ("m1", "m2", "math")}
    assert found[("full", "math")] == pytest.approx(0.2)
    assert found[("part", "math")] is None and found[("part", "m1")] == 0.4
    assert found[("idle", "math")] is None


def test_average_of_averages(cells, book):
    found = as_dict(suites.combine(cells, book, "all"))
    assert {t for _, t in found} == {"math", "code", "qa", "all"}
    assert found[("full", "code")] == pytest.approx(0.5)
    assert found[("full", "all")] == pytest.approx((0.2 + 0.5 + 0.5) / 3)
    assert found[("part", "all")] is None
    deep = as_dict(suites.combine(cells, book, "deep"))
    assert deep[("full", "deep")] == pytest.approx((0.4 + 0.2) / 2)


def test_views(cells, book):
    view = as_dict(suites.combine(cells, book, "board"))
    assert {t for _, t in view} == {"all", "m1"}
    outer = as_dict(suites.combine(cells, book, "outer"))
    assert outer[("full", "board")] is None and outer[("full", "math")] == pytest.approx(0.2)
    counted = as_dict(suites.combine(cells, book, "outer", view_in_view_is_null=False))
    assert counted[("full", "board")] == pytest.approx((0.4 + 0.1) / 2)


def test_lists_do_not_combine(cells, book):
    assert suites.combine(cells, book, "extras") is None
    wrong = suites.SuiteBook()
    wrong.register_suite("list", "LIST", ["a"])
    wrong.register_suite("bad", "AOA", ["list"])
    with pytest.raises(TypeError):
        wrong.own_weights("bad")


def test_registry(book):
    assert book.names()[0] == "math" and book.exists("code") and not book.exists("nope")
    assert book.search(compile_filters(["^(ma|co)."])[0]) == ["math", "code"]
    with pytest.raises(ValueError):
        book.get("nope")
    with pytest.raises(ValueError):
        book.register_suite("x", "SUM", [])
    assert book.expand(["math", "plain", "all"]) == ["c1", "c2", "c3", "m1", "m2", "plain", "qa"]


def test_closure_of_an_edge_table_equals_the_book(spark, book):
    found = suites.leaf_closure(book.edges(spark)).collect()
    assert sorted((r["suite"], r["task"]) for r in found) == sorted(
        (name, leaf) for name in book.names() for leaf in book.leaves(name)
    )


def test_random_books_match_a_walk(spark):
    """Weighted scoring equals combining children bottom up, nulls included."""
    random.seed(5)
    tasks = [f"t{i}" for i in range(8)]
    book = suites.SuiteBook()
    for i in range(6):
        book.register_suite(f"a{i}", "AVG", random.sample(tasks, random.randint(1, 4)))
    for i in range(5):
        children = random.sample(book.names() + tasks, random.randint(1, 4))
        book.register_suite(f"o{i}", "AOA", children)
    table = {(f"r{m}", t): random.random() for m in range(6) for t in tasks if random.random() < 0.85}

    def walk(name, model):
        if name not in book.suites:
            return table.get((model, name))
        children = list(dict.fromkeys(book.get(name).children))
        scores = [walk(c, model) for c in children]
        return None if None in scores else statistics.fmean(scores)

    cells = ops.make_cells(spark.range(1), [(m, t, s) for (m, t), s in table.items()])
    found = {(r["model"], r["suite"]): r["score"] for r in suites.suite_scores(cells, book).collect()}
    assert len(found) == len({m for m, _ in table}) * len(book.names())
    for (model, name), score in found.items():
        expected = walk(name, model)
        assert score == (None if expected is None else pytest.approx(expected))


def test_dashboard(cells, book):
    tasks = ["all", "extras", "^c[12]$", "board"]
    found = as_dict(dashboard.results(cells, tasks, book))
    assert found[("full", "all")] == pytest.approx(0.4)
    assert found[("part", "all")] is None and ("idle", "all") in found
    assert ("part", "x1") not in found and found[("idle", "x1")] == 0.6  # single tasks stay sparse
    assert ("part", "c2") not in found and found[("part", "c1")] == 0.2
    columns = dashboard.result_columns(cells, tasks, book)
    assert columns == ["all", "m1", "math", "code", "qa", "c1", "c2", "x1"]
    assert {t for _, t in found} == set(columns)


def test_dashboard_keeps_a_stored_null_and_filters_models(spark, book):
    cells = ops.make_cells(spark.range(1), [("a-1", "m1", None), ("a-1", "m2", 0.2), ("b", "m1", 0.5)])
    found = as_dict(dashboard.results(cells, ["math", "m1"], book, ["a-1"]))
    assert found == {("a-1", "m1"): None, ("a-1", "m2"): 0.2, ("a-1", "math"): None}


def test_custom_kind(cells, book):
    def lowest(cells, book, name):
        return ops.keep_columns(cells, book.leaves(name)).groupBy("model").agg(
            F.min("score").alias("score")
        ).select("model", F.lit(name).alias("task"), "score")

    mine = suites.SuiteBook(dict(book.suites))
    mine.register_kind("MIN", lowest)
    mine.register_suite("worst", "MIN", ["m1", "m2"])
    found = as_dict(dashboard.results(cells, ["worst", "qa"], mine))
    assert found == {("full", "worst"): 0.1, ("part", "worst"): 0.4, ("full", "qa"): 0.5}
    assert dashboard.result_columns(cells, ["worst", "qa"], mine) == ["worst", "qa"]


def test_missing(cells, book):
    results = dashboard.results(cells, ["all"], book)
    columns = dashboard.result_columns(cells, ["all"], book)
    gaps = coverage.missing_tasks(results, columns, book).filter("model = 'part'")
    assert {(r["column"], r["task"]) for r in gaps.collect()} == {
        *(("all", t) for t in ("m1", "m2", "c1", "c2", "c3", "qa")),
        *(("math", t) for t in ("m1", "m2")),
        *(("code", t) for t in ("c1", "c2", "c3")),
        ("qa", "qa"),
    }
    both = ops.overlay(results, cells)
    leaves = coverage.missing_tasks(both, columns, book, scope="leaf").filter("model = 'part'")
    assert {r["task"] for r in leaves.collect()} == {"m2", "c2", "c3", "qa"}
    report = coverage.missing_report(gaps, ["math", "q.*"], book).collect()
    assert [(r["model"], r["n_missing"], r["tasks"]) for r in report] == [("part", 3, ["m1", "m2", "qa"])]
    assert coverage.missing_report(gaps, ["math"], book, ["other"]).count() == 0


def test_work_list(spark):
    names = ["a:rc::s", "b:mc::s", "fim_x", "g1", "g2", "g3", "g1", "y:pass_at_4", "exam_z:bpb::set", "cloze:bpb"]
    missing = local_table(spark, [("m", n) for n in names], "model string, task string")
    skipped = (*coverage.NOT_LAUNCHED, r"^exam_.*:bpb::set$", r"^cloze:bpb$")
    found = {(r["launch_class"], r["chunk"], r["task"]) for r in coverage.work_list(missing, 2, skipped).collect()}
    assert found == {
        ("rc", 0, "a:rc::s"),
        ("mc", 0, "b:mc::s"),
        ("fim", 0, "fim_x"),
        ("gen", 0, "g1"),
        ("gen", 0, "g2"),
        ("gen", 1, "g3"),
    }
    assert {r["chunk"] for r in coverage.work_list(missing).collect()} == {0}


def test_list_suites(spark, book):
    closure = suites.leaf_closure(book.edges(spark))
    whole = coverage.list_suites(closure, [])
    assert whole.count() == closure.count()
    found = {}
    for r in coverage.list_suites(closure, compile_filters(["code", "m.$", "m1"])).collect():
        found.setdefault((r["suite"], r["matched"], r["total"]), set()).add(r["task"])
    assert found[("code", 3, 3)] == {"c1", "c2", "c3"}
    assert found[("all", 2, 6)] == {"m1", "m2"}
    assert not any(suite == "extras" for suite, _, _ in found)


def test_edge_tables_score_like_the_book(spark, cells, book):
    edges = book.edges(spark)
    found = {(r["model"], r["suite"]): r["score"] for r in suites.score_weights(cells, suites.suite_weights(edges)).collect()}
    expected = {(r["model"], r["suite"]): r["score"] for r in suites.suite_scores(cells, book).collect()}
    assert set(found) == set(expected) and len(found) == 12
    for key, score in expected.items():
        assert found[key] == (None if score is None else pytest.approx(score))


def test_book_from_edges(spark, book):
    edges = book.edges(spark)
    assert suites.book_from_edges(edges, book.names()).suites == book.suites
    nested = suites.book_from_edges(edges, ["all"]).suites
    assert nested["all"] == book.suites["all"] and set(nested) < set(book.suites)


def test_cycles_are_refused_and_depth_is_free(spark, cells):
    links = [(f"s{i}", "AOA", 0, f"s{i + 1}", True) for i in range(70)] + [("s70", "AVG", 0, "m1", False)]
    deep = local_table(spark, links, "suite string, kind string, ord int, child string, child_is_suite boolean")
    assert suites.leaf_closure(deep.filter("suite >= 's66'")).count() == 5
    loop = deep.unionByName(local_table(spark, [("s70", "AOA", 1, "s68", True)], "suite string, kind string, ord int, child string, child_is_suite boolean"))
    with pytest.raises(ValueError, match="cycle"):
        suites.leaf_closure(loop.filter("suite >= 's66'"))


def test_edge_tables_with_views_and_lists(spark, cells):
    book = suites.SuiteBook()
    book.register_suite("view", "VIEW", ["m1"])
    book.register_suite("over", "AOA", ["view", "m1"])
    weights = suites.suite_weights(book.edges(spark))
    assert {r["score"] for r in suites.score_weights(cells, weights).collect()} == {None}
    assert book.own_weights("over") is None
    book.register_suite("list", "LIST", ["m1"])
    book.register_suite("bad", "AOA", ["list"])
    with pytest.raises(Exception, match="list is a list"):
        suites.suite_weights(book.edges(spark)).collect()


def test_report(cells, book):
    table = dashboard.report(cells, ["all"], book)
    assert table.columns == ["model", "math", "code", "qa", "all"]
    assert table.first()["model"] == "full"
    assert [r["model"] for r in dashboard.report(cells, ["all"], book, ascending=True).collect()][-1] == "full"
    assert dashboard.report(cells, ["nothing"], book).count() == 0


def test_report_of_some_models_has_their_columns_only(spark, book):
    cells = local_table(spark, [("a", "x", 0.5), ("b", "y", 0.7)], "model string, task string, score double")
    assert dashboard.report(cells, ["x", "y"], book, models=["a"]).columns == ["model", "x"]


def test_scoring_reads_the_cells_once(spark, tmp_path, cells, book):
    path = str(tmp_path / "cells")
    cells.write.parquet(path)
    plan = dashboard.results(spark.read.parquet(path), ["all", "extras", "m1"], book)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text
