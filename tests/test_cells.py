import re

import pytest

from scoremill.functions.patterns import compile_filter, matches_any
from scoremill.operators import cells as ops
from scoremill.operators import ordering
from scoremill.session import local_table


@pytest.fixture(scope="module")
def sample(spark):
    return ops.make_cells(
        spark.range(1),
        [
            ("model1", "metric1", 0.75),
            ("model1", "metric2", 0.80),
            ("model2", "metric1", 0.65),
            ("model2", "metric2", 0.90),
            ("model3", "metric1", 0.85),
            ("model3", "metric2", None),
        ],
    )


@pytest.fixture(scope="module")
def sparse(spark):
    """Three models, three metrics, one score each, all nine cells stored."""
    scores = {("model1", "metric2"): 0.8, ("model2", "metric3"): 0.7, ("model3", "metric1"): 0.85}
    triples = [
        (f"model{m}", f"metric{t}", scores.get((f"model{m}", f"metric{t}")))
        for m in (1, 2, 3)
        for t in (1, 2, 3)
    ]
    return ops.make_cells(spark.range(1), triples)


def as_dict(cells):
    rows = cells.collect()
    found = {(r["model"], r["task"]): r["score"] for r in rows}
    assert len(found) == len(rows)
    return found


def models(cells, task):
    return [r["model"] for r in cells.collect() if r["task"] == task]


def test_shape_counts_stored_cells(spark, sample):
    assert tuple(ops.shape(sample).first()) == (2, 3)
    uneven = ops.make_cells(spark.range(1), [("r1", "c1", 1), ("r2", "c1", 2), ("r3", "c1", 3), ("r1", "c2", 1)])
    assert tuple(ops.shape(uneven).first()) == (2, 3)
    assert tuple(ops.shape(sample.limit(0)).first()) == (0, 0)


def test_get_and_contains(sample):
    assert ops.get(sample, "metric1", "model2") == 0.65
    assert ops.get(sample, "metric2", "model3") is None
    assert ops.get(sample, "metric2", "nobody") is None
    with pytest.raises(KeyError):
        ops.get(sample, "nothing", "model1")
    assert ops.has_column(sample, "metric1") and not ops.has_column(sample, "metric9")


def test_put_overwrites_with_null_and_without(sample):
    nulled = ops.put(sample, ("model1", "metric1", 0.7), ("model1", "metric1", None))
    assert ("model1", "metric1") in as_dict(nulled) and as_dict(nulled)[("model1", "metric1")] is None
    kept = ops.put(sample, ("model1", "metric1", 0.1), ("model3", "metric2", 0.2), overwrite=False)
    assert as_dict(kept)[("model1", "metric1")] == 0.75
    assert as_dict(kept)[("model3", "metric2")] == 0.2


@pytest.mark.parametrize("ascending, expected", [(True, ["model2", "model1", "model3"]), (False, ["model3", "model1", "model2"])])
def test_sort_by_column(sample, ascending, expected):
    assert models(ordering.sort_rows(sample, "column", "metric1", ascending), "metric1") == expected


def test_sort_puts_null_and_zero_first(spark, sample):
    assert models(ordering.sort_rows(sample, "column", "metric2"), "metric2")[0] == "model3"
    zero = ops.make_cells(spark.range(1), [("a", "t", -1.0), ("b", "t", 0.0), ("c", "t", 1.0)])
    assert models(ordering.sort_rows(zero, "column", "t"), "t") == ["b", "a", "c"]


def test_sort_by_average_counts_null_as_zero(sample):
    means = {r["model"]: round(r["mean"], 6) for r in ordering.row_means(sample).collect()}
    assert means == {"model1": 0.775, "model2": 0.775, "model3": 0.425}
    assert models(ordering.sort_rows(sample, "average"), "metric1") == ["model3", "model1", "model2"]
    assert models(ordering.sort_rows(sample, "name", ascending=False), "metric1") == ["model3", "model2", "model1"]


def test_sort_rejects_bad_criteria(sample):
    for arguments in (("column", None), ("column", "nothing"), ("average", "metric1"), ("size", None)):
        with pytest.raises(ValueError):
            ordering.sort_rows(sample, *arguments)


def test_keep_and_drop(sample):
    assert len(as_dict(ops.keep_columns(sample, ["metric1"]))) == 3
    assert len(as_dict(ops.drop_columns(sample, [re.compile(r"metric\d")]))) == 0
    assert set(as_dict(ops.keep_rows(sample, [re.compile(r"model[12]")]))) == {
        (f"model{m}", f"metric{t}") for m in (1, 2) for t in (1, 2)
    }
    assert ops.keep_columns(sample, []).count() == 0
    assert ops.drop_columns(sample, []).count() == 6
    assert len(as_dict(ops.drop_rows(sample, ["model1"]))) == 4


def test_filters_must_be_text_or_pattern():
    with pytest.raises(ValueError):
        matches_any("task", [3])


def test_text_is_a_pattern_when_escaping_changes_it():
    for text in ("mmlu:mc", "x::pass@1", "abc"):
        assert compile_filter(text) == text
    for text in ("gen-no-jp", "humaneval:temp0.8", "two words"):
        assert isinstance(compile_filter(text), re.Pattern)


def test_pattern_flags_carry_over(sample):
    assert ops.keep_columns(sample, [re.compile("METRIC1", re.IGNORECASE)]).count() == 3


def test_drop_empty(sample, sparse, spark):
    assert set(t for _, t in as_dict(ops.drop_empty(sample))) == {"metric1"}
    assert ops.drop_empty(sparse).count() == 0
    absent = ops.make_cells(spark.range(1), [("a", "t1", 0.1), ("b", "t1", 0.2), ("a", "t2", 0.3)])
    assert ops.drop_empty(absent).count() == 3  # an absent cell is no stored null


def test_overlay(spark):
    left = ops.make_cells(spark.range(1), [("r1", "c1", 0.1), ("r2", "c1", 0.2)])
    right = ops.make_cells(spark.range(1), [("r1", "c2", 0.3), ("r3", "c2", 0.4), ("r2", "c1", None)])
    assert as_dict(ops.overlay(left, right)) == {
        ("r1", "c1"): 0.1,
        ("r2", "c1"): None,
        ("r1", "c2"): 0.3,
        ("r3", "c2"): 0.4,
    }


def test_overlay_is_associative_and_folds(spark):
    a = ops.make_cells(spark.range(1), [("r", "c", 1.0), ("r", "d", 1.0), ("s", "c", None)])
    b = ops.make_cells(spark.range(1), [("r", "c", None), ("s", "c", 2.0)])
    c = ops.make_cells(spark.range(1), [("r", "d", 3.0), ("t", "e", 3.0)])
    expected = as_dict(ops.overlay(ops.overlay(a, b), c))
    assert as_dict(ops.overlay(a, ops.overlay(b, c))) == expected
    assert as_dict(ops.overlay_all(a, b, c)) == expected


def test_densify_and_missing(sparse, spark):
    some = sparse.filter("score is not null")
    dense = as_dict(ops.densify(some, ["metric1", "metric2", "metric9"]))
    assert len(dense) == 9 and dense[("model3", "metric1")] == 0.85
    assert sum(v is not None for v in dense.values()) == 2
    for columns in (None, ["metric1", "metric2", "metric3"]):
        missing = {r["model"]: r["missing"] for r in ops.missing_per_row(some, columns).collect()}
        assert missing == {
            "model1": ["metric1", "metric3"],
            "model2": ["metric1", "metric2"],
            "model3": ["metric2", "metric3"],
        }


def test_pattern_table_keeps_a_cell_once(spark, sample):
    patterns = local_table(spark, [("metric.",), ("1$",), ("nothing",)], "pattern string")
    assert len(as_dict(ops.keep_matching_tasks(sample, patterns))) == 6
    only = local_table(spark, [("^metric1$",)], "pattern string")
    assert {t for _, t in as_dict(ops.keep_matching_tasks(sample, only))} == {"metric1"}


def test_column_sets(spark):
    left = ops.make_cells(spark.range(1), [("r", "a", 1.0), ("r", "b", 1.0)])
    right = ops.make_cells(spark.range(1), [("r", "b", 2.0), ("r", "c", 2.0)])

    def names(df):
        return sorted(r["task"] for r in df.collect())

    assert names(ops.column_difference(left, right)) == ["a"]
    assert names(ops.column_intersection(left, right)) == ["b"]
    assert names(ops.column_union(left, right)) == ["a", "b", "c"]
    assert as_dict(ops.append_new_columns(left, right)) == {("r", "a"): 1.0, ("r", "b"): 1.0, ("r", "c"): 2.0}


def test_order_of_first_sight(spark):
    rows = [("m2", "b", 0), ("m1", "a", 1), ("m1", "b", 2), ("m3", "a", 3)]
    seen = local_table(spark, rows, "model string, task string, at bigint")
    columns = [r["task"] for r in ordering.column_order(seen, "at").orderBy("pos").collect()]
    assert columns == ["b", "a"]
    found = ordering.row_order(seen, "at").orderBy("column_pos", "pos").collect()
    assert [r["model"] for r in found] == ["m2", "m1", "m3"]
    other = local_table(spark, [("c", 0), ("a", 1)], "task string, pos bigint")
    both = ordering.overlay_order(ordering.column_order(seen, "at"), other).orderBy("side", "pos")
    assert [r["task"] for r in both.collect()] == ["b", "a", "c"]
