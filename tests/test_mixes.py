import json
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoremill.operators import cells as cell_ops
from scoremill.operators import manifest, mixture, ordering
from scoremill.plans import mixes, registered
from scoremill.session import local_table, shared_dir
from scoremill.sources import export, manifests


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_mix_lists(spark, tmp_path):
    (tmp_path / "one.txt").write_text("# head\n\n  s3://b/x/1.npy \nlabel,s3://b/x/2.npy,more\nlabel,s3://b/x/3.csv\n")
    (tmp_path / "two.txt").write_text("s3://b/x/1.npy\n")
    found = rows(manifests.read_mix_lists(spark, str(tmp_path)), "config", "path")
    assert found == [("one.txt", "s3://b/x/1.npy"), ("one.txt", "s3://b/x/2.npy"), ("two.txt", "s3://b/x/1.npy")]


RECIPE = """
name: run
dataset:
  sources:
    - name: web
      target_ratio: 0.75
      paths: ["s3://b/web/*.npy", "s3://b/web2/1.npy"]
    - name: code
      target_ratio: 0.25
      repetition_factor: 2.0
      paths: ["s3://b/code/*.npy"]
data:
  paths:
    - "label,s3://b/old/1.npy"
"""


def test_recipes(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(RECIPE)
    recipes = manifests.parse_recipes(manifests.read_texts(spark, str(tmp_path / "*.yaml")))
    assert rows(recipes.select("config", "source", "target_ratio", "repetition_factor", "path"), "path") == [
        ("r.yaml", None, None, None, "label,s3://b/old/1.npy"),
        ("r.yaml", "code", 0.25, 2.0, "s3://b/code/*.npy"),
        ("r.yaml", "web", 0.75, 1.0, "s3://b/web/*.npy"),
        ("r.yaml", "web", 0.75, 1.0, "s3://b/web2/1.npy"),
    ]
    assert ("r.yaml", "s3://b/old/1.npy") in rows(manifests.recipe_paths(recipes))
    sources = rows(mixes.recipe_sources(recipes), "name")
    assert sources == [("r.yaml", "code", 0.25, 2.0, 1.0), ("r.yaml", "web", 0.75, 1.0, 1.0)]
    listing = [("s3://b/web/1.npy", 300), ("s3://b/web/2.npy", 60), ("s3://b/web/x/3.npy", 9), ("s3://b/web2/1.npy", 40)]
    files = local_table(spark, [*listing, ("s3://b/code/1.npy", 40)], "path string, length bigint")
    assert mixes.recipe_patterns(recipes) == ["s3://b/code/*.npy", "s3://b/web/*.npy", "s3://b/web2/1.npy"]
    plan = mixes.recipe_plan(recipes, files, 1000, 128)
    assert rows(plan.select("config", "name", "path", "ratio", "max_repetition_ratio", "max_tokens"), "path") == [
        ("r.yaml", "code", "s3://b/code/1.npy", 0.25, 2.0, 1000),
        ("r.yaml", "web", "s3://b/web/1.npy", 0.75, 1.0, 1000),
        ("r.yaml", "web", "s3://b/web/2.npy", 0.75, 1.0, 1000),
        ("r.yaml", "web", "s3://b/web2/1.npy", 0.75, 1.0, 1000),
    ]
    with pytest.raises(Exception, match="no paths found for source code"):
        mixes.recipe_plan(recipes, files.filter("path NOT LIKE '%code%'"), 1000, 128).count()
    mixed = recipes.withColumn("path", F.regexp_replace("path", "s3://b/web2", "gs://b/web2"))
    with pytest.raises(Exception, match="mixed URL schemes in source web"):
        mixes.recipe_plan(mixed, files, 1000, 128).count()
    # another recipe with the same source names keeps its own ratios and files
    other = recipes.withColumns({"config": F.lit("o"), "target_ratio": F.lit(0.5)}).filter("path NOT LIKE '%web2%'")
    both = mixes.recipe_plan(recipes.unionByName(other), files, 1000, 128)
    assert Counter((r["config"], r["name"], r["ratio"]) for r in both.collect()) == {
        ("r.yaml", "web", 0.75): 3, ("r.yaml", "code", 0.25): 1, ("o", "web", 0.5): 2, ("o", "code", 0.5): 1,
    }


def test_flatten(spark):
    text = json.dumps({"a": {"b": 1, "c": {"d": None}}, "l": [1, {"x": "y"}], "e": {}, "s": "t", "f": True})
    configs = local_table(spark, [("c", text)], "config string, text string")
    assert dict(r[1:] for r in rows(manifests.flatten(configs))) == {
        "a.b": "1",
        "a.c.d": None,
        "l": '[1, {"x": "y"}]',
        "s": "t",
        "f": "true",
    }
    found = dict(r[1:] for r in rows(manifests.flatten(configs, sep="/", include_lists=True)))
    assert found["l/0"] == "1" and found["l/1/x"] == "y" and "l" not in found


def test_run_config_paths(spark):
    texts = [
        {"data": {"paths": ["a/1.npy", "b/2.npy"]}, "lr": 1},
        {"dataset": {"paths": ["c/3.npy"], "source_mixture_config": {"source_configs": [{"name": "x"}, {"paths": ["d/4.npy", "d/5.npy"]}]}}},
        {"lr": 2},
    ]
    configs = local_table(spark, [(str(i), json.dumps(t)) for i, t in enumerate(texts)], "config string, text string")
    assert rows(manifests.run_config_paths(configs), "path") == [
        ("0", "data", "a/1.npy"),
        ("0", "data", "b/2.npy"),
        ("1", "dataset", "c/3.npy"),
        ("1", "mixture", "d/4.npy"),
        ("1", "mixture", "d/5.npy"),
    ]


def test_files_and_tokens(spark, tmp_path):
    for name, size in (("a/1.npy", 40), ("a/deep/2.npy", 10), ("b/3.npy", 8), ("b/skip.txt", 99)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes(size))
    sources = {"a": [f"{tmp_path}/a/**/*.npy"], "b": [f"{tmp_path}/b/*.npy"]}
    files = manifests.source_files(spark, sources)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    counts = mixture.token_counts(files)
    assert rows(counts.select("source", "tokens", "n_files", "ratio"), "source") == [
        ("a", 12, 2, pytest.approx(12 / 14)),
        ("b", 2, 1, pytest.approx(2 / 14)),
    ]
    (tmp_path / "a/deep/c").mkdir()
    (tmp_path / "a/deep/c/4.npy").write_bytes(bytes(4))
    length = lambda *patterns: sorted(r["length"] for r in manifests.expand_files(spark, list(patterns)).collect())
    assert length(f"{tmp_path}/a/**") == [4, 10, 40]
    assert length(f"{tmp_path}/**/c/*.npy") == [4]
    assert length(f"{tmp_path}/*/**/[0-2].npy", f"{tmp_path}/b/*.npy", f"{tmp_path}/**/3.npy") == [8, 10, 40]
    halves = mixture.token_counts(files, "uint16").select("source", "tokens")
    assert rows(halves, "source") == [("a", 25), ("b", 4)]
    with pytest.raises(Exception, match="(?i)not.*(exist|found)|nothing"):
        manifests.expand_files(spark, [f"{tmp_path}/nothing/*.npy"]).collect()
    with pytest.raises(FileNotFoundError):
        manifests.expand_files(spark, [f"{tmp_path}/b/**/*.bin"])
    with pytest.raises(ValueError):
        manifests.source_files(spark, {"c": []})


def test_token_counts_report_failures_and_emptiness(spark):
    files = local_table(spark, [("a", 40), ("a", None), ("b", None)], "source string, length bigint")
    assert rows(mixture.token_counts(files).select("source", "tokens", "n_failed", "ratio"), "source") == [
        ("a", 10, 1, 1.0),
        ("b", 0, 1, 0.0),
    ]
    with pytest.raises(PySparkException, match="no tokens found"):
        mixture.token_counts(files.filter("source = 'b'")).collect()


def test_sizes_meet_listed_paths(spark):
    listed = local_table(spark, [("a", "s3://b/1"), ("a", "/x/2"), ("b", "s3://b/3")], "name string, path string")
    files = local_table(spark, [("s3a://b/1", 8), ("file:/x/2", 4)], "path string, length bigint")
    assert rows(mixture.attach_sizes(listed, files), "path") == [("a", "/x/2", 4), ("a", "s3://b/1", 8), ("b", "s3://b/3", None)]
    globs = local_table(spark, [("a", "s3://b/*"), ("a", "/x/**/?.npy"), ("b", "/y/[!a]*")], "name string, path string")
    listing = [("s3a://b/1", 8), ("s3a://b/d/1", 9), ("/x/1.npy", 1), ("/x/y/z/2.npy", 2), ("/x/22.npy", 3), ("/y/ab", 4)]
    more = local_table(spark, listing, "path string, length bigint")
    assert rows(mixture.attach_sizes(globs, more), "path") == [
        ("a", "/x/1.npy", 1),
        ("a", "/x/y/z/2.npy", 2),
        ("b", "/y/[!a]*", None),
        ("a", "s3a://b/1", 8),
    ]


def test_parsed_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(manifests, "PIECE", 3)
    text = json.dumps({f"k{i}": i for i in range(10)})
    configs = local_table(spark, [("a", text), ("b", "{}"), ("c", text)], "config string, text string")
    assert manifests.flatten(configs.coalesce(1)).count() == 20


SOURCE_TYPE = "name string, target_ratio double, repetition_factor double"


def test_ratios(spark):
    sources = local_table(spark, [("a", 0.3, 1.0), ("b", 0.0, 2.0)], SOURCE_TYPE)
    priors = local_table(spark, [("a", 0.9), ("b", 0.1)], "source string, ratio double")
    assert rows(mixture.resolve_ratios(sources, priors), "name") == [("a", 0.3, 1.0), ("b", 0.1, 2.0)]
    with pytest.raises(PySparkException, match="no ratio for source b"):
        mixture.resolve_ratios(sources, priors.filter("source = 'a'")).collect()
    with pytest.raises(PySparkException, match="no ratio for source b"):
        mixture.resolve_ratios(sources).collect()


def test_validation(spark):
    good = local_table(spark, [("a", None, 1.0), ("b", None, 1.0)], SOURCE_TYPE)
    assert mixture.validate_sources(good).count() == 2 and len(rows(mixture.validate_sources(good))) == 2
    mixed = local_table(spark, [("a", 0.5, 1.0), ("b", None, 1.0)], SOURCE_TYPE)
    with pytest.raises(Exception, match="missing for b"):
        mixture.validate_sources(mixed).count()
    schemes = local_table(spark, [("a", "s3://x/1"), ("a", "s3://y/2"), ("b", "/x")], "name string, path string")
    assert rows(mixture.validate_schemes(schemes), "name") == [("a", 2, "s3"), ("b", 1, "")]
    bad = local_table(spark, [("a", "s3://x/1"), ("a", "gs://y/2")], "name string, path string")
    with pytest.raises(PySparkException, match="mixed URL schemes in source a"):
        mixture.validate_schemes(bad).select("name").collect()


def test_plan_without_fractions_concatenates(spark):
    ratios = local_table(spark, [("a", 1.0, 1.0), ("b", 1.0, 1.0)], "name string, ratio double, repetition_factor double")
    paths = local_table(spark, [("a", "p1"), ("b", "p2")], "name string, path string")
    found = mixture.mix_plan(ratios, paths, 100, 8).select("path", "is_fractional", "ratio", "max_tokens", "seed")
    assert rows(found, "path") == [("p1", False, None, None, 42), ("p2", False, None, None, 42)]
    with pytest.raises(PySparkException, match="no paths found for source b"):
        mixture.mix_plan(ratios, paths.filter("name = 'a'"), 100, 8).collect()


def test_domain_weights(spark, tmp_path):
    (tmp_path / "natural.json").write_text(json.dumps([{"domain": "d1", "weight": 0.75}, {"domain": "d2", "weight": 0.25}]))
    (tmp_path / "shifted.json").write_text(json.dumps([{"domain": "d1", "weight": 0.5}, {"domain": "d3", "weight": 0.5}]))
    weights = manifests.read_domain_weights(spark, f"{tmp_path}/*.json")
    assert Counter(r["mix"] for r in weights.collect()) == {"natural": 2, "shifted": 2}
    sides = [weights.filter(F.col("mix") == m) for m in ("natural", "shifted")]
    assert rows(mixture.compare_weights(*sides), "domain") == [("d1", 0.75, 0.5), ("d2", 0.25, None), ("d3", None, 0.5)]
    top = ordering.top_k(weights, "mix", [F.desc("weight"), F.asc("domain")], 1)
    assert rows(top.select("mix", "domain", "rank"), "mix") == [("natural", "d1", 1), ("shifted", "d1", 1)]
    stats = rows(ordering.group_stats(weights, "mix", "weight"), "mix")
    assert stats[0][:3] == ("natural", 2, 0.5) and stats[0][3] == pytest.approx(0.3535533906)


def test_path_table(spark):
    listed = [("one", "s3://b/x/1.npy"), ("one", "s3://b/x/2.npy"), ("one", "/y/1.npy"), ("two", "gs://c/x/9.npy"), ("two", "/y/7.npy"), ("two", "/y/7.csv")]
    paths = local_table(spark, listed, "config string, path string")
    table = mixes.compare_path_lists(paths)
    assert table.columns == ["base_path", "one", "two", "match"]
    assert rows(table) == [("x", 2, 1, False), ("y", 1, 1, True), ("Total", 3, 2, None)]
    assert rows(manifest.path_table(manifest.path_counts(paths).limit(0))) == []
    chosen = mixes.compare_path_lists(paths, ["two", "none"])
    assert chosen.columns == ["base_path", "two", "none", "match"]
    assert rows(mixes.compare_path_lists(paths.filter("config = 'one' OR path LIKE '/y/%'"), ["two"])) == [("y", 1, True), ("Total", 1, None)]
    folders = rows(manifest.folder_counts(paths))
    assert folders[0][:2] == ("/y", 3) and folders[0][2] == 0.5


def test_two_way_diff(spark):
    left = local_table(spark, [("a", "1"), ("b", "2"), ("c", None), ("n", None), ("dataset.paths", "x")], "key string, value string")
    right = local_table(spark, [("a", "1"), ("b", "3"), ("n", None), ("d", "4")], "key string, value string")
    assert rows(manifest.diff_two(left, right)) == [
        ("b", "changed", "2", "3"),
        ("c", "left only", None, None),
        ("d", "right only", None, "4"),
    ]
    assert rows(manifest.diff_two(left, left)) == []


def test_many_way_diff(spark):
    settings = [
        *((c, "same", "1") for c in "xyz"),
        *((c, "differs", v) for c, v in zip("xyz", "112")),
        *((c, "partial", "1") for c in "xy"),
        ("x", "dashed", "1"), ("y", "dashed", "-"), ("z", "dashed", "1"),
        ("x", "data.paths", "p"), ("x", "data", "q"), ("x", "dataset.source_mixture_config.source_configs", "r"),
        *((c, "nulls", None) for c in "xyz"),
    ]
    found = manifest.diff_many(local_table(spark, settings, "config string, key string, value string"))
    assert {r["key"] for r in found.collect()} == {"differs", "partial", "dashed"}


def test_json_document_is_whole(spark):
    triples = [(f'm"{i}', f"t{j}", None if (i + j) % 3 == 0 else i / 7) for i in range(5) for j in range(4) if i != j]
    path = shared_dir(spark)
    export.write_json(cell_ops.make_cells(spark.range(1), triples).repartition(4), path)
    from pathlib import Path

    text = "\n".join(p.read_text() for p in sorted(Path(path).glob("part-*")))
    expected = {}
    for model, task, score in triples:
        expected.setdefault(task, {})[model] = score
    found = json.loads(text)
    assert found == expected
    assert list(found) == sorted(found) and all(list(c) == sorted(c) for c in found.values())


def test_csv_and_wide(spark, capsys):
    cells = cell_ops.make_cells(spark.range(1), [("a,b", "t1", 0.5), ("c", "t2", 0.12345), ("c", "t1", 0.0)])
    table = export.wide_sorted(cells, ["t2", "t1"], "t1")
    assert [tuple(r) for r in table.collect()] == [("a,b", None, 0.5), ("c", 0.12345, 0.0)]
    path = shared_dir(spark)
    export.write_csv(table, path)
    read = spark.read.csv(path, header=True)
    assert read.columns == ["name", "t2", "t1"]
    assert rows(read, "name") == [("a,b", "-", "50.00"), ("c", "12.35", "0.00")]
    export.show(table)
    assert "50.00" in capsys.readouterr().out


def test_cells_round_trip(spark):
    cells = cell_ops.make_cells(spark.range(1), [("a", "t", None), ("b", "t", 0.1)])
    path = shared_dir(spark)
    export.write_cells(cells, path)
    assert sorted(rows(spark.read.schema(cell_ops.CELL_TYPE).json(path))) == [("a", "t", None), ("b", "t", 0.1)]


def test_token_counts_read_files_once(spark, tmp_path):
    path = str(tmp_path / "files")
    local_table(spark, [("a", 40), ("b", 8)], "source string, length bigint").write.parquet(path)
    counts = mixture.token_counts(spark.read.parquet(path))
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") <= 1


def test_files_of_documents_are_few_and_hold_all_tokens(spark, tmp_path, monkeypatch):
    """A file per task and source instead of one per document; rows of one id still share odd bytes."""
    docs = [(i, f"s{i % 2}", 100 + i) for i in range(300)] + [(7, "s1", 107), (None, "s0", 3), (None, "s0", 3), (900, "s0", None)]
    docs += [(901, "short", 0), (902, "short", 1), (903, "short", None)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registered, "shared_dir", lambda _: f"{tmp_path}/files")
    got = {r["source"]: (r["tokens"], r["n_failed"]) for r in registered.file_tokens(spark, str(tmp_path)).collect()}
    size = {}
    for i, s, n in docs:
        size[s, i] = size.get((s, i), 0) + max(n or 1, 1)
    assert got == {s: (sum(n // 2 for (t, _), n in size.items() if t == s), 0) for s in ("s0", "s1", "short")}
    assert len(list((tmp_path / "files").rglob("*.txt"))) < 60
