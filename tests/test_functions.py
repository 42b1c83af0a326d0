import hashlib
import os.path
import posixpath
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoremill.functions import display, metrics, names, paths, tags
from scoremill.functions.patterns import matches_any
from scoremill.session import local_table


def apply(spark, texts, fn):
    frame = local_table(spark, [(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["y"] for r in frame.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_bpb_name(spark):
    cases = {
        "arc:bpb::set": None,
        "arc:mc": None,
        "arc:mc::set": None,
        "arc:rc": "arc:bpb",
        "arc:rc::set": "arc:bpb::set",
        "gsm8k::set": "gsm8k:bpb::set",
        "lambada": "lambada:bpb",
        "arc:mcx": "arc:mcx:bpb",
    }
    assert apply(spark, list(cases), names.bpb_name) == list(cases.values())


def test_eval_run_name(spark):
    cases = {
        "s3://bucket/runs/my-run/step1000": "my-run_step1000",
        "/weka/x/my-run/step1000-hf/": "my-run_step1000-hf",
        "hub/model-7B": "model-7B",
        "gs://bucket/model/": "model",
        "plain": "plain",
        "/data/steps/model": "model",
    }
    assert apply(spark, list(cases), names.eval_run_name) == list(cases.values())
    full = apply(spark, ["a/b"], lambda c: names.eval_run_name(c, bos=True, shots=0, suffix="v2"))
    assert full == ["b_bos_s0_v2"]


def test_run_path(spark):
    host = names.RUN_HOST
    cases = {
        "team/project/run1": "team/project/run1",
        "/team/project/run1/": "team/project/run1",
        f"https://{host}/team/project/runs/run1": "team/project/run1",
        f"https://{host}/team/project/runs/run1?tab=x": "team/project/run1",
        f"https://{host}/team/project/runs/run1/overview": "team/project/run1",
        "just-a-file.txt": "just-a-file.txt",
    }
    assert apply(spark, list(cases), names.run_path) == list(cases.values())
    with pytest.raises(PySparkException, match="not a run path"):
        apply(spark, ["just-a-file.txt"], lambda c: names.run_path(c, strict=True))


def test_short_label(spark):
    assert apply(spark, ["a" * 30, "b" * 31], names.short_label) == ["a" * 30, "b" * 27 + "..."]


def test_percent_text(spark):
    frame = local_table(spark, [(0.12345,), (None,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in frame.select(display.percent_text(F.col("x"))).collect()] == ["12.35", "-", "100.00", "0.00"]


def test_tags(spark):
    parsed = apply(spark, [" dashboard=a,flag,k=1\n", ""], tags.parse_tags)
    assert [(t["key"], t["value"]) for t in parsed[0]] == [("dashboard", "a"), ("flag", "flag"), ("k", "1")]
    assert [(t["key"], t["value"]) for t in parsed[1]] == [("", "")]
    assert apply(spark, [" dashboard=a,flag=flag "], lambda c: tags.render_tags(tags.parse_tags(c))) == ["dashboard=a,flag"]
    with pytest.raises(PySparkException, match="may not contain"):
        apply(spark, ["a=b=c"], tags.parse_tags)
    for bad in ("a=b", "a,b"):
        with pytest.raises(ValueError):
            tags.tag("key", bad)


def test_storage_path(spark):
    cases = {
        "s3://bucket/a/b.npy": "a/b.npy",
        "GS://bucket/a/b.npy?x=1#y": "a/b.npy",
        "https://host/a/b;v=1": "a/b",
        "weka://bucket/a": "weka://bucket/a",
        "\\data\\a\\b": "data/a/b",
        "///a//b": "a//b",
        "/a/b?c": "a/b?c",
        "http://host": "",
    }
    assert apply(spark, list(cases), paths.storage_path) == list(cases.values())


def test_collapse_and_folder_follow_posix(spark):
    texts = ["a/./b//c", "a/../b", "../../a", "/..//a", "a/..", ".", "//a/b", "///a", "/", "a/b/../../..", "x", "a//", "/a//b"]
    assert apply(spark, texts, paths.collapse) == [posixpath.normpath(t) for t in texts]
    assert apply(spark, texts, paths.folder) == [os.path.dirname(t) for t in texts]


def test_base_path(spark):
    cases = {
        "data/dclm/v0/tokenizer/part/1.npy": "data/dclm/v0/tokenizer",
        "data/DCLM/x/my-Tokenizer/1.npy": "data/DCLM/x/my-Tokenizer",
        "data/dclm/v0/part/../1.npy": "data/dclm/v0/1.npy",
        "data/web/1.npy": "data/web",
        "data//web/./1.npy": "data/web",
        "1.npy": "1.npy",
    }
    assert apply(spark, list(cases), paths.base_path) == list(cases.values())


def locate(spark, texts, **options):
    frame = local_table(spark, [(i, t) for i, t in enumerate(texts)], "i int, path string")
    return [r["located"] for r in paths.with_location(frame, **options).orderBy("i").collect()]


def test_locate(spark):
    cases = {
        "gs://bucket/prefix": ("gs", "bucket/prefix"),
        "gcs://bucket/prefix": ("gs", "bucket/prefix"),
        "s3://bucket/prefix": ("s3", "bucket/prefix"),
        "s3n://bucket/prefix/": ("s3", "bucket/prefix/"),
        "/weka/oe-training-default/prefix": ("weka", "/oe-training-default/prefix"),
        "/oe-training-default/prefix/": ("weka", "/oe-training-default/prefix/"),
        "weka://oe-training-default/a/b/": ("weka", "/oe-training-default/a/b/"),
        "/weka//oe-training-default/./a": ("weka", "/oe-training-default/a"),
        "/home/user/data": ("file", "/home/user/data"),
        "file:///home/user/": ("file", "/home/user/"),
    }
    found = locate(spark, list(cases), mounts=["oe-training-default"])
    assert [(r["prot"], r["path"]) for r in found] == list(cases.values())
    for row in found:
        assert row["hash"] == hashlib.md5((row["prot"] + row["path"]).encode()).hexdigest()
    s3, weka, home = found[3], found[6], found[8]
    assert (s3["bucket"], s3["prefix"], s3["remote"], s3["local"]) == ("bucket", "prefix/", "s3://bucket/prefix/", None)
    assert (weka["bucket"], weka["prefix"]) == ("oe-training-default", "a/b/")
    assert (weka["remote"], weka["local"]) == ("weka://oe-training-default/a/b/", "/oe-training-default/a/b/")
    assert (home["remote"], home["bucket"], home["local"]) == (None, None, "/home/user/data")


@pytest.mark.parametrize("pattern", ["(?P<x>a)", r"a\Z", "(?x)a b", "a{,3}", re.compile("a", re.VERBOSE), re.compile("a", re.ASCII)])
def test_foreign_patterns_are_refused(pattern):
    with pytest.raises(ValueError, match="cannot run in Spark"):
        matches_any("task", [re.compile(pattern)])


@pytest.mark.parametrize("path", ["weka://non-existent-bucket/prefix", "azure://bucket/prefix"])
def test_locate_refuses(spark, path):
    with pytest.raises(PySparkException, match="cannot locate"):
        locate(spark, [path])
    assert locate(spark, [path], strict=False) == [None]
    assert locate(spark, [path], strict=False, mounts=["other"]) == [None]


def test_source_path(spark):
    cases = {
        "weka://bucket/a/": "/weka/bucket/a",
        "s3://bucket/a/": "s3://bucket/a/",
        "/data/a/": "/data/a",
    }
    assert apply(spark, list(cases), paths.source_path) == list(cases.values())
    for bad in ("r2://bucket/a", "https://host/a", "file:///a"):
        with pytest.raises(PySparkException, match="unsupported scheme"):
            apply(spark, [bad], paths.source_path)


def parse(spark, text):
    frame = local_table(spark, [(text,)], "metrics string")
    return metrics.with_metrics(frame).first()["metrics"]


def test_metrics_split_shared_and_extra(spark):
    found = parse(spark, '{"bits_per_byte_corr": 0.5, "extra_metrics": {"f1": 1, "em": 2}, "em": 3, "note": "x"}')
    assert found["primary_score"] is None and found["bits_per_byte_corr"] == 0.5
    assert found["extra_metrics"] == {"f1": 1.0, "em": 3.0, "note": None}
    assert parse(spark, '{"primary_score": 0.25}')["extra_metrics"] == {}
    assert parse(spark, "broken") is None


@pytest.mark.parametrize("text, expected", [
    ('{"bits_per_byte_corr": 0.0, "logits_per_byte_corr": 0.7}', 0.7),
    ('{"bits_per_byte_corr": 0.4, "logits_per_byte_corr": 0.7}', 0.4),
    ('{"bits_per_byte_corr": 0.0}', None),
])
def test_zero_bits_per_byte_falls_through(spark, text, expected):
    frame = metrics.with_metrics(local_table(spark, [(text,)], "metrics string"))
    assert frame.select(metrics.bits_per_byte(F.col("metrics"))).first()[0] == expected


def test_score_rules(spark):
    flex = '{"primary_score": 0.5, "exact_match_flex": 0.25}'
    rows = [
        ("minerva_math_algebra::zero_shot", flex),
        ("minerva_math_algebra", flex),
        ("alpaca_eval::tulu", '{"primary_score": 50}'),
        ("styled_math500_x::tulu", '{"primary_score": 0.5}'),
        ("wildchat_masked_ppl-67b0e9", '{"primary_score": 2}'),
        ("wildchat_masked_ppl-000000", '{"primary_score": 2}'),
    ]
    frame = metrics.with_metrics(local_table(spark, rows, "alias string, metrics string"))
    own = metrics.ScoreRule(("minerva_math", "zero_shot"), "extra", "exact_match_flex")
    found = [(r["alias"], r["score"], r["fix_missing"]) for r in metrics.fix_scores(frame, [own, *metrics.SCORE_RULES]).collect()]
    assert found == [
        ("minerva_math_algebra::zero_shot", 0.25, False),
        ("minerva_math_algebra", 0.5, False),
        ("alpaca_eval::tulu", 0.5, False),
        ("styled_math500_x::tulu", None, True),
        ("wildchat_masked_ppl", 2.0, False),
        ("wildchat_masked_ppl-000000", 2.0, False),
    ]


def test_alias_hashes_the_stored_text(spark):
    config = '{"a": 1, "metadata": {"num_tasks": 2}}'
    frame = local_table(spark, [("squad", config), ("squad", '{"metadata": {"alias": "x"}}')], "n string, c string")
    task = names.parse_task_config(F.col("c"))
    rows = frame.select(
        names.task_alias(task, F.col("c"), F.col("n")).alias("alias"), names.is_aggregate(task).alias("agg")
    ).collect()
    assert tuple(rows[0]) == ("squad-" + hashlib.sha256(config.encode()).hexdigest()[:6], True)
    assert tuple(rows[1]) == ("x", False)
    assert re.fullmatch(r"squad-[0-9a-f]{6}", rows[0]["alias"])


def test_model_name(spark):
    texts = ['{"model": "m", "revision": "r"}', '{"model": "m", "revision": null}', '{"revision": "r"}']
    assert apply(spark, texts, lambda c: names.model_name(names.parse_model_config(c))) == ["m:r", "m", None]
