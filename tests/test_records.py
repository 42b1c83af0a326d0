import gzip
import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoremill.functions.tags import render_tags
from scoremill.operators import experiments as exp
from scoremill.operators.newest import newest, newest_score, newest_values
from scoremill.plans import dashboard
from scoremill.session import local_table, shared_dir, stage
from scoremill.sources import landing, records
from scoremill.streaming import incremental


def record(experiment, alias, date, score, model="m", idx=0, extra=None, **config):
    metadata = {**({"alias": alias} if alias else {}), **config}
    return {
        "experiment_id": experiment,
        "task_name": "task",
        "task_idx": idx,
        "task_config": {"metadata": metadata, "limit": [1, 2]},
        "model_config": {"model": model, "revision": None},
        "current_date": date,
        "metrics": {"primary_score": score, **(extra or {})},
    }


RECORDS = [
    record("e1", "arc:rc::s", "2025-01-01 00:00:00 UTC", 0.1),
    record("e2", "arc:rc::s", "2025-01-02 00:00:00 UTC", 0.2, extra={"bits_per_byte_corr": 0.9}),
    record("e3", "arc:rc::s", "2025-01-02 00:00:00 UTC", 0.3, idx=1),
    record("e1", "group", "2025-01-01 00:00:00 UTC", 0.9, num_tasks=3),
    record("e1", "alpaca_eval", "2025-01-01 00:00:00 UTC", 55.0),
    record("e2", "gsm8k", "2025-01-01 00:00:00 UTC", None, extra={"extra_metrics": {"pass_at_4": 0.5}}),
    record("e2", None, "2025-01-01 00:00:00 UTC", 0.4),
    # a derived name that is also a real task: the real task's score counts
    record("e2", "arc:bpb::s", "2024-12-01 00:00:00 UTC", 0.77),
]


@pytest.fixture(scope="module")
def landed_files(tmp_path_factory):
    """Two JSON-lines files, one of them compressed, as a lander writes them."""
    folder = tmp_path_factory.mktemp("landed")
    lines = [json.dumps(r) + "\n" for r in RECORDS]
    (folder / "a.json").write_text("".join(lines[:3]))
    with gzip.open(folder / "b.json.gz", "wt") as file:
        file.write("".join(lines[3:]))
    return str(folder)


def test_cells_from_files(spark, landed_files):
    recs = exp.describe_records(records.accept(records.read_records(spark, landed_files)))
    latest = exp.newest_records(recs, dashboard.TIEBREAK)
    found = {(r["model"], r["task"]): r["score"] for r in exp.record_cells(latest, dashboard.TIEBREAK).collect()}
    text = json.dumps(RECORDS[6]["task_config"])
    assert found == {
        ("m", "arc:rc::s"): 0.2,
        ("m", "arc:bpb::s"): 0.77,
        ("m", "alpaca_eval"): 0.55,
        ("m", "gsm8k"): None,
        ("m", "gsm8k:pass_at_4"): 0.5,
        ("m", "task-" + hashlib.sha256(text.encode()).hexdigest()[:6]): 0.4,
    }


def test_nameless_model_fails(spark):
    lines = local_table(spark, [(json.dumps(record("e", "a", "2025-01-01", 0.1, model=None)),)], "text string")
    recs = exp.describe_records(records.accept(records.parse_records(lines)))
    with pytest.raises(PySparkException, match="names no model"):
        exp.record_cells(recs, dashboard.TIEBREAK).collect()


def test_skip_or_fail(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(RECORDS[0]) + "\n{broken\n" + json.dumps(RECORDS[1]) + "\n")
    recs = records.read_records(spark, str(path))
    assert tuple(records.count_dropped(recs).first()) == (2, 1)
    assert records.accept(recs).count() == 2
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        records.read_records(spark, str(path), skip_on_fail=False).collect()
    lines = local_table(spark, [("{broken",)], "text string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        records.parse_records(lines, skip_on_fail=False).collect()
    (tmp_path / "n.json").write_text('{"experiment_id": "e"}\n')
    nameless = records.read_records(spark, str(tmp_path / "n.json"), skip_on_fail=False)
    with pytest.raises(PySparkException, match="names no task"):
        records.accept(nameless).select("experiment_id").collect()
    lenient = records.read_records(spark, str(tmp_path / "n.json"))
    assert tuple(records.count_dropped(lenient).first()) == (0, 1)


EXPERIMENTS = [
    ("e1", "m", "a,b", "2025-01-04T01:00:00+09:00", "dashboard=main,k=1"),
    ("e2", "m", "b", "2025-01-03T18:00:00", "dashboard=main,dashboard=other"),
    ("e3", "m-2", "a", "2025-01-02T00:00:00+00:00", "dashboard=other"),
    ("e4", "m", "a", "2024-01-02T00:00:00", "dashboard=main"),
]


@pytest.fixture(scope="module")
def found_experiments(spark):
    keys = ("experiment_id", "model_name", "task_name", "created", "tags")
    rows = [(json.dumps(dict(zip(keys, e))),) for e in EXPERIMENTS]
    return records.parse_experiments(local_table(spark, rows, "text string"))


def ids(df):
    return [r["experiment_id"] for r in df.collect()]


def test_find(found_experiments):
    assert sorted(ids(exp.find_experiments(found_experiments, "main"))) == ["e1", "e2", "e4"]
    since = exp.find_experiments(found_experiments, "main", limit=10, created_from="2024-07-01")
    assert ids(since) == ["e2", "e1"]  # e4 is too old
    assert ids(exp.find_experiments(found_experiments, "other", "m")) == ["e2"]
    assert ids(exp.find_experiments(found_experiments, model_name="m", limit=1)) == ["e2"]
    with pytest.raises(ValueError):
        exp.find_experiments(found_experiments)


def test_list(found_experiments):
    listed = {r["experiment_id"]: (r["tasks"], r["n_tasks"]) for r in exp.list_experiments(found_experiments, "m", ["^a"]).collect()}
    assert listed == {"e1": (["a"], 1), "e4": (["a"], 1)}
    assert exp.list_experiments(found_experiments, "m").count() == 3


def tagged(df):
    rows = df.select("experiment_id", render_tags(F.col("tags")).alias("t"), "changed").collect()
    return {r["experiment_id"]: (r["t"], r["changed"]) for r in rows}


def test_tagging(found_experiments):
    added = tagged(exp.add_to_dashboard(found_experiments, "m", "other", source_dashboard="main"))
    assert added["e1"] == ("dashboard=main,k=1,dashboard=other", True)
    assert added["e2"] == ("dashboard=main,dashboard=other", False)
    assert added["e3"][1] is False and added["e4"][1] is True
    fuzzy = tagged(exp.add_to_dashboard(found_experiments, "m", "new", fuzzy=True))
    assert all(changed for _, changed in fuzzy.values())
    removed = tagged(exp.remove_from_dashboard(found_experiments, "m", "main"))
    assert removed["e1"] == ("k=1", True) and removed["e2"] == ("dashboard=other", True)
    assert removed["e3"] == ("dashboard=other", False) and removed["e4"] == ("", True)


def test_dashboard_from_experiments(spark, found_experiments):
    lines = local_table(spark, [(json.dumps(r),) for r in RECORDS], "text string")
    recs = records.accept(records.parse_records(lines))
    cells = dashboard.dashboard_cells(found_experiments, recs, "other")
    found = {(r["model"], r["task"]): r["score"] for r in cells.collect()}
    assert found[("m", "arc:rc::s")] == 0.2 and ("m", "alpaca_eval") not in found


def test_newest_does_not_depend_on_order(spark):
    random.seed(3)
    rows = [(f"k{random.randint(0, 5)}", random.randint(0, 4), i, random.random()) for i in range(200)]
    rows += [("hot", random.randint(0, 4), 1000 + i, random.random()) for i in range(300)]
    rows.append(("old", None, -5, 0.5))
    expected = {}
    for key, ts, i, score in rows:
        rank = (-1 if ts is None else ts, i)
        if key not in expected or rank > expected[key][0]:
            expected[key] = (rank, score)
    expected = {key: score for key, (_, score) in expected.items()}
    for _ in range(2):
        random.shuffle(rows)
        frame = local_table(spark, rows, "k string, t int, i bigint, score double").repartition(5)
        frame = frame.withColumn("ts", F.timestamp_seconds("t"))
        whole = newest(frame, ["k"], [F.desc_nulls_last("ts"), F.desc("i")])
        packed = newest_score(frame, ["k"], F.col("score"), F.col("ts"), F.col("i"))
        largest = newest_values(frame, ["k"], ["ts", "i"], ["score"])
        for df in (whole, packed, largest):
            assert {r["k"]: r["score"] for r in df.collect()} == expected


def test_zoneless_times_keep_their_order_in_any_zone(spark):
    """02:30 does not exist in New York on that day; as an instant it would pass 03:10."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("k", "2024-03-10 02:30:00.000001", 1, 0.1), ("k", "2024-03-10 03:10:00", 2, 0.2), ("k", "1969-12-31 23:59:59.5", 3, 0.3)]
        frame = local_table(spark, rows, "k string, t string, i bigint, score double")
        frame = frame.withColumn("ts", F.col("t").cast("timestamp_ntz"))
        assert newest_score(frame, ["k"], F.col("score"), F.col("ts"), F.col("i")).first()["score"] == 0.2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_newest_reduces_before_the_shuffle(spark):
    frame = spark.range(10).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("timestamp").alias("ts"))
    plan = newest(frame, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = newest_score(frame, ["k"], F.col("id"), F.col("ts"), F.col("id"))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def batch(spark, rows):
    """Records (experiment, task, score)."""
    full = [(e, i, None, score) for e, i, score in rows]
    return local_table(spark, full, "experiment_id string, task_idx int, task_hash string, score double")


def state(spark, table):
    return sorted((r["experiment_id"], r["task_idx"], r["score"]) for r in landing.landed(spark, table).collect())


def test_landing(spark):
    table = shared_dir(spark)
    assert landing.landed(spark, table) is None
    landing.land(spark, table, batch(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)]), 0)
    new = landing.land(spark, table, batch(spark, [("a", 0, 9.0), ("c", 0, 3.0)]), 1)
    assert ids(new) == ["c"]
    both = [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("c", 0, 3.0)]
    assert state(spark, table) == both
    landing.land(spark, table, batch(spark, [("a", 0, 9.0), ("c", 0, 3.0)]), 1)  # a repeated job
    assert state(spark, table) == both
    for _ in range(2):  # the second time is a repeated job
        landing.land(spark, table, batch(spark, [("a", 0, 9.0)]), 2, force=True)
        assert state(spark, table) == [("a", 0, 9.0), ("b", 0, 1.0), ("c", 0, 3.0)]
    landing.evict(spark, table, batch(spark, [("b", 0, 0.0)]))
    assert state(spark, table) == [("a", 0, 9.0), ("c", 0, 3.0)]
    landing.land(spark, table, batch(spark, [("b", 0, 5.0)]), 3)
    assert state(spark, table) == [("a", 0, 9.0), ("b", 0, 5.0), ("c", 0, 3.0)]


def test_an_experiment_may_arrive_in_parts(spark):
    table = shared_dir(spark)
    landing.land(spark, table, batch(spark, [("a", 0, 1.0)]), 0)
    landing.land(spark, table, batch(spark, [("a", 0, 1.0), ("a", 1, 2.0)]), 1)
    assert state(spark, table) == [("a", 0, 1.0), ("a", 1, 2.0)]


def test_evicted_experiment_lands_again_in_the_same_batch(spark):
    table = shared_dir(spark)
    landing.land(spark, table, batch(spark, [("e1", 0, 1.0), ("e2", 0, 1.0)]), 0)
    landing.evict(spark, table, batch(spark, [("e1", 0, 0.0)]))
    landing.land(spark, table, batch(spark, [("e1", 0, 1.0), ("e2", 0, 1.0)]), 0)
    assert state(spark, table) == [("e1", 0, 1.0), ("e2", 0, 1.0)]


def test_repeated_records_land_once_however_cut(spark):
    one, two = shared_dir(spark), shared_dir(spark)
    rows = [("a", 0, 1.0), ("a", 0, 1.0), ("b", 0, 2.0), ("b", 0, 3.0)]
    landing.land(spark, one, batch(spark, rows), 0)
    landing.land(spark, two, batch(spark, rows[:3]), 0)
    landing.land(spark, two, batch(spark, rows[3:]), 1)
    assert state(spark, one) == state(spark, two) == [("a", 0, 1.0), ("b", 0, 2.0)]


def test_lost_load_leaves_nothing(spark):
    table = shared_dir(spark)
    landing.land(spark, table, batch(spark, [("a", 0, 1.0)]), 0)
    # records that were written, by a job lost before its entry in the log
    batch(spark, [("b", 0, 1.0)]).write.parquet(f"{table}/records/load=l-lost")
    assert state(spark, table) == [("a", 0, 1.0)]
    landing.land(spark, table, batch(spark, [("b", 0, 1.0)]), 1)
    assert state(spark, table) == [("a", 0, 1.0), ("b", 0, 1.0)]


def test_writers_keep_to_their_folders(spark):
    table = shared_dir(spark)
    landing.land(spark, table, batch(spark, [("a", 0, 1.0)]), 0, writer="one")
    landing.land(spark, table, batch(spark, [("b", 0, 1.0)]), 0, writer="two")
    assert state(spark, table) == [("a", 0, 1.0), ("b", 0, 1.0)]


def test_invalidating(spark):
    table = shared_dir(spark)
    landing.invalidate(spark, table)
    landing.land(spark, table, batch(spark, [("a", 0, 1.0), ("b", 0, 1.0)]), 0)
    landing.invalidate(spark, table)
    assert state(spark, table) == []
    landing.land(spark, table, batch(spark, [("a", 0, 2.0)]), 1)
    assert state(spark, table) == [("a", 0, 2.0)]


def test_changed_experiments_are_evicted(spark, found_experiments):
    table = shared_dir(spark)
    landing.land(spark, table, batch(spark, [("e1", 0, 1.0), ("e2", 0, 1.0), ("e3", 0, 1.0)]), 0)
    dashboard.evict_changed(exp.remove_from_dashboard(found_experiments, "m", "other"), table)
    assert state(spark, table) == [("e1", 0, 1.0), ("e3", 0, 1.0)]


def test_landing_without_keeping(spark):
    table = shared_dir(spark)
    passed = landing.land(spark, table, batch(spark, [("a", 0, 1.0)]), 0, keep=False)
    assert ids(passed) == ["a"] and landing.landed(spark, table) is None


def test_stream_lands_like_one_batch(spark):
    batches = [[("a", 0, 1.0), ("b", 0, 1.0)], [("b", 1, 2.0), ("c", 0, 2.0)], [("a", 1, 3.0), ("a", 0, 1.0)]]
    base, whole = shared_dir(spark), shared_dir(spark)
    for rows in batches:
        frame = batch(spark, rows)
        frame.write.mode("append").parquet(f"{base}/inbox")
        stream = spark.readStream.schema(frame.schema).parquet(f"{base}/inbox")
        incremental.land_stream(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    landing.land(spark, whole, batch(spark, list(dict.fromkeys(r for rows in batches for r in rows))), 0)
    assert state(spark, f"{base}/table") == state(spark, whole)
    # a new checkpoint reads everything anew, from batch 0, and neither loses nor repeats a record
    stream = spark.readStream.schema(frame.schema).parquet(f"{base}/inbox")
    incremental.land_stream(stream, f"{base}/table", f"{base}/other").awaitTermination()
    assert state(spark, f"{base}/table") == state(spark, whole)


def test_stream_keeps_the_newest(spark):
    random.seed(11)
    rows = [(f"k{random.randint(0, 6)}", random.randint(0, 9), i, random.random()) for i in range(120)]
    base = shared_dir(spark)
    whole = local_table(spark, rows, "k string, t int, i int, score double")
    for start in range(0, 120, 40):
        part = local_table(spark, rows[start : start + 40], "k string, t int, i int, score double")
        part.write.mode("append").parquet(f"{base}/inbox")
        stream = spark.readStream.schema(whole.schema).parquet(f"{base}/inbox")
        updates = incremental.newest_stream(stream, ["k"], ["score"], [F.col("t"), F.col("i")])
        incremental.write_updates(updates, f"{base}/updates", f"{base}/checkpoint").awaitTermination()
    found = {r["k"]: r["score"] for r in incremental.read_newest(spark, f"{base}/updates", ["k"]).collect()}
    expected = {r["k"]: r["score"] for r in newest(whole, ["k"], [F.desc("t"), F.desc("i")]).collect()}
    assert found == expected
    incremental.compact(spark, f"{base}/updates", ["k"])
    assert spark.read.parquet(f"{base}/updates").count() == len(expected)
    assert {r["k"]: r["score"] for r in incremental.read_newest(spark, f"{base}/updates", ["k"]).collect()} == expected


def test_staged_table(spark):
    frame = batch(spark, [("a", 0, 1.0)])
    staged = stage(frame)
    assert staged.schema == frame.schema and ids(staged) == ["a"]
    assert staged.inputFiles()[0].startswith("file:") and spark.conf.get("spark.checkpoint.dir") in staged.inputFiles()[0]
