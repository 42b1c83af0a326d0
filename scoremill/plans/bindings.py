"""Logical tables of the engine, bound to the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremill.operators.newest import newest_score, newest_values
from scoremill.operators.suites import SuiteBook
from scoremill.session import stage

EVENT_TASKS = 4  # tasks per event type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the number ``k`` of their JSON properties.

    As a generator's column ``k`` is parsed once per event, however many expressions use it.
    """
    parsed = F.inline(F.array(F.from_json("props", "k int")))
    return table(spark, sf_dir, "events").select("*", parsed)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, model, task, score, ts``: one metric record per event."""
    task = F.concat("event_type", F.lit(":"), (F.col("k") % EVENT_TASKS).cast("string"))
    return events(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"),
        task.alias("task"),
        (F.col("value") / 1000).alias("score"),
        "ts",
    )


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table of the newest event per model and task; the largest id wins equal times."""
    return newest_score(
        event_records(spark, sf_dir), ["model", "task"], F.col("score"), F.col("ts"), F.col("event_id")
    )


def nullable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest cells in which high scores are stored nulls."""
    score = F.when(F.col("score") <= 0.22, F.col("score"))
    return event_cells(spark, sf_dir).select("model", "task", score.alias("score"))


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table with many ties: model is the supplier, task the flag and status."""
    latest = newest_values(
        table(spark, sf_dir, "lineitem"),
        ["l_suppkey", "l_returnflag", "l_linestatus"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"],
        ["l_discount", "l_shipdate"],
    )
    return latest.select(
        F.col("l_suppkey").cast("string").alias("model"),
        F.concat("l_returnflag", "l_linestatus").alias("task"),
        F.col("l_discount").alias("score"),
        "l_shipdate",
    )


def event_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment per event, tagged with its type as dashboard and with ``k``."""
    tags = F.array(
        F.struct(F.lit("dashboard").alias("key"), F.col("event_type").alias("value")),
        F.struct(F.lit("k").alias("key"), F.col("k").cast("string").alias("value")),
    )
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("experiment_id"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_name"),
        F.concat_ws(
            ",",
            F.concat("event_type", F.lit(":"), (F.col("k") % EVENT_TASKS).cast("string")),
            F.concat("event_type", F.lit(":mc")),
            F.concat(F.lit("extra:"), (F.col("k") % 3).cast("string")),
        ).alias("task_name"),
        F.col("ts").cast("timestamp_ntz").alias("created"),
        tags.alias("tags"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records as raw JSON lines, one per event."""
    k = F.col("k")
    alias = F.concat(
        "event_type",
        F.when(k % 5 == 0, ":rc::set").when(k % 5 == 1, ":mc").when(k % 5 == 2, "::suite").otherwise(""),
    )
    has_alias, is_group = k % 7 != 0, k % 11 == 0
    metadata = F.concat(
        F.lit('{"metadata":{'),
        F.when(has_alias, F.concat(F.lit('"alias":"'), alias, F.lit('"'))).otherwise('"kind":"plain"'),
        F.when(is_group, ',"num_tasks":3').otherwise(""),
        F.lit('},"k":'),
        k.cast("string"),
        F.lit("}"),
    )
    score = (F.col("value") / 1000).cast("string")
    metrics = F.concat(
        F.when(k % 13 == 0, "{").otherwise(F.concat(F.lit('{"primary_score":'), score, F.lit(","))),
        F.lit('"bits_per_byte_corr":'),
        (k % 4).cast("string"),
        F.lit(',"logits_per_byte_corr":0.5,"extra_metrics":{"pass_at_4":0.25,"f1":0.125}'),
        F.when(k % 3 == 0, ',"pass_at_4":0.75').otherwise(""),
        F.when(k % 6 == 0, ',"pass_at_16":0.875').otherwise(""),
        F.lit("}"),
    )
    model = F.concat(
        F.lit('{"model":"m'),
        F.col("user_id").cast("string"),
        F.when(k % 2 == 0, '","revision":"r2"}').otherwise('","revision":null}'),
    )
    text = F.concat(
        F.lit('{"experiment_id":"'), F.col("event_id").cast("string"),
        F.lit('","task_name":"'), F.col("event_type"),
        F.lit('","task_idx":0,"num_instances":'), k.cast("string"),
        F.lit(',"processing_time":1.5,"current_date":"'),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.lit(' UTC","task_config":'), metadata,
        F.lit(',"model_config":'), model,
        F.lit(',"metrics":'), metrics,
        F.lit("}"),
    )
    return events(spark, sf_dir).select("event_id", text.alias("text"))


def event_suites() -> SuiteBook:
    """Suites over the event tasks, one of each kind and one nested view."""
    book = SuiteBook()
    for kind in ("click", "view"):
        book.register_suite(kind, "AVG", [f"{kind}:{i}" for i in range(EVENT_TASKS)])
    book.register_suite("engage", "AOA", ["click", "view", "signup:0"])
    book.register_suite("board", "VIEW", ["engage", "error:0"])
    book.register_suite("extras", "LIST", ["purchase:0"])
    book.register_suite("overview", "VIEW", ["board", "click", "error:1"])
    return book


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite edges read from the events: a suite per event type, one per k class, and one of all types."""
    kinds = events(spark, sf_dir).select(
        "event_type", (F.col("k") % EVENT_TASKS).cast("string").alias("c")
    )
    tasks = stage(kinds.distinct())
    by_type = tasks.select(
        F.col("event_type").alias("suite"),
        F.lit("AVG").alias("kind"),
        F.col("c").cast("int").alias("ord"),
        F.concat("event_type", F.lit(":"), "c").alias("child"),
        F.lit(False).alias("child_is_suite"),
    )
    by_class = tasks.select(
        F.concat(F.lit("class"), "c").alias("suite"),
        F.lit("LIST").alias("kind"),
        F.lit(0).alias("ord"),
        F.concat("event_type", F.lit(":"), "c").alias("child"),
        F.lit(False).alias("child_is_suite"),
    )
    whole = tasks.select(
        F.lit("all").alias("suite"),
        F.lit("AOA").alias("kind"),
        F.lit(0).alias("ord"),
        F.col("event_type").alias("child"),
        F.lit(True).alias("child_is_suite"),
    ).distinct()
    return stage(by_type.unionByName(by_class).unionByName(whole))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``config, path``: every page under its scheme."""
    return table(spark, sf_dir, "pages").select(
        F.split("url", ":")[0].alias("config"), F.col("url").alias("path")
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, length``: a token file of four bytes per character for every document."""
    return table(spark, sf_dir, "documents").select("source", (F.col("n_chars") * 4).alias("length"))
