"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int | str = "*", app: str = "scoremill") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Folder of a local session without spark.checkpoint.dir; that setting cannot be changed later.
LOCAL_DIR = "scoremill.local.dir"


def shared_dir(spark: SparkSession) -> str:
    """New folder for written intermediate tables, below ``spark.checkpoint.dir`` and a folder of the application.

    :func:`drop_staged` removes them all. That setting names storage all executors can reach. Only a local master may run without it; the
    session then gets a folder under the system's temporary one, as in tests.
    """
    base = _base(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="scoremill-")
        spark.conf.set(LOCAL_DIR, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Call it when their results are written or collected."""
    if base := _base(spark):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_DIR, None)


def stage(df: DataFrame) -> DataFrame:
    """Write a frame once into the shared folder and read it back.

    For a table that several steps use: it is computed once, survives lost executors, and Spark
    knows its real size when it plans joins.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Table of rows the driver holds. Spark knows its size, and so when to broadcast it."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(column, type=field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
