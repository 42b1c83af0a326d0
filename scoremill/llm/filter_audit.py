"""Audit of how five filters interact, in every order, kept up by a stream with retractions.

Documents arrive file by file in available-now micro-batches. Each is judged once into a mask of the filters it fails.
Four of them look at the text alone. The fifth, E, fails a text that a smaller id has too, wherever in the table that
is: the keyed state holds the smallest id of every text so far, and when a smaller one arrives, the documents that
held the place before are retracted from the counters of their part and counted again as failing E. Every micro-batch
adds its changes of the counters as rows of its own; their sum is the audit of all files so far.

The counters are small (part, mask, two labels), so the 120 orders are worked out from them at the end.

State is keyed by text, a few hundred texts to a key of the stream, as a call per text would cost more than the work.
Copies within an Arrow batch of a task are settled before the shuffle: all but those of the smallest id fail E
whatever else arrives. A hot text therefore sends one row per Arrow batch to its key; the settled ones are dealt by id.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scoremill.session import shared_dir, stage

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 4  # micro-batches aimed at; changes no result
TEXTS = 256  # texts of a key of the state aimed at; changes no result
JUDGED = "bucket long, settled boolean, h1 long, h2 long, doc_id long, part string, mask int, n long"
CHANGES = "doc_id long, spread long, part string, mask int, n long"
COUNTERS = "part string, mask int, good boolean, toxic boolean, n long"
ENTRY = ["h1", "h2", "doc_id", "part", "mask", "n"]


@dataclass(frozen=True)
class Rules:
    """Limits of the filters A to D; E has none."""

    words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 3
    symbols: bytes = b"#$%&*|"

    def failed(self, text: str) -> int:
        """Mask of the filters A to D that a text fails."""
        raw = text.encode()
        words = raw.split()  # at ASCII white space
        upper = len(raw) - len(raw.translate(None, UPPER))
        tests = (
            len(words) < self.words,
            100 * len(set(words)) < self.distinct_percent * len(words),
            100 * upper > self.upper_percent * len(text),
            len(raw.translate(None, self.symbols)) < len(raw),
        )
        return sum(1 << i for i, failed in enumerate(tests) if failed)


def _lowest(h1: np.ndarray, h2: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Smallest id of the text of every row."""
    order = np.lexsort((doc_id, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = doc_id[order][new][np.cumsum(new) - 1]
    return out


def judge(batch: pa.RecordBatch, rules: Rules, buckets: int) -> pd.DataFrame:
    """Rows of JUDGED for the documents of an Arrow batch, equal ones added up."""
    texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
    digests = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), "<i8").reshape(-1, 4)
    ids = batch.column("doc_id")
    rows = pd.DataFrame(
        {
            "h1": digests[:, 0],
            "h2": digests[:, 1],
            "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False),
            "known": ids.is_valid().to_numpy(zero_copy_only=False),
            "part": ["" if p is None else p for p in batch.column("lang").to_pylist()],
            "mask": np.fromiter(map(rules.failed, texts), np.int32, len(texts)),
        }
    )
    rows = rows.groupby(list(rows.columns), as_index=False).size().rename(columns={"size": "n"})
    known = rows["known"].to_numpy()
    h1, doc_id = rows["h1"].to_numpy(), rows["doc_id"].to_numpy()
    later = np.zeros(len(rows), bool)
    later[known] = doc_id[known] > _lowest(h1[known], rows["h2"].to_numpy()[known], doc_id[known])
    rows["mask"] = rows["mask"] | np.where(later, REPEATED, 0).astype(np.int32)
    rows["settled"] = later | ~known
    rows["bucket"] = np.where(later, doc_id, h1).view(np.uint64) % np.uint64(buckets)
    rows["bucket"] = rows["bucket"].astype(np.int64)
    rows["doc_id"] = rows["doc_id"].astype("Int64").where(rows["known"])
    return rows


def retract(key: tuple, arriving: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes that the rows of a key make, and its new smallest ids.

    The state holds, as an Arrow stream, the rows of the smallest id of every text of the key.
    """
    new = pd.concat(arriving)
    settled = new[new["settled"]]
    new = new.loc[~new["settled"], ENTRY]
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0]
    rows = pd.concat([held, new], ignore_index=True)
    old = np.arange(len(rows)) < len(held)
    doc_id = rows["doc_id"].to_numpy(np.int64)
    first = doc_id == _lowest(rows["h1"].to_numpy(np.int64), rows["h2"].to_numpy(np.int64), doc_id)
    repeated = rows["mask"] | REPEATED
    gone = rows[old & ~first]
    changes = [
        settled,
        rows[~old & first],
        rows[~old & ~first].assign(mask=repeated),
        gone.assign(n=-gone["n"]),
        gone.assign(mask=repeated),
    ]
    if len(new):
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows.loc[first, ENTRY].astype({"doc_id": "int64"}), preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    out = pd.concat([c for c in changes if len(c)])
    out["doc_id"] = out["doc_id"].astype("Int64")
    # null ids are dealt by text where labels are joined, others by id
    out["spread"] = out["h1"].where(out["doc_id"].isna(), 0)
    yield out[["doc_id", "spread", "part", "mask", "n"]]


def arrivals(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Stream of the files under a path, or of a path that is a file itself, in about BATCHES micro-batches."""
    files = docs.inputFiles()
    if any(f.endswith("/" + path.rstrip("/").rpartition("/")[2]) for f in files):
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern, which here matches the file alone
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // BATCHES))).parquet(path)


def counters(spark: SparkSession, path: str, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(part, mask, good, toxic, n) of all documents in the Parquet files under ``path``, as the stream has left them.

    ``n`` has to be summed over the rows: every micro-batch adds its changes. A micro-batch that runs again replaces
    its own rows.
    """
    docs = spark.read.parquet(path)
    buckets = max(1, docs.count() // TEXTS)
    folder = shared_dir(spark)
    # as the stream's own files do, the counters lie in the shared folder
    spark.createDataFrame([], COUNTERS).write.parquet(f"{folder}/counters/batch=-1")
    flags = {c: F.coalesce(F.max(F.col(v) == 1), F.lit(False)) for c, v in (("good", "quality"), ("toxic", "toxic"))}
    known = stage(
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(f.alias(c) for c, f in flags.items()))
        .withColumn("spread", F.lit(0).cast("long"))
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = judge(batch, rules, buckets)
                yield pa.RecordBatch.from_pandas(rows, pa.schema(ARROW), preserve_index=False)

    def save(changes: DataFrame, number: int) -> None:
        labelled = changes.join(known, ["doc_id", "spread"], "left")
        labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
        added = labelled.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n")).where("n <> 0")
        added.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    arriving = arrivals(spark, path, docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    changes = (
        arriving.mapInArrow(judged, JUDGED)
        .groupBy("bucket")
        .applyInPandasWithState(retract, CHANGES, "entries binary", "update", GroupStateTimeout.NoTimeout)
    )
    changes.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(f"{COUNTERS}, batch long").parquet(f"{folder}/counters").drop("batch")


ARROW = [
    ("bucket", pa.int64()), ("settled", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()),
    ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()),
]


def _steps() -> list[dict]:
    """Every step of every order: its filter's bit and the mask of the filters before it."""
    return [
        {"filter_order": "".join(o), "step": k + 1, "bit": bits[k], "before": sum(bits[:k])}
        for o in itertools.permutations(FILTERS)
        for bits in [[1 << FILTERS.index(c) for c in o]]
        for k in range(len(o))
    ]


def all_orders(counted: DataFrame) -> DataFrame:
    """The audit of every part, order and step from the counters."""
    listed = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    cells = counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    cells = cells.select("*", F.explode(listed).alias("at")).select("part", "mask", "good", "toxic", "n", "at.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) > 0
    left = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    # of all orders, the share in which the filter is the first of those that a document fails
    first = F.col("n") * 120 / F.bit_count("mask")
    return cells.groupBy("part", "filter_order", "step").agg(
        total(left & ~fails)("kept"),
        total(left & fails)("removed"),
        total(~left & fails)("redundant"),
        total(F.col("mask") == F.col("bit"))("unique_fails"),
        total(left & fails & F.col("good"))("good_lost"),
        total(left & fails & F.col("toxic"))("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, first)), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Reads the Parquet files under ``path`` (doc_id, text, lang) as a stream. A null text is empty, a null lang is the
    part ''. A null id is smaller than no other and has no labels, so its document fails E never and makes no other
    one fail. Rows that repeat text and id are documents of their own that don't fail E against each other; of rows
    with one label id, any with quality 1 or toxic 1 counts. A very long text is held by one task while it is judged.
    Ties cannot occur, extra columns are ignored, an empty table has no parts and gives an empty result.
    """
    return all_orders(counters(spark, path, labels, rules))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT d.doc_id, part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
    100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) AS fc,
    regexp_matches(d.text, '[#$%&*|]') AS fd, coalesce(d.doc_id > m.least, false) AS fe
  FROM d JOIN m ON d.text = m.text LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END)
    || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
    count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, left(filter_order, step - 1) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) AS k),
p AS (SELECT part, filter_order, step, c, n, good, toxic, fails, contains(fails, c) AS failing,
    before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM g, s),
r AS (SELECT part, filter_order, step, c,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failing AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM p GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""
