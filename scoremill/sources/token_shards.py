"""Sharded token files: a data source that writes and reads flat binary shards with an index and a manifest.

A shard is a ``.bin`` file of unsigned little-endian integers, the tokens of its documents one after the other, and a
``.idx.parquet`` file beside it with a row per document: id, first token and number of tokens. Tasks write both under
names of their own. The manifest lists the shards of every commit; it is written in one step when all tasks are done,
and readers see only what manifests list. A task or job that fails leaves no shard in a manifest, and what it had
written is removed. Only file names and totals pass through the driver.

    spark.dataSource.register(TokenShards)
    tokens.write.format("token_shards").option("path", folder).option("most", 4_000_000_000).mode("append").save()
    spark.read.format("token_shards").option("path", folder).load()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "doc_id long, tokens array<int>"
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
KINDS = {"uint16": "<u2", "uint32": "<u4"}
MANIFESTS = "_manifests"
ROWS = 1000  # documents read at a time


def _files(path: str):
    """Filesystem and plain path of a path or URI that the driver and all executors can reach."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in path and not path.startswith("file:"):
        return LocalFileSystem(), path
    return FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])


@dataclass
class Written(WriterCommitMessage):
    """Shards of a task: name, documents, tokens."""

    shards: list = field(default_factory=list)


@dataclass
class Shard(InputPartition):
    name: str
    kind: str


class _Open:
    """A shard while it is written."""

    def __init__(self, fs, folder: str, name: str, kind: str):
        self.name, self.kind, self.tokens, self.docs = name, kind, 0, 0
        self._bin = fs.open_output_stream(f"{folder}/{name}.bin")
        self._index = pq.ParquetWriter(f"{folder}/{name}.idx.parquet", INDEX, filesystem=fs)

    def add(self, ids: pa.Array, values: np.ndarray, lengths: np.ndarray) -> None:
        first = self.tokens + np.cumsum(lengths) - lengths
        self._bin.write(values.astype(self.kind).tobytes())
        self._index.write_table(pa.table([ids, pa.array(first), pa.array(lengths)], schema=INDEX))
        self.tokens += len(values)
        self.docs += len(lengths)

    def close(self) -> dict:
        self._bin.close()
        self._index.close()
        return {"name": self.name, "docs": self.docs, "tokens": self.tokens}


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = options["path"].rstrip("/"), options.get("dtype", "uint32")
        self.most, self.overwrite, self.job = int(options.get("most", 1 << 30)), overwrite, uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"dtype is one of {sorted(KINDS)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task's shards: a new one begins where the next document would bring it over the size, never within one."""
        from pyspark import TaskContext

        fs, folder = _files(self.path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        done, open_ = [], None
        top = np.iinfo(KINDS[self.kind]).max
        for batch in iterator:
            ids, lists = batch.column("doc_id"), batch.column("tokens")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() > top):
                raise ValueError(f"a token does not fit {self.kind}")
            ends = np.cumsum(lengths)
            low = 0
            while low < len(lengths):
                if open_ is None:
                    open_ = _Open(fs, folder, f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}", KINDS[self.kind])
                before = ends[low] - lengths[low]
                high = int(np.searchsorted(ends, before + self.most - open_.tokens, "right"))
                if high <= low and open_.docs:
                    done.append(open_.close())
                    open_ = None
                    continue
                high = max(high, low + 1)
                open_.add(ids[low:high], values[before : ends[high - 1]], lengths[low:high])
                low = high
        if open_ is not None:
            done.append(open_.close())
        return Written(done)

    def commit(self, messages: list) -> None:
        """Make all shards visible at once: the manifest is written under another name and renamed."""
        fs, folder = _files(self.path)
        manifests = f"{folder}/{MANIFESTS}"
        fs.create_dir(manifests, recursive=True)
        older = _manifests(fs, folder) if self.overwrite else []
        shards = [s for m in messages if m is not None for s in m.shards]
        with fs.open_output_stream(f"{manifests}/.{self.job}") as out:
            out.write(json.dumps({"dtype": self.kind, "replaces": older, "shards": shards}).encode())
        fs.move(f"{manifests}/.{self.job}", f"{manifests}/{self.job}.json")

    def abort(self, messages: list) -> None:
        """Remove what tasks of this job have written, whether they got to their end or not."""
        from pyarrow.fs import FileSelector

        fs, folder = _files(self.path)
        for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(self.job):
                fs.delete_file(info.path)


def _manifests(fs, folder: str) -> list[str]:
    from pyarrow.fs import FileSelector

    infos = fs.get_file_info(FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True))
    return sorted(i.base_name for i in infos if i.base_name.endswith(".json"))


def listed(path: str) -> list[dict]:
    """Visible shards: name, dtype, docs, tokens. Those of a replaced manifest are not visible."""
    fs, folder = _files(path.rstrip("/"))
    found = {}
    for name in _manifests(fs, folder):
        with fs.open_input_stream(f"{folder}/{MANIFESTS}/{name}") as stream:
            found[name] = json.loads(stream.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return [s | {"dtype": m["dtype"]} for name, m in found.items() if name not in gone for s in m["shards"]]


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[Shard]:
        return [Shard(s["name"], s["dtype"]) for s in listed(self.path)] or [Shard("", "uint32")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        """Documents of a shard in order; the file is read piece by piece."""
        if not partition.name:
            return
        fs, folder = _files(self.path)
        kind = np.dtype(KINDS[partition.kind])
        index = pq.ParquetFile(fs.open_input_file(f"{folder}/{partition.name}.idx.parquet"))
        with fs.open_input_stream(f"{folder}/{partition.name}.bin") as stream:
            for rows in index.iter_batches(ROWS):
                lengths = rows.column("n").to_numpy()
                values = np.frombuffer(stream.read(int(lengths.sum()) * kind.itemsize), kind)
                starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                lists = pa.ListArray.from_arrays(starts, pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "tokens"])


class TokenShards(DataSource):
    """Options: path (a folder all executors reach), most (tokens of a shard), dtype (uint16 or uint32)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), overwrite)


def write(tokens, path: str, most: int, dtype: str = "uint32", mode: str = "append") -> None:
    """Write (doc_id, tokens) as shards of at most ``most`` tokens, or one document.

    A null list is a document without tokens; tokens that ``dtype`` cannot hold fail the job. Rows go to shards as the
    frame's partitions hold them; sort or range-partition it first to fix their order.
    """
    tokens.sparkSession.dataSource.register(TokenShards)
    chosen = tokens.selectExpr("cast(doc_id as long) AS doc_id", "cast(tokens as array<int>) AS tokens")
    chosen.write.format("token_shards").option("path", path).option("most", str(most)).option("dtype", dtype).mode(mode).save()


def read(spark, path: str):
    """All visible documents of a folder of shards."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").option("path", path).load()
