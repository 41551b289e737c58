"""Two data sources in plain Python: the event table as a stream of its committed rows, and the log as a sink that publishes a batch once.

Both reach files through ``pyarrow.fs``, which knows local, HDFS and object store paths, and hold nothing but lists of files on the driver.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.files import open_path

FEED, PUBLISH = "tidemark_table", "tidemark_log"
FEED_SCHEMA = (
    "tenant_id string, event_id string, event_type string, occurred_at timestamp, received_at timestamp, "
    "persisted_at timestamp, payload string, batch_id bigint"
)
MAX_VALUE = 262_144 + 4_096  # bytes of an envelope


def _files(fs: pafs.FileSystem, folder: str, ending: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(ending) and not posixpath.basename(f.path).startswith(("_", ".")))


def _json(fs: pafs.FileSystem, path: str) -> dict | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return json.loads(f.read())


@dataclass
class FilePart(InputPartition):
    path: str


class TableFeed(DataSource):
    """The event table's rows, batch by batch in the order of their commits; rows are those of committed batches only.

    Options: ``path``, and ``until``, the last version to read (default: the newest). A stream starts with what the oldest kept version holds.
    """

    @classmethod
    def name(cls) -> str:
        return FEED

    def schema(self) -> str:
        return FEED_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FeedReader(self.options["path"], self.options.get("until"))


class _FeedReader(DataSourceStreamReader):
    def __init__(self, table: str, until: str | None):
        self.table, self.until = table, None if until is None else int(until)

    def _version(self, number: int) -> dict | None:
        fs, root = open_path(self.table)
        return _json(fs, f"{root}/_manifest/{number:012d}.json")

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        fs, root = open_path(self.table)
        hint = f"{root}/_manifest/newest"
        at = 0
        if fs.get_file_info(hint).type == pafs.FileType.File:
            with fs.open_input_file(hint) as f:
                at = int(f.read())
        while self._version(at + 1) is not None:
            at += 1
        return {"version": at if self.until is None else min(at, self.until)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, _ = open_path(self.table)
        first, last = start["version"], end["version"]
        if first < 0:  # all that the first kept version holds, merged or not
            first = (self._version(last) or {}).get("oldest", 0)
            seen = {e["path"]: e for e in (self._version(first) or {"data": []})["data"]}
            new = list(seen.values())
        else:
            seen, new = {e["path"]: e for e in self._version(first)["data"]}, []
        for number in range(first + 1, last + 1):  # versions since then; merged folders repeat rows and are left out
            for e in self._version(number)["data"]:
                if e["path"] not in seen and e["level"] == 0:
                    new.append(e)
                seen[e["path"]] = e
        return [FilePart(f) for e in new for f in _files(fs, open_path(e["path"])[1], ".parquet")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.table)
        us = pa.timestamp("us", tz="UTC")
        want = pa.schema([(n, pa.string()) for n in ("tenant_id", "event_id", "event_type")] + [(n, us) for n in ("occurred_at", "received_at", "persisted_at")]
                         + [("payload", pa.string()), ("batch_id", pa.int64())])
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(10_000, columns=want.names):
                columns = []
                for name, kind in zip(want.names, want.types, strict=True):
                    column = batch.column(name)
                    if pa.types.is_timestamp(kind) and column.type != kind:
                        column = column.cast(pa.timestamp("us")).cast(kind) if column.type.tz is None else column.cast(kind)
                    columns.append(column.cast(kind))
                yield pa.RecordBatch.from_arrays(columns, schema=want)


def table_stream(spark: SparkSession, table: str, until: int | None = None) -> DataFrame:
    """The table's committed rows as a stream."""
    spark.dataSource.register(TableFeed)
    reader = spark.readStream.format(FEED).option("path", table)
    return (reader if until is None else reader.option("until", until)).load()


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: a file and its number of records, or nothing."""

    files: list = field(default_factory=list)
    records: int = 0


_RECORD = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("position", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])


class LogSink(DataSource):
    """Publishes (key, value) records to a log in two phases: tasks stage files, and one small commit file names those that count.

    Options: ``path``; ``topic``; ``writer``, the name under which batches are counted (for a stream: one per query); ``max_bytes`` of a value, above which
    a batch is refused whole, as the reference rule for a request is. A batch number that this writer has committed is not published again.
    """

    @classmethod
    def name(cls) -> str:
        return PUBLISH

    def schema(self) -> str:
        return "key binary, value binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _LogWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _LogStreamWriter(dict(self.options))


class _Stage:
    """Both writers: staging in tasks, commit and abort on the driver."""

    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options.get("topic", "log")
        self.name = options.get("writer") or uuid.uuid4().hex
        self.max_bytes = int(options.get("max_bytes", MAX_VALUE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = open_path(self.path)
        part = TaskContext.get().partitionId()
        fs.create_dir(f"{root}/records")
        path, out, n = f"{root}/records/{self.name}-{part}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                key, value = (batch.column(batch.schema.get_field_index(c)).cast(pa.binary()) for c in ("key", "value"))
                longest = pa.compute.max(pa.compute.binary_length(value)).as_py() or 0
                if longest > self.max_bytes:
                    raise ValueError(f"too_large: a record of {longest} bytes, {self.max_bytes} are allowed")
                out = out or pq.ParquetWriter(fs.open_output_stream(path), _RECORD)
                columns = [pa.array([self.topic] * batch.num_rows), pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(n, n + batch.num_rows)), key, value]
                out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_RECORD))
                n += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(path)
            raise
        if out is not None:
            out.close()
        return Staged([path] if n else [], n)

    def _commit(self, messages: list, batch: int) -> None:
        fs, root = open_path(self.path)
        folder, done = f"{root}/commits", f"{root}/commits/{self.name}-{batch:012d}.json"
        files = [f for m in messages if m for f in m.files]
        if _json(fs, done) is not None:  # published before a crash; what was staged again does not count
            for f in files:
                fs.delete_file(f)
            return
        fs.create_dir(folder)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps({"writer": self.name, "batch": batch, "records": sum(m.records for m in messages if m), "files": files}).encode())
        fs.move(aside, done)

    def _abort(self, messages: list) -> None:
        fs, _ = open_path(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f)


class _LogWriter(_Stage, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, 0)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _LogStreamWriter(_Stage, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


def _records(envelopes: DataFrame) -> DataFrame:
    envelopes.sparkSession.dataSource.register(LogSink)
    return envelopes.select("key", "value")


def publish(envelopes: DataFrame, path: str, topic: str = "log", writer: str | None = None, max_bytes: int = MAX_VALUE) -> None:
    """Publish all records or none; under the name of a ``writer`` at most once."""
    out = _records(envelopes).write.format(PUBLISH).mode("append").option("path", path).option("topic", topic).option("max_bytes", max_bytes)
    (out if writer is None else out.option("writer", writer)).save()


def publish_stream(envelopes: DataFrame, path: str, checkpoint: str, writer: str, topic: str = "log", max_bytes: int = MAX_VALUE, trigger: dict | None = None):
    """Publish every micro-batch once, also when it is written again after a crash."""
    out = _records(envelopes).writeStream.format(PUBLISH).option("path", path).option("topic", topic).option("writer", writer).option("max_bytes", max_bytes)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """(writer, batch, topic, partition, position, key, value) of all committed records; staged files that no commit names are not read."""
    fs, root = open_path(path)
    commits = _files(fs, f"{root}/commits", ".json")
    schema = "topic string, partition int, position bigint, key binary, value binary"
    if not commits:
        return spark.createDataFrame([], f"writer string, batch bigint, {schema}")
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    named = spark.read.schema("writer string, batch bigint, files array<string>").json([f"{scheme}{c}" for c in commits]).selectExpr("writer", "batch", "explode(files) AS file")
    found = [r.file for r in named.select("file").collect()]  # one row for each task of each batch
    if not found:
        return spark.createDataFrame([], f"writer string, batch bigint, {schema}")
    rows = spark.read.schema(schema).parquet(*(f"{scheme}{f}" for f in found)).selectExpr("*", "element_at(split(_metadata.file_path, '/'), -1) AS name")
    named = named.selectExpr("writer", "batch", "element_at(split(file, '/'), -1) AS name")
    return rows.join(named, "name").select("writer", "batch", "topic", "partition", "position", "key", "value")
