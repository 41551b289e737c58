"""Readers: raw requests, the ordered log, captures, file inventories and scraped metrics."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE_BYTES = 64 << 20  # files up to this size are read as one value
BLOCK_BYTES = 4 << 20  # of a longer file that is held at once

LOG_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
    T.StructField("value", T.BinaryType()),
])


def read_log(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 16, kafka: dict | None = None) -> DataFrame:
    """The ordered log from parquet files, or from Kafka when its options are given.

    As a stream it starts at the earliest record and takes a bounded number of
    files (or offsets) at a time. Files must arrive in offset order.
    """
    if kafka is not None:
        reader = spark.readStream if streaming else spark.read
        options = {"startingOffsets": "earliest", "includeHeaders": "true", **kafka}
        cols = [f.name for f in LOG_SCHEMA.fields]
        return reader.format("kafka").options(**options).load().select(*cols)
    if streaming:
        return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def read_requests(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Raw documents as bytes (path, raw): one per line, or one per file."""
    if whole_files:
        files = spark.read.format("binaryFile").load(path)
        return files.select("path", F.col("content").alias("raw"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))


def read_captures(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON captures, plain or gzip, with a fixed schema; a malformed document fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


class Unpacked:
    """Bytes in all members of a gzip file that comes block by block; -1 if it is damaged or cut. Holds one block of output at a time."""

    def __init__(self, step: int = 1 << 20):
        self.size, self.step, self.member = 0, step, None

    def add(self, data: bytes) -> None:
        while data and self.size >= 0:
            self.member = self.member or zlib.decompressobj(31)
            try:
                self.size += len(self.member.decompress(data, self.step))
            except zlib.error:
                self.size = -1
                return
            data = self.member.unconsumed_tail
            if self.member.eof:
                data, self.member = self.member.unused_data, None

    def total(self) -> int:
        return self.size if self.member is None else -1


def _unpacked(data: bytes) -> int:
    out = Unpacked()
    out.add(data)
    return out.total()


def _read(path: str, blocks: Iterator[bytes]) -> tuple[int, str, bool, int]:
    """(size, sha256, gzip_time_zero, raw_bytes) of a file that comes block by block."""
    size, sha, head, raw = 0, hashlib.sha256(), b"", Unpacked() if path.endswith(".gz") else None
    for block in blocks:
        size += len(block)
        sha.update(block)
        head = head if len(head) >= 8 else (head + block)[:8]
        if raw is not None:
            raw.add(block)
    return size, sha.hexdigest(), head[4:8] == bytes(4), raw.total() if raw is not None else size


_FILE = "path string, size bigint, sha256 string, gzip_time_zero boolean, raw_bytes bigint"


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, *_read(p, iter((bytes(c),)))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
        yield pd.DataFrame(rows, columns=["path", "size", "sha256", "gzip_time_zero", "raw_bytes"])


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def open_below(base: str, name: str) -> tuple[pafs.FileSystem, str]:
    """``open_path`` of a name below a path or URI, where the name is not encoded."""
    fs, place = open_path(base)
    return fs, f"{place.rstrip('/')}/{name}"


def _in_blocks(base: str | None = None):
    """Reads paths below ``base``, or whole ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                fs, place = open_path(path) if base is None else open_below(base, path)
                with fs.open_input_stream(place, compression=None) as f:
                    rows.append((path, *_read(path, iter(lambda: f.read(BLOCK_BYTES), b""))))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "gzip_time_zero", "raw_bytes"])

    return run


_LISTED = "path string, length bigint, folder boolean"


def _hidden(name: str) -> bool:
    """Names that Spark's listing passes by."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def known_folder(path: str) -> bool:
    """Whether ``path`` is a folder of a store that ``pyarrow.fs`` knows, so that tasks can list it."""
    try:
        fs, place = open_path(path)
        return fs.get_file_info(place).type == pafs.FileType.Directory
    except (ValueError, OSError, NotImplementedError):
        return False


def list_files(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(path, length) of every file below a folder for which ``known_folder`` holds, paths relative to it, dealt over ``parts``.

    A task lists the folder itself, others what is below its folders, so a study of millions of files never passes the driver, and its files are dealt by
    number, not by a size that small files pretend to.
    """
    parts = parts or 4 * spark.sparkContext.defaultParallelism

    def listed(deep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, top = open_path(path.rstrip("/"))
            skip = len(top.rstrip("/")) + 1
            for pdf in batches:
                yield pdf[~pdf["folder"]]
                open_folders = [f"{top}/{name}".rstrip("/") for name in pdf["path"][pdf["folder"]]]
                while open_folders:
                    found = [i for i in fs.get_file_info(pafs.FileSelector(open_folders.pop())) if not _hidden(i.base_name)]
                    rows = [(i.path[skip:], i.size, False) for i in found if i.type == pafs.FileType.File]
                    below = [i.path for i in found if i.type == pafs.FileType.Directory]
                    if deep:
                        open_folders += below
                    else:
                        rows += [(p[skip:], 0, True) for p in below]
                    for at in range(0, len(rows), 10_000):
                        yield pd.DataFrame(rows[at : at + 10_000], columns=["path", "length", "folder"])

        return run

    top = spark.range(1, numPartitions=1).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("length"), F.lit(True).alias("folder"))
    first = top.mapInPandas(listed(False), _LISTED)
    return first.repartition(parts).mapInPandas(listed(True), _LISTED).select("path", "length").repartition(parts)


def file_inventory(spark: SparkSession, path: str, raw_sizes: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, size, sha256, gzip_time_zero[, raw_bytes]) of every file below a folder, paths relative to it.

    Every file is read to its end. Where ``pyarrow.fs`` knows the store, tasks list the folder and read files of any length block by block in constant
    memory. From other stores that Spark reads, files of up to ``whole_bytes`` come as one value each.
    """
    base = path.rstrip("/")
    plain = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")

    def relative(paths: DataFrame) -> DataFrame:
        name = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?", "")
        return paths.withColumn("path", F.substring(name, F.lit(len(plain) + 2), F.length(name)))

    if known_folder(base):
        read = list_files(spark, base).select("path").mapInPandas(_in_blocks(base), _FILE)
        return read if raw_sizes else read.drop("raw_bytes")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    read = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(_whole, _FILE)
    long = files.where(F.col("length") > whole_bytes).select("path").repartition(F.col("path")).mapInPandas(_in_blocks(), _FILE)
    # Spark lists empty files, but passes them by when it reads
    listed = relative(spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string"))
    empty = listed.join(relative(files.select("path")), "path", "left_anti").select(
        "path", F.lit(0).cast("bigint"), F.lit(hashlib.sha256().hexdigest()), F.lit(False), F.lit(0).cast("bigint")
    )
    out = relative(read.unionAll(long)).unionAll(empty)
    return out if raw_sizes else out.drop("raw_bytes")


# Allowed metric families below the application's prefix, and label rules.
METRIC_FAMILIES = r"(db_pool_[a-z0-9_]*|producer_[a-z0-9_]*|process_[a-z0-9_]*|api_connection_limit|publish_failures_total|stored_total)"
METRIC_REASONS = r"timeout|buffer_saturated|broker_error"


def metric_samples(lines: DataFrame, prefix: str, text: str = "value", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(metric, labels, value, status) from scraped lines; only allow-listed families and labels pass.

    An infinite value is ``unlimited`` with no number.
    """
    line = F.col(text)
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    parts = lines.select(
        *keep, F.regexp_extract(line, pattern, 1).alias("metric"), F.regexp_extract(line, pattern, 2).alias("raw"),
        F.regexp_extract(line, pattern, 3).alias("number"),
    )
    ok = (F.col("metric").rlike(f"^{prefix}{METRIC_FAMILIES}$")) & F.col("raw").rlike(
        rf'^$|^(,?(reason="({METRIC_REASONS})"|resource="process_[^"]*"))+$'
    )
    unlimited = F.col("number").rlike(r"^\+?Inf$")
    return parts.where(ok).select(
        *keep, "metric", F.replace(F.col("raw"), F.lit('"'), F.lit("")).alias("labels"),
        F.when(~unlimited, F.col("number").try_cast("double")).alias("value"),
        F.when(unlimited, "unlimited").otherwise("number").alias("status"),
    )


def read_metrics_text(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return metric_samples(spark.read.text(path), prefix)
