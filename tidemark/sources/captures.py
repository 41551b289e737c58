"""Run captures as rows: JSON documents with long sample arrays, read and written piece by piece.

A capture is one JSON object. Its fields are rows (run file, path, NULL, value), its samples are rows (run file, path, index, value), where a path joins
nested field names by dots and a value is JSON text. Reading decodes one sample at a time, and writing needs the rows of a run in order, so a
run of any length takes constant memory.
"""

from __future__ import annotations

import codecs
import gzip
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.runs import SAMPLE_FIELDS
from tidemark.sources.files import known_folder, list_files, open_below, open_path

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 10_000
_DECODER = json.JSONDecoder()
_SPACE = " \t\n\r"


class _Text:
    """The unread rest of a document that comes block by block."""

    def __init__(self, blocks: Iterator[str]):
        self.blocks, self.text, self.at, self.ended = blocks, "", 0, False

    def more(self) -> bool:
        """Add a block; False at the end."""
        block = next(self.blocks, None)
        if block is None:
            self.ended = True
            return False
        self.text, self.at = self.text[self.at :] + block, 0
        return True

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> str:
        got = self.peek()
        if not got or got not in wanted:
            raise ValueError(f"malformed capture: {got!r} where one of {wanted!r} is due")
        self.at += 1
        return got

    def value(self) -> str:
        """The next whole JSON value, as text."""
        self.peek()
        while True:
            try:
                _, end = _DECODER.raw_decode(self.text, self.at)
                # a number or a word is whole once something else follows
                if self.text[end - 1] in '}]"' or self.text[end : end + 1] and self.text[end] not in ".eE+-0123456789" or self.ended or not self.more():
                    out, self.at = self.text[self.at : end], end
                    return out
            except ValueError:
                if not self.more():
                    raise ValueError("malformed capture: a value is broken or cut") from None


def capture_rows(blocks: Iterator[str], samples: Sequence[str] = SAMPLE_FIELDS) -> Iterator[tuple[str, int | None, str]]:
    """(path, index, value) of one document: objects are walked, arrays of a field in ``samples`` come element by element."""
    text, open_paths = _Text(blocks), [""]
    text.take("{")
    first = True
    while open_paths:
        if text.peek() == "}":
            text.take("}")
            open_paths.pop()
            first = False
            continue
        if not first:
            text.take(",")
        first = False
        if text.peek() != '"':
            raise ValueError("malformed capture: a field name is due")
        name = json.loads(text.value())
        text.take(":")
        path, kind = open_paths[-1] + name, text.peek()
        if kind == "{":
            text.take("{")
            open_paths.append(f"{path}.")
            first = True
        elif kind == "[" and name in samples:
            text.take("[")
            if text.peek() == "]":
                text.take("]")
                continue
            index = 0
            while True:
                yield path, index, text.value()
                index += 1
                if text.take(",]") == "]":
                    break
        else:
            yield path, None, text.value()
    if text.peek():
        raise ValueError("malformed capture: more than one document")


def _blocks(path: str, base: str | None = None) -> Iterator[str]:
    fs, place = open_path(path) if base is None else open_below(base, path)
    decoder = codecs.getincrementaldecoder("utf-8")()
    with fs.open_input_stream(place, compression="gzip" if path.endswith(".gz") else None) as f:
        while block := f.read(BLOCK_BYTES):
            yield decoder.decode(block)
        decoder.decode(b"", True)


def read_capture_rows(spark: SparkSession, path: str, samples: Sequence[str] = SAMPLE_FIELDS) -> DataFrame:
    """(file, path, index, value) of all captures below a folder, plain or gzip; a malformed one fails the read.

    ``file`` is the name without its endings. A file is one task's work, so spread a long study over files, and very many files over folders.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            for place in pdf["path"]:
                file = place.rsplit("/", 1)[-1].split(".", 1)[0]
                for row in capture_rows(_blocks(place, base), samples):
                    held.append((file, *row))
                    if len(held) == BATCH_ROWS:
                        yield _frame(held)
                        held = []
        yield _frame(held)

    base = path if known_folder(path) else None
    if base is not None:
        files = list_files(spark, path).where("length > 0").select("path")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(read, "file string, path string, index bigint, value string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "path", "index", "value"]).astype({"index": "Int64"})


def strip_sample_rows(rows: DataFrame) -> DataFrame:
    """Captures without raw samples: the rows of their fields."""
    return rows.where(F.col("index").isNull())


def write_captures(rows: DataFrame, base: str) -> int:
    """One gzip JSON document for each ``file``, from (file, path, index, value); returns how many. Samples stand in index order, fields by path.

    A run's rows are sorted by Spark and written as they come, so the longest run needs no more memory than the shortest. Gzip times are zero.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, file, path, n = None, None, (), 0

        def close() -> None:
            """What ends the open array, objects and file."""
            out.write(b"]" * out.in_array + b"}" * len(path))
            out.close()
            out.sink.close()

        for pdf in batches:
            for name, where, index, value in zip(pdf["file"], pdf["path"], pdf["index"], pdf["value"], strict=True):
                parts, sample = tuple(where.split(".")), not pd.isna(index)
                if name != file:
                    if out is not None:
                        close()
                    fs, place = open_path(f"{base}/{name}.json.gz")
                    fs.create_dir(place.rsplit("/", 1)[0])
                    sink = fs.open_output_stream(place, compression=None)
                    out = gzip.GzipFile(filename="", mode="wb", fileobj=sink, mtime=0)
                    out.sink, out.in_array = sink, False
                    file, path, n = name, (), n + 1
                if out.in_array and parts == path:
                    out.write(b"," + value.encode())
                    continue
                out.write(b"]" * out.in_array)
                same = 0
                while same < min(len(parts), len(path)) - 1 and parts[same] == path[same]:
                    same += 1
                opening = "{" if not path else "}" * (len(path) - 1 - same) + ","
                for part in parts[same:-1]:
                    opening += json.dumps(part) + ":{"
                out.write(f"{opening}{json.dumps(parts[-1])}:{'[' if sample else ''}{value}".encode())
                out.in_array, path = sample, parts
        if out is not None:
            close()
        yield pd.DataFrame({"n": [n]})

    ordered = rows.select("file", "path", "index", "value").repartition("file").sortWithinPartitions("file", F.split("path", r"\."), "index")
    return ordered.mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
