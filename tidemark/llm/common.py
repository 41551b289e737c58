"""What the operators of this package share: scratch tables and reading of the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.session import scratch_dir, ship_package

SMALL_ROWS = 500_000  # a table of at most so many narrow rows may be broadcast
PROBES = 2  # bits of a hash in a bit set
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost executor repeats little."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_schema(df: DataFrame, more: str) -> StructType:
    """The struct column ``row`` of ``df``, whatever its fields are called, then the columns that ``more`` declares."""
    return StructType([df.schema["row"], *StructType.fromDDL(more).fields])


def prepared(df: DataFrame) -> SparkSession:
    ship_package(df.sparkSession)
    return df.sparkSession


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str | list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no run of equal keys is split; each table holds whole runs only."""
    keys = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            column = batch.column(batch.schema.get_field_index(k))
            same &= np.asarray(column.is_null() if not v.is_valid else pa.compute.fill_null(pa.compute.equal(column, v), False))
        start = int(batch.num_rows - same[::-1].argmin()) if not same.all() else 0
        if same.all():
            if held and not all(h.column(k)[h.num_rows - 1] == v for h in held[-1:] for k, v in zip(keys, last)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _bits(h: np.ndarray, probes: int, size: int) -> list[np.ndarray]:
    """Places of a hash in a bit set of ``size``, a power of two."""
    return [(h >> np.uint64(17 * k)) & np.uint64(size - 1) for k in range(probes)]


def in_bit_set(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set: all that are, and few others."""
    found = np.ones(len(h), bool)
    for place in _bits(h, PROBES, 64 * len(known)):
        found &= (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def bit_set(hashes: DataFrame) -> np.ndarray:
    """A set of at most ``MAX_BITS`` bits with the bits of all hashes ``h``, made by Spark in words of 64 bits."""
    size = MIN_BITS
    n = hashes.count()
    while size < MAX_BITS and size < 16 * n:
        size *= 2
    places = ", ".join(f"shiftrightunsigned(h, {17 * k}) & {size - 1}L" for k in range(PROBES))
    bits = hashes.selectExpr(f"explode(array({places})) AS bit").groupBy(F.expr("shiftright(bit, 6)").alias("word"))
    got = bits.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()  # no more rows than the set has words
    known = np.zeros(size // 64, np.uint64)
    known[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return known
