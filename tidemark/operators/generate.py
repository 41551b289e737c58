"""Deterministic datasets: identities, payloads and exact duplicates, one row at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids

# Bytes around the payload's data, the first instant, limits and names.
PAYLOAD_FRAME_BYTES = 11
FIRST_INSTANT = "2026-01-01 00:00:00"
MAX_PAYLOAD_BYTES = 262144 - 2048
MIN_PAYLOAD_BYTES = 16
DEFAULT_TYPE = "checkout_event"
TYPE_PREFIX = "bench_"
TENANT = "benchmark"


def identity_name(namespace: str, seed: Column, index: Column) -> Column:
    head = F.lit(namespace + "/") if namespace else F.lit("")
    return F.concat(head, seed.cast("string"), F.lit("/"), index.cast("string"))


def id_universe(spark: SparkSession, namespace: str, seed: int, n: int) -> DataFrame:
    """(position, event_id) of every identity of a namespace and seed."""
    r = spark.range(n).withColumnRenamed("id", "position")
    return r.select("position", ids.uuid5(identity_name(namespace, F.lit(seed), F.col("position"))).alias("event_id"))


def duplicate_source(row: Column, unique: Column) -> Column:
    """The index whose content a row carries: its own, or for the rows after the unique ones an earlier one."""
    return F.when(row < unique, row).otherwise(F.pmod(row - unique, unique))


@dataclass(frozen=True)
class DatasetSpec:
    count: int
    payload_bytes: int
    seed: int = 0
    namespace: str = ""
    payload_profile: str = "fixed"
    duplicate_fraction: float = 0.0

    def unique(self) -> int:
        return self.count - int(self.count * self.duplicate_fraction)

    def check(self) -> None:
        fraction = self.duplicate_fraction
        if self.count <= 0 or len(self.namespace) > 256 or self.payload_profile not in ("", "fixed", "varied"):
            raise ValueError("invalid count, namespace or payload profile")
        if not MIN_PAYLOAD_BYTES <= self.payload_bytes <= MAX_PAYLOAD_BYTES or not 0 <= fraction < 1:
            raise ValueError("invalid payload size or duplicate fraction")


def event_content(index: Column, spec: DatasetSpec) -> dict[str, Column]:
    """Columns of the event at an index: identity, type, time and a payload of exactly the asked size."""
    size = spec.payload_bytes - PAYLOAD_FRAME_BYTES
    name = identity_name(spec.namespace, F.lit(spec.seed), index)
    if spec.payload_profile == "varied":
        data = ids.varied_text(F.concat(F.lit(f"{spec.namespace}/{spec.seed}/"), index.cast("string")), size)
    else:
        mark = ids.hex_low(F.lit(spec.seed).cast("bigint").bitwiseXOR(index.cast("bigint")))
        data = F.when(F.length(mark) <= size, F.rpad(mark, size, "x")).otherwise(F.repeat(F.lit("x"), F.lit(size)))
    kind = F.lit(DEFAULT_TYPE)
    if spec.namespace:
        kind = F.concat(F.lit(TYPE_PREFIX), F.substring(F.sha2(F.lit(spec.namespace), 256), 1, 16))
    start = F.unix_micros(F.lit(FIRST_INSTANT).cast("timestamp"))
    return {
        "event_id": ids.uuid5(name),
        "event_type": kind,
        "occurred_at": F.timestamp_micros(start + index),
        "payload": F.concat(F.lit('{"data":"'), data, F.lit('"}')),
        "tenant_id": F.lit(TENANT),
        "received_at": F.lit(FIRST_INSTANT).cast("timestamp"),
    }


def event_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """``count`` submissions in order; the last share repeats earlier ones byte for byte."""
    spec.check()
    index = duplicate_source(F.col("position"), F.lit(spec.unique()))
    rows = spark.range(spec.count).withColumnRenamed("id", "position").withColumn("index", index)
    return rows.select("position", *[c.alias(n) for n, c in event_content(F.col("index"), spec).items()])


def decode_population(population: DataFrame, universe: DataFrame) -> DataFrame:
    """(run_id, set_name, position, event_id, valid) from index sets plus extra IDs.

    ``population`` has (run_id, set_name, indices array, extra array); ``universe``
    has (run_id, index, event_id). Extras follow the indices. An index outside the
    universe keeps its row with ``valid`` false.
    """
    listed = population.select("run_id", "set_name", F.posexplode("indices").alias("position", "index"))
    extras = population.select("run_id", "set_name", F.posexplode("extra").alias("position", "event_id"))
    return decode_rows(listed, extras, universe)


def decode_rows(listed: DataFrame, extras: DataFrame, universe: DataFrame) -> DataFrame:
    """``decode_population`` of sets that are rows: (run_id, set_name, position, index) and extras (run_id, set_name, position, event_id)."""
    known = listed.join(universe, ["run_id", "index"], "left").select(
        "run_id", "set_name", F.col("position").cast("bigint").alias("position"), "event_id", F.col("event_id").isNotNull().alias("valid")
    )
    bases = listed.groupBy("run_id", "set_name").agg(F.count(F.lit(1)).alias("base"))
    behind = extras.join(bases, ["run_id", "set_name"], "left")
    return known.unionByName(behind.select(
        "run_id", "set_name", (F.coalesce("base", F.lit(0)) + F.col("position")).cast("bigint").alias("position"), "event_id", F.lit(True).alias("valid")
    ))
