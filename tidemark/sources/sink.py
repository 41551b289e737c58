"""The event table: an append of each batch's new keys, committed by a manifest, with a bucketed index of the keys.

A batch writes its rows to a folder of its own and then commits a manifest version that names it, so a half-written batch is never
read, and a batch number that is already in is not written again. Keys of the last few batches are read from their folders; all earlier ones
are in index runs, bucketed and sorted by key, which a batch is joined to without a shuffle of the index. Runs, and small data folders, are merged
in levels: after every ``FAN`` of a level one of the next, so their number grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import EVENT_KEY, first_wins
from tidemark.operators.validation import validate_events
from tidemark.sources import manifest
from tidemark.sources.manifest import Manifest, Stale

BUCKETS = 1024  # of the key index, fixed when a table is created
FAN = 8  # batches, or runs of one level, that are merged into a run of the next
FOLDERS = 64  # data folders of one level that are merged into one of the next
FILE_ROWS = 4_000_000
MAX_ERROR_BYTES = 1024
TABLE_SCHEMA = (
    "tenant_id string, event_id string, event_type string, occurred_at timestamp, received_at timestamp, "
    "persisted_at timestamp, payload string, batch_id bigint"
)
KEY_SCHEMA = "tenant_id string, event_id string"


def committed_batches(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """Ranges of batch numbers that are in the table."""
    live = manifest.newest(spark, table)
    return list(live.batches) if live else []


def _folders(spark: SparkSession, entries, schema: str = TABLE_SCHEMA) -> DataFrame:
    paths = [e["path"] for e in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All committed rows."""
    live = manifest.newest(spark, table)
    return _folders(spark, live.data if live else ())


def quarantine_rows(bad: DataFrame) -> DataFrame:
    """The original record, byte for byte, with its error (at most 1024 bytes) and the time."""
    # the longest cut that doesn't end inside a character, which has four bytes at most
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(F.encode("error", "utf-8"), 1, MAX_ERROR_BYTES - k).cast("string")) for k in range(4)])
    return bad.select("topic", "partition", "offset", "key", "headers", "value", cut.alias("error"), F.current_timestamp().alias("failed_at"))


def _run(spark: SparkSession, run: dict, buckets: int) -> DataFrame:
    """An index run as a bucketed table; the catalog of a new session learns of it here."""
    keys = ", ".join(EVENT_KEY)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {run['name']} ({', '.join(f'{k} STRING' for k in EVENT_KEY)}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{run['path']}'"
    )
    return spark.table(run["name"])


def _write_run(spark: SparkSession, table: str, keys: DataFrame, level: int, buckets: int) -> dict:
    name = f"tidemark_keys_{uuid.uuid4().hex}"
    path = f"{table}/index/{name}"
    keys.select(*EVENT_KEY).repartition(buckets, *EVENT_KEY).write.bucketBy(buckets, *EVENT_KEY).sortBy(*EVENT_KEY).option("path", path).saveAsTable(name)
    return {"name": name, "path": path, "level": level}


def absent(rows: DataFrame, live: Manifest) -> DataFrame:
    """Rows whose key is not in the table. Index runs are read bucket by bucket as they lie; only ``rows`` and the last batches' keys are shuffled."""
    spark = rows.sparkSession
    for run in live.index:
        rows = rows.join(_run(spark, run, live.buckets), list(EVENT_KEY), "left_anti")
    late = [e for e in live.data if not e["indexed"]]
    return rows.join(_folders(spark, late, KEY_SCHEMA), list(EVENT_KEY), "left_anti") if late else rows


def write_batch(df: DataFrame, batch_id: int, table: str, quarantine: str, buckets: int = BUCKETS) -> dict:
    """Store a batch of log records once; returns rows, inserted, duplicates and quarantined.

    The quarantine is written first, then the table, so a batch that fails half way is not acknowledged and its replay starts anew. A batch
    number that is in already is not written again and has the counts of its first time. Keys stored by another batch are left alone: the
    first content stays, also when two writers hold the same key at once: the later commit looks again at what the earlier one added.
    """
    spark = df.sparkSession
    live = manifest.create(spark, table, buckets)
    noted = f"{table}/_batches/{batch_id}.json"
    if live.holds(batch_id):
        return json.loads(manifest.read_text(spark, noted))
    checked = validate_events(df, "value", kind="envelope").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = checked.agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("bad")).first()
        quarantine_rows(checked.where("NOT valid")).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        first = first_wins(checked.where("valid"), EVENT_KEY, ["partition", "offset"])
        while True:
            path = f"{table}/data/{batch_id}-{uuid.uuid4().hex}"
            inserted = 0
            if counts["rows"]:
                absent(first, live).select(
                    "tenant_id", "event_id", "event_type", "occurred_at", "received_at", F.current_timestamp().alias("persisted_at"), "payload",
                    F.lit(batch_id).cast("bigint").alias("batch_id"),
                ).write.parquet(path)
                inserted = spark.read.schema(TABLE_SCHEMA).parquet(path).count()
            result = {"batch_id": batch_id, "rows": counts["rows"], "inserted": inserted, "duplicates": counts["rows"] - inserted, "quarantined": counts["bad"]}
            entry = {"path": path, "level": 0, "rows": inserted, "indexed": False, "batch": batch_id}
            manifest.write_text(spark, noted, json.dumps(result))

            def added(m: Manifest) -> Manifest:
                if m.writes != live.writes:
                    raise Stale
                more = (entry,) if inserted else ()
                return replace(m, writes=m.writes + 1, data=(*m.data, *more), batches=m.with_batch(batch_id))

            try:
                manifest.commit(spark, table, added)
                break
            except Stale:  # another writer's batch came in between: its keys count first
                manifest.delete(spark, path)
                live = manifest.newest(spark, table)
                if live.holds(batch_id):
                    return json.loads(manifest.read_text(spark, noted))
    finally:
        checked.unpersist()
    maintain(spark, table)
    return result


def maintain(spark: SparkSession, table: str) -> None:
    """Merge what has grown to a full level. Batches committed meanwhile stay: only entries that were read are replaced."""
    live = manifest.newest(spark, table)
    late = [e for e in live.data if not e["indexed"]]
    if len(late) >= FAN:
        live = _index(spark, table, live, late)
    for level in sorted({r["level"] for r in live.index}):
        runs = [r for r in live.index if r["level"] == level]
        if len(runs) >= FAN:
            live = _merge_runs(spark, table, live, runs, level + 1)
    for level in sorted({e["level"] for e in live.data}):
        folders = [e for e in live.data if e["level"] == level and e["indexed"]]
        if len(folders) >= FOLDERS:
            live = _merge_folders(spark, table, folders, level + 1)


def _index(spark: SparkSession, table: str, live: Manifest, late: list[dict]) -> Manifest:
    run, paths = _write_run(spark, table, _folders(spark, late, KEY_SCHEMA), 1, live.buckets), {e["path"] for e in late}

    def indexed(m: Manifest) -> Manifest:  # a key that two runs hold does no harm
        return replace(m, data=tuple({**e, "indexed": e["indexed"] or e["path"] in paths} for e in m.data), index=(*m.index, run))

    return manifest.commit(spark, table, indexed)


def _merge_runs(spark: SparkSession, table: str, live: Manifest, runs: list[dict], level: int) -> Manifest:
    keys = _run(spark, runs[0], live.buckets)
    for r in runs[1:]:
        keys = keys.unionAll(_run(spark, r, live.buckets))
    merged, paths = _write_run(spark, table, keys, level, live.buckets), {r["path"] for r in runs}

    def replaced(m: Manifest) -> Manifest:
        if not paths <= {r["path"] for r in m.index}:
            raise Stale
        return m.without("index", paths, merged)

    return _replaced(spark, table, replaced)


def _merge_folders(spark: SparkSession, table: str, folders: list[dict], level: int) -> Manifest:
    rows, paths = sum(e["rows"] for e in folders), {e["path"] for e in folders}
    path = f"{table}/data/merged-{uuid.uuid4().hex}"
    sorted_rows = _folders(spark, folders).repartitionByRange(-(-rows // FILE_ROWS) or 1, *EVENT_KEY).sortWithinPartitions(*EVENT_KEY)
    sorted_rows.write.parquet(path)

    def replaced(m: Manifest) -> Manifest:
        if not paths <= {e["path"] for e in m.data}:
            raise Stale
        return m.without("data", paths, {"path": path, "level": level, "rows": rows, "indexed": True, "batch": None})

    return _replaced(spark, table, replaced)


def _replaced(spark: SparkSession, table: str, change) -> Manifest:
    """A merge that another merge came before is left out; nothing is lost by it."""
    try:
        return manifest.commit(spark, table, change)
    except Stale:
        return manifest.newest(spark, table)


def compact(spark: SparkSession, table: str) -> None:
    """Rewrite all that is live now as one sorted folder and one index run, beside streams that go on writing; what they add stays."""
    live = manifest.newest(spark, table)
    if late := [e for e in live.data if not e["indexed"]]:
        live = _index(spark, table, live, late)
    if len(live.index) > 1:
        live = _merge_runs(spark, table, live, list(live.index), 1 + max(r["level"] for r in live.index))
    if folders := [e for e in live.data if e["indexed"]]:
        _merge_folders(spark, table, folders, 1 + max(e["level"] for e in folders))


def snapshot(spark: SparkSession, table: str, target: str) -> None:
    """A copy of the rows committed now, partitioned by receipt date for pruned reads and purges."""
    rows = read_table(spark, table).drop("batch_id")
    rows.withColumn("received_date", F.to_date("received_at")).write.mode("errorifexists").partitionBy("received_date").parquet(target)
