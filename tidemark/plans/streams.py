"""Streams run to the end of their input, and file sources and sinks, as queries."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators.validation import encode_envelopes
from tidemark.plans.catalog import query
from tidemark.plans.delivery import STORED
from tidemark.plans.reports import ALERT_SQL, BUCKET_SQL, COOLDOWN, alert_operations, bucket_requests
from tidemark.session import ROCKSDB_PROVIDER, scratch_dir
from tidemark.sources import export, feed, files, manifest, sink
from tidemark.streaming import ingest, stateful

MICRO_BATCHES = 4  # that a stream over derived input must run at least, so that its state is carried
FILE_RECORDS = 100_000  # of a log file
INDEX_BUCKETS = 8  # a table with its own number of index buckets: these are small

UUID_SQL = "concat(lpad(CAST(event_id AS STRING), 8, '0'), '-0000-4000-8000-000000000001')"


def uuid_of(c="event_id"):
    return F.concat(F.lpad(F.col(c).cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000001"))


def log_records(t):
    """The delivery log in its stored shape, envelope documents as values, poison as plain text."""
    value = F.concat(
        F.lit('{"event_id":"'), uuid_of(), F.lit('","event_type":"'), F.col("event_type"), F.lit('","occurred_at":"'),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","payload":'), F.col("payload"), F.lit(',"tenant_id":"'), F.col("tenant_id"),
        F.lit('","received_at":"'), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}'),
    )
    return t.v_log.select(
        "attempt", F.lit("lake.events").alias("topic"), F.col("part").cast("int").alias("partition"), F.col("off").alias("offset"),
        F.concat_ws(":", "tenant_id", uuid_of()).cast("binary").alias("key"),
        F.array(F.struct(F.lit("source").alias("key"), F.lit("test").cast("binary").alias("value"))).alias("headers"),
        F.when(F.col("valid"), value).otherwise("not-json").cast("binary").alias("value"),
    )


def log_files(t):
    """Files of each delivery: four, or as many as hold ``FILE_RECORDS`` each, so that a micro-batch keeps every core busy."""
    return t.once("log_files", lambda: max(4, 2 * -(-t.events.count() // (2 * FILE_RECORDS))))


def log_folder(t):
    """Log files in arrival order: first deliveries, then the replays."""
    def write():
        path = scratch_dir(t.spark, "log")
        for attempt in (0, 1):
            log_records(t).where(f"attempt = {attempt}").drop("attempt").repartition(log_files(t)).write.mode("append").parquet(path)
        return path

    return t.once("log_folder", write)


def log_stream(t):
    """The log in four micro-batches, whatever its size."""
    return files.read_log(t.spark, log_folder(t), streaming=True, max_files=log_files(t) // 2)


def at_least(batches, query):
    """Wait for a stream that drains its input and check that it took it in several micro-batches."""
    query.awaitTermination()
    ran = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    if ran < batches:
        raise RuntimeError(f"{ran} micro-batches, {batches} are asked for")


def ingested(t):
    """(table, quarantine, metrics) after the stream has read the whole log, some files at a time."""
    def run():
        base = scratch_dir(t.spark, "ingest")
        paths = [f"{base}/{n}" for n in ("table", "quarantine", "metrics", "checkpoint")]
        source = log_stream(t)
        at_least(MICRO_BATCHES, ingest.start_ingest(t.spark, source, paths[0], paths[1], paths[3], metrics=paths[2], buckets=INDEX_BUCKETS))
        return paths

    return t.once("ingested", run)


STREAMED = STORED + f""" SELECT tenant_id, {UUID_SQL} AS event_id, event_type, occurred_at, payload FROM stored"""


@query("t1_ingest_stream", "WITH " + STREAMED)
def _(t):
    return sink.read_table(t.spark, ingested(t)[0]).select(
        "tenant_id", "event_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "payload"
    )


@query("s3_log_source", """SELECT part AS "partition", count(*) AS records, min(off) AS first_off, max(off) AS last_off FROM v_log GROUP BY part""")
def _(t):
    return files.read_log(t.spark, log_folder(t)).groupBy("partition").agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_off"), F.max("offset").alias("last_off")
    ).withColumn("partition", F.col("partition").cast("bigint"))


@query("s6_quarantine", """
SELECT off AS "offset", part AS "partition", concat(tenant_id, ':', """ + UUID_SQL + """) AS "key", 'not-json' AS "value",
  'invalid event JSON or field' AS error, 'source' AS header FROM v_log WHERE NOT valid""")
def _(t):
    q = t.spark.read.parquet(ingested(t)[1])
    return q.select(
        "offset", F.col("partition").cast("bigint").alias("partition"), F.col("key").cast("string"), F.col("value").cast("string"), "error",
        F.col("headers")[0]["key"].alias("header"),
    )


@query("t2_batch_accounting", f"""WITH {STORED}
SELECT (SELECT count(*) FROM v_log WHERE valid) AS "rows", count(*) AS inserted, (SELECT count(*) FROM v_log WHERE valid) - count(*) AS duplicates,
  (SELECT count(*) FROM v_log WHERE NOT valid) AS quarantined FROM stored""")
def _(t):
    m = t.spark.read.parquet(ingested(t)[2])
    return m.groupBy().agg(*[F.sum(c).alias(c) for c in ("rows", "inserted", "duplicates", "quarantined")])


@query("t3_replayed_batches", f"""WITH {STORED} SELECT count(*) AS "rows", count(*) AS "keys" FROM stored""")
def _(t):
    """Each stored batch written again as after a crash: the table does not change."""
    base = scratch_dir(t.spark, "replay")
    log = files.read_log(t.spark, log_folder(t))
    for batch_id, cond in ((0, "offset < 1000000000"), (1, "offset >= 1000000000"), (1, "offset >= 1000000000")):
        sink.write_batch(log.where(cond), batch_id, f"{base}/table", f"{base}/quarantine", INDEX_BUCKETS)
    return sink.read_table(t.spark, f"{base}/table").groupBy().agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("tenant_id", "event_id").alias("keys")
    )


def bounded(t):
    """(table, metrics) of the ingest stream that tells repeats by state."""
    def run():
        base = scratch_dir(t.spark, "bounded")
        keyed_state(t)
        source = log_stream(t)
        paths = [f"{base}/{n}" for n in ("table", "metrics")]
        at_least(MICRO_BATCHES, ingest.start_ingest(t.spark, source, paths[0], f"{base}/quarantine", f"{base}/checkpoint", metrics=paths[1], dedupe_horizon="60 days"))
        return paths

    return t.once("bounded", run)


@query("t9_dedupe_horizon", "WITH " + STREAMED)
def _(t):
    """The first content of every key, over several micro-batches."""
    rows = t.spark.read.parquet(bounded(t)[0])
    return rows.select("tenant_id", "event_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "payload")


ACCOUNTING_SQL = f"""WITH {STORED}
SELECT (SELECT count(*) FROM v_log WHERE valid) AS "rows", count(*) AS inserted, (SELECT count(*) FROM v_log WHERE valid) - count(*) AS duplicates,
  (SELECT count(*) FROM v_log WHERE NOT valid) AS quarantined, CAST(0 AS BIGINT) AS retries FROM stored"""


def accounting(t, metrics):
    return t.spark.read.parquet(metrics).groupBy().agg(*[F.sum(c).alias(c) for c in ("rows", "inserted", "duplicates", "quarantined", "retries")])


@query("t9_dedupe_accounting", ACCOUNTING_SQL)
def _(t):
    return accounting(t, bounded(t)[1])


@query("t7_ingest_counters", ACCOUNTING_SQL)
def _(t):
    """The counters that the ingest stream keeps for each batch, summed."""
    return accounting(t, ingested(t)[2])


@query("t6_observer_stream", f"""WITH {STORED}
SELECT {UUID_SQL} AS event_id FROM stored WHERE event_id % 3 <> 1""")
def _(t):
    """Pending IDs over the table's feed: the stream is ended and started again after every batch of the table, so only its state knows what is pending."""
    table = ingested(t)[0]
    base = scratch_dir(t.spark, "observer")
    keyed_state(t)
    pending = t.v_log.where("event_id % 3 <> 1").select(uuid_of().alias("event_id"))
    last = manifest.newest(t.spark, table).version
    for until in [*(k * last // MICRO_BATCHES for k in range(1, MICRO_BATCHES)), None]:
        events = feed.table_stream(t.spark, table, until)
        ingest.start_observer(t.spark, events, pending, f"{base}/seen", f"{base}/checkpoint", pages=stateful.PENDING_PAGES).awaitTermination()
    return t.spark.read.parquet(f"{base}/seen").select("event_id")


@query("s4_published_log", """
SELECT concat(tenant_id, ':', CAST(event_id AS STRING)) AS "key",
       concat('{"event_id":"', CAST(event_id AS STRING), '","event_type":"', event_type, '","occurred_at":"2024-01-01T00:00:00.5Z","payload":', payload,
              ',"tenant_id":"', tenant_id, '","received_at":"2024-01-02T00:00:00Z"}', chr(10)) AS "value", 'lake.events' AS topic
FROM v_log WHERE valid""")
def _(t):
    """Envelopes published to the log by a stream, and read back from what its commits name."""
    envelopes = ordered_folder(t, "envelopes", lambda: encode_envelopes(t.v_log.where("valid").select(
        "tenant_id", "event_id", "event_type", "payload",
        F.lit("2024-01-01 00:00:00.5").cast("timestamp").alias("occurred_at"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("received_at"),
    )).select("key", "value", "event_id"), "event_id")
    base = scratch_dir(t.spark, "published")
    stream = t.spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(envelopes)
    at_least(MICRO_BATCHES, feed.publish_stream(stream, f"{base}/log", f"{base}/checkpoint", "intake", "lake.events"))
    return feed.read_published(t.spark, f"{base}/log").select(F.col("key").cast("string"), F.col("value").cast("string"), "topic")


def ordered_folder(t, name, build, by, parts=MICRO_BATCHES + 1):
    """A derived table as files of rising ``by``, written one after the other: a file stream takes them in that order."""
    def write():
        path = scratch_dir(t.spark, name)
        rows = t.saved(name, build)
        low, high = rows.agg(F.min(by), F.max(by)).first()
        cuts = [low + (high - low) * k // parts for k in range(1, parts)]
        for begin, end in zip([low, *cuts], [*cuts, high + 1], strict=True):
            rows.where(F.col(by).between(begin, end - 1)).coalesce(1).write.mode("append").parquet(path)
        return path

    return t.once(f"{name}_ordered", write)


def drained(t, stream, name, mode="append"):
    """What a stream appends, once it has read its whole input in several micro-batches."""
    base = scratch_dir(t.spark, name)
    out = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    at_least(MICRO_BATCHES, out.outputMode(mode).trigger(availableNow=True).start())
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def keyed_state(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


@query("t7_live_counters", f"""
SELECT CASE kind WHEN 'storage' THEN 'success' WHEN 'progress' THEN 'timeout' ELSE 'error' END AS outcome, count(*) AS n, count(*) FILTER (WHERE failed) AS failures,
  {", ".join(f"count(*) FILTER (WHERE seq % 1100 <= {int(b * 100)}) AS {ingest.bucket_name(b)}" for b in ingest.RECEIPT_BOUNDS if b * 100 >= 1)},
  CAST(sum(seq % 1100) AS BIGINT) AS total FROM v_operations GROUP BY 1""")
def _(t):
    """Counters and a cumulative histogram for each outcome, kept over several micro-batches."""
    ops = ordered_folder(t, "operations", lambda: t.v_operations.select("seq", "kind", "failed"), "seq")
    stream = t.spark.readStream.schema("seq bigint, kind string, failed boolean").option("maxFilesPerTrigger", 1).parquet(ops)
    raw = F.when(F.col("kind") == "storage", "success").when(F.col("kind") == "progress", "timeout").otherwise(F.col("kind"))
    base = scratch_dir(t.spark, "counters")
    bounds = [b for b in ingest.RECEIPT_BOUNDS if b * 100 >= 1]
    q = ingest.start_counters(
        stream.withColumn("outcome", labels.outcome(raw)).withColumn("seconds", (F.col("seq") % 1100) / 100.0), ["outcome"], f"{base}/out", f"{base}/checkpoint",
        [F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.sum(F.col("seq") % 1100).alias("total"), *ingest.histogram("seconds", bounds)],
    )
    at_least(MICRO_BATCHES, q)
    newest = max(p["batchId"] for p in q.recentProgress)
    return t.spark.read.parquet(f"{base}/out/version={newest}")


@query("t4_token_bucket_stream", BUCKET_SQL)
def _(t):
    keyed_state(t)
    path = ordered_folder(t, "bucket_requests", lambda: bucket_requests(t), "at_ns")
    stream = t.spark.readStream.schema("tenant_id string, at_ns bigint, request_id bigint").option("maxFilesPerTrigger", 1).parquet(path)
    return drained(t, stateful.token_bucket_stream(stream, 1, idle_ttl_ms=None), "bucket_stream")


@query("t5_alert_stream", ALERT_SQL)
def _(t):
    keyed_state(t)
    path = ordered_folder(t, "alert_operations", lambda: alert_operations(t), "seq")
    stream = t.spark.readStream.schema("kind string, seq bigint, at_ns bigint, failed boolean").option("maxFilesPerTrigger", 1).parquet(path)
    return drained(t, stateful.alert_stream(stream, COOLDOWN), "alert_stream")


@query("s9_run_report", """SELECT run_id, repetition, CASE WHEN observation_status = 'complete' THEN p95_ns END AS visibility_p95_ns, correct FROM v_runs""")
def _(t):
    """Written as CSV and read back: an unavailable percentile is an empty cell."""
    base = scratch_dir(t.spark, "report")
    lines = export.run_report(t.v_runs.withColumnRenamed("p95_ns", "visibility_p95_ns")).select("run_id", "repetition", "visibility_p95_ns", "correct")
    export.write_report(lines, base)
    return t.spark.read.schema("run_id bigint, repetition bigint, visibility_p95_ns bigint, correct boolean").option("header", True).csv(f"{base}/csv")


@query("s10_captures", """
SELECT o_custkey AS run_id, count(*) AS samples, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey""")
def _(t):
    """Reports written as gzip JSON and read back with a fixed schema."""
    from tidemark.plans.reports import reports

    base = scratch_dir(t.spark, "captures")
    reports(t).select("run_id", "ack_ns").write.option("compression", "gzip").json(base)
    rows = t.spark.read.schema("run_id bigint, ack_ns array<bigint>").json(base)
    return rows.select("run_id", F.size("ack_ns").cast("bigint").alias("samples"), F.aggregate("ack_ns", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("s11_case_summary", """
SELECT concat('case-', CAST(case_id AS STRING)) AS "case", 'pipeline' AS kind, CASE WHEN bool_and(correct) THEN 'complete' ELSE 'failed' END AS status, CAST(1 AS BIGINT) AS attempt,
  count(DISTINCT CASE WHEN correct THEN repetition END) AS completed_repetitions, concat('captures/', CAST(case_id AS STRING), '.json.gz') AS artifact,
  sha256(CAST(case_id AS STRING)) AS sha256 FROM v_runs GROUP BY case_id""")
def _(t):
    name = F.col("case_id").cast("string")
    cases = t.v_runs.groupBy("case_id").agg(
        F.bool_and("correct").alias("ok"), F.collect_set(F.when(F.col("correct"), F.col("repetition"))).alias("completed")
    ).select(
        F.concat(F.lit("case-"), name).alias("case"), F.lit("pipeline").alias("kind"), F.when(F.col("ok"), "complete").otherwise("failed").alias("status"),
        F.lit(1).cast("bigint").alias("attempt"), "completed", F.concat(F.lit("captures/"), name, F.lit(".json.gz")).alias("artifact"), F.sha2(name, 256).alias("sha256"),
    )
    return export.case_summary(cases)


@query("s12_file_inventory")
def _(t):
    """Every file of the given tables: path, size and hash (checked against hashlib in the tests)."""
    return files.file_inventory(t.spark, t.sf_dir).select("path", "size", "sha256")


ARTIFACT_TEXT = "repeat(concat(CAST(s_suppkey AS STRING), ':', s_name, ';'), CAST(1 + s_suppkey % 50 AS INT))"


def artifacts(t):
    """(folder, manifest): a text file and a gzip file of two members for each supplier, some of them damaged after they were listed."""
    def write():
        base = scratch_dir(t.spark, "artifacts")

        def packed(batches):
            import gzip
            import hashlib

            import pandas as pd

            for pdf in batches:
                rows = []
                for key, text in zip(pdf["s_suppkey"], pdf["text"], strict=True):
                    fault, raw = key % 20, text.encode()
                    whole = gzip.compress(raw[:40], mtime=7 if fault == 4 else 0) + gzip.compress(raw[40:], mtime=0)
                    sent = {2: whole + b"x", 3: whole[:-1] + bytes([whole[-1] ^ 1]), 6: whole[:-5]}.get(fault, whole)
                    listed = whole if fault != 6 else sent  # cut before it was listed: only what is in it tells
                    size = len(raw) + (fault == 5)
                    rows.append((f"gz/{key}.gz", sent, len(listed), hashlib.sha256(listed).hexdigest(), "gzip", size, fault))
                    rows.append((f"text/{key}.txt", raw, len(raw), hashlib.sha256(raw).hexdigest(), "json", len(raw), fault))
                yield pd.DataFrame(rows, columns=["path", "content", "size", "sha256", "codec", "raw_size", "fault"])

        suppliers = t.supplier.repartition(t.spark.sparkContext.defaultParallelism)  # one small file of rows is many files of artifacts
        rows = suppliers.selectExpr("s_suppkey", f"{ARTIFACT_TEXT} AS text").mapInPandas(
            packed, "path string, content binary, size bigint, sha256 string, codec string, raw_size bigint, fault bigint"
        )
        made = scratch_dir(t.spark, "artifact-rows")
        rows.write.parquet(made)
        rows = t.spark.read.parquet(made)
        gz = F.col("codec") == "gzip"
        export.write_files(rows.where(~(gz & (F.col("fault") == 1))), base)  # 1 is listed, but not there
        listed = rows.where(~(gz & (F.col("fault") == 7))).drop("content")  # 7 is there, but not listed
        return base, listed.unionAll(listed.where(gz & (F.col("fault") == 8)))  # 8 is listed twice

    return t.once("artifacts", write)


@query("s12_artifact_files", f"""
SELECT concat('text/', s_suppkey, '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS "size", sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS raw_bytes
FROM (SELECT s_suppkey, {ARTIFACT_TEXT.replace("AS INT", "AS BIGINT")} AS text FROM supplier)""")
def _(t):
    """Files written from the table and read back to their end: the shorter as one value, the longer ones block by block."""
    found = files.file_inventory(t.spark, artifacts(t)[0], raw_sizes=True, whole_bytes=600)
    return found.where("path LIKE 'text/%'").drop("gzip_time_zero")


@query("j16_artifact_diff", """
SELECT concat('gz/', s_suppkey, '.gz') AS path, CASE s_suppkey % 20 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' WHEN 7 THEN 'extra' ELSE 'repeated' END AS fault
FROM supplier WHERE s_suppkey % 20 IN (1, 2, 3, 7, 8)""")
def _(t):
    """A manifest against the files that are there."""
    from tidemark.operators.diffs import inventory_diff

    base, listed = artifacts(t)
    return inventory_diff(listed, files.file_inventory(t.spark, base))


@query("r18_artifact_files", """
SELECT concat('gz/', s_suppkey, '.gz') AS path, CASE s_suppkey % 20 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' WHEN 4 THEN 'gzip_time' ELSE 'raw_size' END AS fault
FROM supplier WHERE s_suppkey % 20 BETWEEN 1 AND 6""")
def _(t):
    """References against the files: also a gzip file of two members, which is whole, and a cut one."""
    from tidemark.operators.audit import r18_artifacts

    base, listed = artifacts(t)
    return r18_artifacts(listed.dropDuplicates(["path"]).drop("fault"), files.file_inventory(t.spark, base, raw_sizes=True, whole_bytes=600))


@query("j16_inventory_diff", """
SELECT concat(o_orderkey, '.json') AS path, CASE WHEN o_orderkey % 50 = 1 THEN 'missing' WHEN o_orderkey % 50 = 2 THEN 'extra' WHEN o_orderkey % 50 = 3 THEN 'repeated'
  WHEN o_orderkey % 50 = 4 THEN 'size' ELSE 'hash' END AS fault FROM orders WHERE o_orderkey % 50 BETWEEN 1 AND 5""")
def _(t):
    from tidemark.operators.diffs import inventory_diff

    key = F.col("o_orderkey")
    entry = t.orders.select(F.concat(key.cast("string"), F.lit(".json")).alias("path"), (key % 1000).alias("size"), F.sha2(key.cast("string"), 256).alias("sha256"), "o_orderkey")
    manifest = entry.where(key % 50 != 2).unionByName(entry.where(key % 50 == 3))
    found = entry.where(key % 50 != 1).withColumn("size", F.when(key % 50 == 4, F.col("size") + 1).otherwise(F.col("size"))).withColumn(
        "sha256", F.when(key % 50 == 5, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))
    )
    return inventory_diff(manifest, found)


@query("s13_metrics_text", """
SELECT p_partkey, metric, CASE WHEN p_partkey % 4 = 1 THEN 'reason=timeout' ELSE '' END AS labels,
  CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS DOUBLE) END AS "value", CASE WHEN p_partkey % 4 = 3 THEN 'unlimited' ELSE 'number' END AS status
FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'lake_stored_total' WHEN 1 THEN 'lake_publish_failures_total' ELSE 'lake_process_open_fds' END AS metric FROM part WHERE p_partkey % 5 <> 4)""")
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    line = (
        F.when(key % 5 == 4, F.concat(F.lit('lake_stored_total{tenant="'), F.col("p_name"), F.lit('"} 1')))
        .when(key % 4 == 0, F.concat(F.lit("lake_stored_total "), size)).when(key % 4 == 1, F.concat(F.lit('lake_publish_failures_total{reason="timeout"} '), size))
        .when(key % 4 == 2, F.concat(F.lit("lake_process_open_fds "), size)).otherwise(F.lit("lake_process_open_fds +Inf"))
    )
    return files.metric_samples(t.part.select("p_partkey", line.alias("value")), "lake_", keep=["p_partkey"])


@query("r18_artifact_bounds", """
SELECT concat(o_orderkey, '.gz') AS path, CASE o_orderkey % 40 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' WHEN 4 THEN 'gzip_time' ELSE 'raw_size' END AS fault
FROM orders WHERE o_orderkey % 40 BETWEEN 1 AND 5""")
def _(t):
    from tidemark.operators.audit import r18_artifacts

    key = F.col("o_orderkey")
    n = key % 40
    refs = t.orders.select(
        F.concat(key.cast("string"), F.lit(".gz")).alias("path"), F.lit("gzip").alias("codec"), (key % 1000).alias("size"),
        F.sha2(key.cast("string"), 256).alias("sha256"), (key % 5000).alias("raw_size"), "o_orderkey",
    )
    found = refs.where(n != 1).select(
        "path", F.when(n == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(n == 3, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"),
        (F.col("raw_size") + F.when(n == 5, 1).otherwise(0)).alias("raw_bytes"), (n != 4).alias("gzip_time_zero"),
    )
    return r18_artifacts(refs.drop("o_orderkey"), found)
