"""Storage and table queries: first-wins merges, counts, order and retention."""

from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans.catalog import query

STORED = """stored AS (
  SELECT tenant_id, event_id, event_type, occurred_at, payload FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY part, off) AS rn FROM v_log WHERE valid)
  WHERE rn = 1)"""


def stored(t):
    """The table a full read of the valid log leaves behind."""
    return store.first_wins(t.v_log.where("valid")).select("tenant_id", "event_id", "event_type", "occurred_at", "payload")


@query("s7_store_counts", f"""WITH {STORED}
SELECT tenant_id, event_type, count(*) AS n FROM stored GROUP BY tenant_id, event_type""")
def _(t):
    return stored(t).groupBy("tenant_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s5_first_wins_rows", f"""WITH {STORED} SELECT * FROM stored""")
def _(t):
    return stored(t)


def first_half(t):
    """A table that already holds part of the log, stored by an earlier load."""
    return store.first_wins(t.v_log.where("valid AND event_id % 2 = 0 AND attempt = 0"))


@query("s7_staged_merge", """
SELECT tenant_id, event_id, event_type, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY attempt, off) AS rn FROM v_log WHERE valid)
WHERE rn = 1""")
def _(t):
    return store.merge_first_wins(first_half(t), t.v_log.where("valid"), order_cols=["attempt", "off"]).select(
        "tenant_id", "event_id", "event_type", "payload"
    )


@query("s8_method_equivalence", """
SELECT m.method, count(*) AS ids, CAST(0 AS BIGINT) AS differing
FROM (SELECT DISTINCT tenant_id, event_id FROM v_log WHERE valid) CROSS JOIN (VALUES ('insert'), ('batch-insert'), ('copy-merge')) m(method)
GROUP BY m.method""")
def _(t):
    """One key at a time, batch by batch, or staged and merged: the same stored keys."""
    log = t.v_log.where("valid")
    keys = list(store.EVENT_KEY)
    single = log.select(*keys).distinct()
    # Batches of the log in arrival order: a key is stored by its first batch.
    batched = log.groupBy(*keys).agg(F.min(F.col("attempt") * 4 + F.col("event_id") % 4).alias("batch")).select(*keys)
    merged = store.merge_first_wins(first_half(t), log, order_cols=["attempt", "off"]).select(*keys)
    tagged = (
        single.withColumn("m", F.lit(1)).unionByName(batched.withColumn("m", F.lit(2))).unionByName(merged.withColumn("m", F.lit(4)))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("m").alias("seen"))
    methods = F.array(*[F.struct(F.lit(n).alias("method"), F.lit(b).cast("bigint").alias("bit")) for n, b in
                        (("insert", 1), ("batch-insert", 2), ("copy-merge", 4))])
    return (
        per_key.select("seen", F.explode(methods).alias("m"))
        .groupBy(F.col("m.method").alias("method"))
        .agg(F.count_if(F.col("seen").bitwiseAND(F.col("m.bit")) != 0).alias("ids"), F.count_if(F.col("seen") != 7).alias("differing"))
    )


@query("j2_insert_if_absent", """
SELECT tenant_id, event_id, off FROM v_log l WHERE valid AND NOT EXISTS (
  SELECT 1 FROM v_log s WHERE s.valid AND s.attempt = 0 AND s.event_id % 2 = 0 AND s.tenant_id = l.tenant_id AND s.event_id = l.event_id)""")
def _(t):
    return store.insert_if_absent(t.v_log.where("valid"), first_half(t)).select("tenant_id", "event_id", "off")


@query("a1_events_by_type", f"""WITH {STORED}
SELECT event_type, count(*) AS n FROM stored WHERE tenant_id = 't1' GROUP BY event_type""")
def _(t):
    return store.events_by_type(stored(t), "t1")


@query("a2_tenant_summary", f"""WITH {STORED}
SELECT tenant_id, count(*) AS n, max(occurred_at) AS latest FROM stored GROUP BY tenant_id""")
def _(t):
    return store.tenant_summary(stored(t), "occurred_at")


@query("a9_write_accounting", """
WITH log AS (SELECT *, off % 8 + attempt * 8 AS batch FROM v_log WHERE valid),
firsts AS (SELECT batch, count(*) AS inserted FROM (
  SELECT batch, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY batch, off) AS rn FROM log) WHERE rn = 1 GROUP BY batch)
SELECT l.batch, count(*) AS "rows", coalesce(max(f.inserted), 0) AS inserted, count(*) - coalesce(max(f.inserted), 0) AS duplicates
FROM log l LEFT JOIN firsts f ON f.batch = l.batch GROUP BY l.batch""")
def _(t):
    log = t.v_log.where("valid").withColumn("batch", F.col("off") % 8 + F.col("attempt") * 8)
    return store.write_accounting(log, ["tenant_id", "event_id"], "batch", ["off"])


@query("k1_latest", f"""WITH {STORED}
SELECT tenant_id, event_id, occurred_at FROM stored ORDER BY occurred_at DESC, event_id DESC LIMIT 10""")
def _(t):
    return store.latest(stored(t), 10, "occurred_at").select("tenant_id", "event_id", "occurred_at")


@query("k4_tenant_order", f"""WITH {STORED}
SELECT row_number() OVER (ORDER BY occurred_at, event_id) AS position, event_id, event_type, payload FROM stored WHERE tenant_id = 't1'""")
def _(t):
    """Position comes from the running count, so no task sorts the whole tenant."""
    from tidemark.operators.ordered import running

    mine = stored(t).where("tenant_id = 't1'").withColumn("at_us", F.unix_micros(F.col("occurred_at").cast("timestamp")))
    at = running(mine, ["tenant_id"], "at_us", sums={"upto": F.lit(1)})
    inside = F.row_number().over(store.Window.partitionBy("tenant_id", "at_us").orderBy("event_id"))
    size = F.count(F.lit(1)).over(store.Window.partitionBy("tenant_id", "at_us"))
    ranked = mine.withColumn("__in", inside).withColumn("__size", size)
    return ranked.join(at, ["tenant_id", "at_us"]).select(
        (F.col("upto") - F.col("__size") + F.col("__in")).alias("position"), "event_id", "event_type", "payload"
    )


@query("p2_tenant_events", f"""WITH {STORED}
SELECT event_id, event_type, payload FROM stored WHERE tenant_id = 't1' ORDER BY occurred_at, event_id""")
def _(t):
    return store.tenant_events(stored(t), "t1").select("event_id", "event_type", "payload")


@query("p3_point_lookup", f"""WITH {STORED}
SELECT tenant_id, event_id, event_type, payload FROM stored WHERE tenant_id = 't2' AND event_id = 42""")
def _(t):
    return stored(t).where("tenant_id = 't2' AND event_id = 42").select("tenant_id", "event_id", "event_type", "payload")


@query("s14_snapshot_restore", f"""WITH {STORED},
restored AS (SELECT tenant_id, event_id, CASE WHEN event_id % 97 = 5 THEN 'changed' ELSE event_type END AS event_type, payload
             FROM stored WHERE event_id % 89 <> 4)
SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.event_id, b.event_id) AS event_id,
       CASE WHEN b.event_id IS NULL THEN 'only_a' WHEN a.event_id IS NULL THEN 'only_b' ELSE 'content' END AS difference
FROM stored a FULL JOIN restored b ON a.tenant_id = b.tenant_id AND a.event_id = b.event_id
WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.payload IS DISTINCT FROM b.payload""")
def _(t):
    whole = stored(t)
    restored = whole.where("event_id % 89 <> 4").withColumn(
        "event_type", F.when(F.col("event_id") % 97 == 5, "changed").otherwise(F.col("event_type"))
    )
    return store.snapshot_diff(whole, restored, ["tenant_id", "event_id"], ["event_type", "payload"])


@query("s15_gap_replay", f"""WITH {STORED}
SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'replayed') AS replayed FROM stored GROUP BY tenant_id""")
def _(t):
    """A restored older table plus a read of the whole log from its start."""
    from tidemark.streaming.ingest import replay_gap

    older = store.first_wins(t.v_log.where("valid AND attempt = 0 AND off % 3 = 1"))
    return replay_gap(t.v_log.where("valid"), older).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "replayed").alias("replayed")
    )


@query("s16_retention_purge", f"""WITH {STORED}
SELECT tenant_id, event_id FROM stored WHERE occurred_at >= TIMESTAMP '2024-01-08 00:00:00'""")
def _(t):
    return store.purge(stored(t), F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"), "occurred_at").select("tenant_id", "event_id")


@query("s16_lost_ranges", """
WITH committed AS (SELECT part, min(off) AS committed_off FROM v_log WHERE occurred_at >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY part),
earliest AS (SELECT part, min(off) AS earliest_off FROM v_log WHERE occurred_at >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY part)
SELECT c.part, greatest(committed_off, 0) AS first_lost, earliest_off - 1 AS last_lost, earliest_off - greatest(committed_off, 0) AS lost
FROM committed c JOIN earliest e ON c.part = e.part WHERE earliest_off > greatest(committed_off, 0)""")
def _(t):
    """A reader stopped before its first record of the third day; retention then purged the log up to the eighth."""
    log = t.v_log
    committed = log.where("occurred_at >= TIMESTAMP_NTZ '2024-01-03 00:00:00'").groupBy("part").agg(F.min("off").alias("committed_off"))
    earliest = log.where("occurred_at >= TIMESTAMP_NTZ '2024-01-08 00:00:00'").groupBy("part").agg(F.min("off").alias("earliest_off"))
    return store.lost_ranges(committed, earliest)
