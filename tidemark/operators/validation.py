"""Strict event validation: one pass, the first broken rule names the error class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.json_udfs import parse_event, parse_items, split_batch

# Byte limits, items per batch, and the messages callers see.
MAX_EVENT_BYTES = 262144
MAX_ENVELOPE_BYTES = 266240
MAX_REQUEST_BYTES = 1048576
MAX_BATCH_EVENTS = 100
LIMITS = {"event": MAX_EVENT_BYTES, "envelope": MAX_ENVELOPE_BYTES, "request": MAX_REQUEST_BYTES}
MESSAGES = {
    "too_large": "event or request exceeds byte limit",
    "unicode": "JSON text must be valid Unicode without NUL",
    "json": "invalid event JSON or field",
    "trailing": "expected one JSON document",
    "event_id": "event_id must be a nonzero UUID",
    "event_type": "event_type must contain 1–128 bytes",
    "occurred_at": "occurred_at must be an RFC 3339 timestamp",
    "payload_object": "payload must be a JSON object",
    "payload_storable": "payload must be PostgreSQL-compatible JSON with nesting at most 64",
    "identity": "invalid server event identity",
    "batch_size": "batch must contain 1–100 events",
}
RESULT_COLUMNS = ("valid", "error_class", "error", "too_large", "event_id", "event_type", "occurred_at", "payload")


def message(error_class: Column) -> Column:
    pairs = [F.lit(x) for kv in MESSAGES.items() for x in kv]
    return F.create_map(*pairs)[error_class]


def event_id_rule(text: Column) -> Column:
    return F.coalesce(tx.uuid_text(text) != tx.NIL_UUID, F.lit(False))


def validate_events(df: DataFrame, raw_col: str, max_bytes: int | None = None, kind: str = "event") -> DataFrame:
    """Adds ``valid, error_class, error, too_large`` and the fields of each document.

    ``kind`` is ``event`` (from a caller) or ``envelope`` (from the log, which also
    yields ``tenant_id`` and ``received_at``). Size and UTF-8 rules run in SQL, so
    broken or huge rows never reach Python.
    """
    limit = LIMITS[kind] if max_bytes is None else max_bytes
    raw = F.col(raw_col).cast("binary")
    d = df.withColumn("__large", F.octet_length(raw) > limit)
    d = d.withColumn("__utf8", F.is_valid_utf8(raw))
    d = d.withColumn("__doc", parse_event(kind)(F.when(~F.col("__large") & F.col("__utf8"), raw)))
    p = F.col("__doc")
    # Typed fields become columns first: they are used several times and parsed once.
    typed = event_columns(p, kind)
    d = d.select("*", *[c.alias(f"__{n}") for n, c in typed.items()])
    typed = {n: F.col(f"__{n}") for n in typed}
    broken = first_broken(p, typed, F.col("__large"), F.col("__utf8"), kind)
    d = d.withColumn("error_class", F.when(raw.isNull(), F.lit("json")).otherwise(broken))
    ok = F.col("error_class").isNull()
    out = {
        "valid": ok,
        "error": message(F.col("error_class")),
        "too_large": F.coalesce(F.col("__large"), F.lit(False)),
        **{n: F.when(ok, c) for n, c in typed.items()},
    }
    kept = [c for c in df.columns if c not in out and c != "error_class"]
    return d.select(*kept, "error_class", *[c.alias(n) for n, c in out.items()])


def event_columns(p: Column, kind: str) -> dict[str, Column]:
    """Typed fields of a parsed document."""
    cols = {
        "event_id": tx.uuid_text(p["event_id"]),
        "event_type": p["event_type"],
        "occurred_at": tx.rfc3339(p["occurred_at"]),
        "payload": p["payload"],
    }
    if kind == "envelope":
        cols["tenant_id"] = p["tenant_id"]
        cols["received_at"] = tx.rfc3339(p["received_at"])
    return cols


def first_broken(p: Column, cols: dict[str, Column], large: Column, utf8: Column, kind: str) -> Column:
    """The class of the first rule a parsed document breaks, NULL when it is valid."""
    uuid, occurred = cols["event_id"], cols["occurred_at"]
    # A present but malformed UUID or time breaks decoding; a missing one breaks its own rule.
    decodes = (p["event_id"].isNull() | uuid.isNotNull()) & _time_decodes(p["occurred_at"], occurred)
    if kind == "envelope":
        decodes = decodes & _time_decodes(p["received_at"], cols["received_at"])
    rules = [
        ("too_large", large),
        ("unicode", ~utf8 | (p["fault"] == "unicode")),
        ("json", (p["fault"] == "json") | (p["fault"].isNull() & ~decodes)),
        ("trailing", p["fault"] == "trailing"),
        ("event_id", uuid.isNull() | (uuid == tx.NIL_UUID)),
        ("event_type", ~tx.bounded_text(p["event_type"])),
        ("occurred_at", occurred.isNull()),
        ("payload_object", p["payload_fault"] == "payload_object"),
        ("payload_storable", p["payload_fault"] == "payload_storable"),
    ]
    if kind == "envelope":
        rules.append(("identity", ~tx.bounded_text(p["tenant_id"]) | cols["received_at"].isNull()))
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])


def _time_decodes(text: Column, parsed: Column) -> Column:
    """Absent, a real time, or the zero time (which is well formed but fails its own rule later)."""
    return text.isNull() | parsed.isNotNull() | F.coalesce(text.rlike(r"^0001-01-01T") & text.rlike(tx.RFC3339), F.lit(False))


def explode_batches(df: DataFrame, body_col: str, max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """One row per item of each batch request, with the request's verdict.

    A request stands or falls as a whole: ``request_error`` is its shape fault or the
    fault of its first bad item. A request without items keeps one row with
    ``position`` NULL. Everything happens within the request's own row before the
    explode, so nothing is shuffled.
    """
    body = F.col(body_col).cast("binary")
    d = df.withColumn("__large", F.octet_length(body) > max_bytes).withColumn("__utf8", F.is_valid_utf8(body))
    d = d.withColumn("__split", split_batch(F.when(~F.col("__large") & F.col("__utf8"), body)))
    d = d.withColumn("__items", F.col("__split.items"))
    shape = (
        F.when(F.col("__large"), "too_large")
        .when(~F.col("__utf8"), "unicode")
        .when(F.col("__split.fault").isNotNull(), F.col("__split.fault"))
        .when((F.size("__items") < 1) | (F.size("__items") > MAX_BATCH_EVENTS), "batch_size")
    )
    d = d.withColumn("__shape", shape)
    d = d.withColumn("__parsed", parse_items(MAX_EVENT_BYTES)(F.when(F.col("__shape").isNull(), F.col("__items"))))

    names = ("event_id", "event_type", "occurred_at", "payload")

    def typed(p: Column) -> Column:
        return F.struct(p.alias("doc"), *[c.alias(n) for n, c in event_columns(p, "event").items()])

    def judged(e: Column) -> Column:
        broken = first_broken(e["doc"], {n: e[n] for n in names}, e["doc"]["large"], F.lit(True), "event")
        return F.struct(broken.alias("error_class"), *[e[n].alias(n) for n in names])

    d = d.withColumn("__events", F.transform(F.transform("__parsed", typed), judged))
    faults = F.filter(F.col("__events.error_class"), lambda c: c.isNotNull())
    d = d.withColumn("request_error", F.coalesce(F.col("__shape"), F.get(faults, F.lit(0))))
    keep = [c for c in df.columns if c != body_col]
    items = d.select(*keep, "request_error", F.posexplode_outer("__events").alias("position", "e"))
    return items.select(
        *keep, "position", F.col("request_error").isNull().alias("request_valid"), "request_error", "e.*"
    )


def accept(df: DataFrame, tenant_col: str, received_col: str) -> DataFrame:
    """Attach tenant and receipt time; rows with an unusable identity get ``accepted`` false."""
    ok = tx.bounded_text(F.col(tenant_col)) & F.col(received_col).isNotNull()
    return df.withColumn("tenant_id", F.col(tenant_col)).withColumn("received_at", F.col(received_col)).withColumn("accepted", ok)


def iso_utc(at: Column) -> Column:
    """RFC 3339 in UTC, without needless fraction digits."""
    whole = F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    tail = F.rtrim(F.lpad(micros.cast("string"), 6, "0"), F.lit("0"))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), tail)), F.lit("Z"))


def encode_envelopes(df: DataFrame, max_bytes: int = MAX_ENVELOPE_BYTES) -> DataFrame:
    """Log records: key ``tenant:event`` and the envelope document with its payload text untouched.

    Records above the byte limit keep ``too_large`` true and must not be published.
    """
    def quoted(c: str) -> Column:
        return F.expr(f"substr(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6)")

    value = F.concat(
        F.lit('{"event_id":"'), F.col("event_id").cast("string"), F.lit('","event_type":'), quoted("event_type"),
        F.lit(',"occurred_at":"'), iso_utc(F.col("occurred_at")), F.lit('","payload":'), F.col("payload"),
        F.lit(',"tenant_id":'), quoted("tenant_id"), F.lit(',"received_at":"'), iso_utc(F.col("received_at")), F.lit('"}\n'),
    )
    key = F.concat_ws(":", F.col("tenant_id"), F.col("event_id").cast("string"))
    return df.select(
        "*", key.cast("binary").alias("key"), value.cast("binary").alias("value")
    ).withColumn("too_large", F.octet_length("value") > max_bytes)


def http_outcome(error_class: Column, authorised: Column, limited: Column, published: Column) -> Column:
    """The response status of a request: who sent it, how often, what it held, whether the log took it."""
    return (
        F.when(~authorised, 401)
        .when(limited, 429)
        .when(error_class == "too_large", 413)
        .when(error_class.isNotNull(), 400)
        .when(~published, 503)
        .otherwise(202)
    )
