"""Column expressions for identifiers and times; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted patterns and limits.
UUID_HEX = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NIL_UUID = "00000000-0000-0000-0000-000000000000"
RFC3339 = (
    r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
)
SAFE_NAME = r"^[a-zA-Z0-9._-]{1,249}$"
MAX_TEXT_BYTES = 128
ZERO_TIME = "0001-01-01T00:00:00Z"


def uuid_text(text: Column) -> Column:
    """Lower-case canonical UUID from any accepted form (plain, urn:uuid:, braces, 32 hex), else NULL."""
    low = F.lower(text)
    plain = F.regexp_extract(low, rf"^(?:urn:uuid:)?({UUID_HEX})$|^\{{({UUID_HEX})\}}$", 1)
    braced = F.regexp_extract(low, rf"^\{{({UUID_HEX})\}}$", 1)
    packed = F.regexp_replace(
        F.regexp_extract(low, r"^([0-9a-f]{32})$", 1),
        r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(braced, F.lit("")), F.nullif(packed, F.lit("")))


def bounded_text(text: Column) -> Column:
    """1 to 128 bytes and no NUL."""
    return F.coalesce(
        F.octet_length(text).between(1, MAX_TEXT_BYTES) & (F.instr(text, "\0") == 0), F.lit(False)
    )


def rfc3339(text: Column) -> Column:
    """A TIMESTAMP (microseconds, cut) from strict RFC 3339 text, else NULL; the zero time is NULL too."""
    shaped = F.when(text.rlike(RFC3339), text)
    base = F.concat(F.substring(shaped, 1, 19), F.lit("Z")).try_cast("timestamp")
    digits = F.regexp_extract(shaped, r"\.([0-9]+)", 1)
    micros = F.rpad(F.substring(digits, 1, 6), 6, "0").cast("bigint")
    zone = F.regexp_extract(shaped, r"([+-][0-9]{2}:[0-9]{2})$", 1)
    minutes = F.when(
        zone != "",
        (F.substring(zone, 2, 2).cast("bigint") * 60 + F.substring(zone, 5, 2).cast("bigint"))
        * F.when(zone.startswith("-"), -1).otherwise(1),
    ).otherwise(F.lit(0))
    instant = F.unix_micros(base) - minutes * 60_000_000 + F.coalesce(micros, F.lit(0))
    zero = F.unix_micros(F.lit(ZERO_TIME).cast("timestamp"))
    none = F.substring(digits, 1, 9).rlike("^0*$")
    return F.when(~((instant == zero) & none), F.timestamp_micros(instant))
