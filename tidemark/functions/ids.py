"""Name-based identities and payload text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The OID namespace of name-based UUIDs, the payload alphabet and digest length.
OID_NAMESPACE_HEX = "6BA7B8129DAD11D180B400C04FD430C8"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
DIGEST_BYTES = 32


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE_HEX)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def hex_low(value: Column) -> Column:
    """Hex of a BIGINT's 64 bits, lower case, without leading zeros."""
    return F.lower(F.hex(value))


def varied_text(prefix: Column, length: int) -> Column:
    """``length`` letters: SHA-256 of ``prefix/offset`` for each block of 32, the low six bits of each byte as index.

    Base64 of the bytes 0, 0, b ends in the letter of b's low six bits, so two
    pattern replacements map all bytes at once; only letters 62 and 63 differ.
    """
    offsets = F.sequence(F.lit(0), F.lit(max(length - 1, 0)), F.lit(DIGEST_BYTES))
    digests = F.transform(offsets, lambda o: F.sha2(F.concat(prefix, F.lit("/"), o.cast("string")), 256))
    spread = F.regexp_replace(F.array_join(digests, ""), "(..)", "0000$1")
    letters = F.regexp_replace(F.replace(F.base64(F.unhex(spread)), F.lit("\r\n"), F.lit("")), "...(.)", "$1")
    return F.translate(F.substring(letters, 1, length), "+/", ALPHABET[62:])
