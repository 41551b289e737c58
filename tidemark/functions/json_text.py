"""Small per-document helpers over JSON text, used inside Arrow batches.

The standard library's scanner does the reading. It is stricter here than by
default: no NaN or Infinity, numbers kept as text, and every escape checked on
the raw bytes first.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from json.decoder import scanstring

# Storable numbers have at most this many digits on each side of the point.
MAX_WHOLE_DIGITS = 131072
MAX_FRACTION_DIGITS = 16383
MAX_DEPTH = 64
EXPONENT_LIMIT = 2**31

EVENT_FIELDS = ("event_id", "event_type", "occurred_at", "payload")
ENVELOPE_FIELDS = EVENT_FIELDS + ("tenant_id", "received_at")
BATCH_FIELDS = ("events",)

_SPACE = re.compile(r"[ \t\n\r]*")
_ESCAPE = re.compile(rb"\\(u([0-9a-fA-F]{4})(\\u([0-9a-fA-F]{4}))?|.)?", re.DOTALL)
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)


def escapes_ok(raw: bytes) -> bool:
    """No NUL escape, no lone or badly ordered surrogate escape, none cut short."""
    pos = raw.find(b"\\")
    while pos >= 0:
        m = _ESCAPE.match(raw, pos)
        token = m.group(1)
        if token is None:
            return False
        if token[:1] != b"u":
            pos = raw.find(b"\\", pos + 2)
            continue
        if m.group(2) is None:
            return False
        unit = int(m.group(2), 16)
        step = 6
        if unit == 0 or 0xDC00 <= unit <= 0xDFFF:
            return False
        if 0xD800 <= unit <= 0xDBFF:
            if m.group(4) is None or not 0xDC00 <= int(m.group(4), 16) <= 0xDFFF:
                return False
            step = 12
        pos = raw.find(b"\\", pos + step)
    return True


_POWER = re.compile(r"[eE]([+-]?)0*([0-9]*)$")


def number_fits(text: str) -> bool:
    """Whether a number has at most the allowed digits before and behind its point once written out; no float is made."""
    power = _POWER.search(text)
    if power is None and len(text) <= MAX_FRACTION_DIGITS:
        return True
    if power is not None:
        size = int(power[2] or 0) if len(power[2]) <= 12 else EXPONENT_LIMIT + 1
        if size > EXPONENT_LIMIT or (size == EXPONENT_LIMIT and power[1] != "-"):
            return False
    value = Decimal(text)
    return (not value or value.adjusted() < MAX_WHOLE_DIGITS) and -value.as_tuple().exponent <= MAX_FRACTION_DIGITS


def depth_of(text: str) -> int:
    """Deepest bracket nesting of a well-formed document, or an upper bound that is within the limit."""
    if text.count("{") + text.count("[") <= MAX_DEPTH:
        return text.count("{") + text.count("[")
    depth = deepest = 0
    for m in _BRACKETS.finditer(text):
        c = m.group()
        if c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    return deepest


def _no_constant(name: str):
    raise ValueError(name)


class _Numbers:
    """Collects whether every number of the value being read is storable."""

    def __init__(self):
        self.ok = True
        self.scan = json.JSONDecoder(
            parse_int=self.note, parse_float=self.note, parse_constant=_no_constant, object_pairs_hook=lambda _: {}
        ).scan_once

    def note(self, text: str) -> str:
        if self.ok and not number_fits(text):
            self.ok = False
        return ""


# One scanner per Python worker: a worker reads one document at a time.
_NUMBERS = _Numbers()


def fold(name: str) -> str:
    """Field names match without regard to case, including the two letters that fold to ASCII."""
    return name.lower().replace("ſ", "s").replace("K", "k")


def _skip(text: str, pos: int) -> int:
    return _SPACE.match(text, pos).end()


def members(text: str, scan):
    """(name, value, start, end) of each member of the object that opens the text, then (None, None, end, end).

    ``null`` yields no members. Raises ValueError on bad JSON.
    """
    pos = _skip(text, 0)
    if text[pos : pos + 4] == "null":
        yield None, None, pos + 4, pos + 4
        return
    if text[pos : pos + 1] != "{":
        raise ValueError("not an object")
    pos = _skip(text, pos + 1)
    if text[pos : pos + 1] == "}":
        yield None, None, pos + 1, pos + 1
        return
    while True:
        if text[pos : pos + 1] != '"':
            raise ValueError("name expected")
        name, pos = scanstring(text, pos + 1, True)
        pos = _skip(text, pos)
        if text[pos : pos + 1] != ":":
            raise ValueError("colon expected")
        start = _skip(text, pos + 1)
        try:
            value, end = scan(text, start)
        except StopIteration:  # the scanner's word for no value; it must not leave a generator
            raise ValueError("value expected") from None
        yield name, value, start, end
        pos = _skip(text, end)
        if text[pos : pos + 1] == "}":
            yield None, None, pos + 1, pos + 1
            return
        if text[pos : pos + 1] != ",":
            raise ValueError("comma expected")
        pos = _skip(text, pos + 1)


def read_event(raw: bytes, fields: tuple[str, ...]) -> dict:
    """Text fields and the raw payload slice of one document, or ``fault``: the first broken rule."""
    if not escapes_ok(raw):
        return {"fault": "unicode"}
    text = raw.decode("utf-8")
    numbers = _NUMBERS
    numbers.ok = True
    out: dict = {}
    payload_ok = True
    try:
        for name, value, start, end in members(text, numbers.scan):
            if name is None:
                tail = end
                break
            key = fold(name)
            if key not in fields:
                return {"fault": "json"}
            if key == "payload":
                out[key] = text[start:end]
                payload_ok = numbers.ok
            elif isinstance(value, str) and text[start] == '"':
                out[key] = value
            elif value is not None or key == "event_id":
                return {"fault": "json"}
            numbers.ok = True
    except (ValueError, RecursionError):
        return {"fault": "json"}
    if _skip(text, tail) != len(text):
        return {"fault": "trailing"}
    payload = out.get("payload")
    if payload is None or payload[0] != "{":
        out["payload_fault"] = "payload_object"
    elif not payload_ok or depth_of(payload) > MAX_DEPTH:
        out["payload_fault"] = "payload_storable"
    return out


def split_batch(raw: bytes):
    """(fault, items): the raw slices of a batch's items, or why the body is not a batch document."""
    if not escapes_ok(raw):
        return "unicode", None
    text = raw.decode("utf-8")
    scan = _NUMBERS.scan
    items: list[bytes] = []
    try:
        for name, _, start, end in members(text, scan):
            if name is None:
                tail = end
                break
            if fold(name) not in BATCH_FIELDS or text[start] not in "[n":
                return "json", None
            items = _slices(text, start, scan) if text[start] == "[" else []
    except (ValueError, RecursionError):
        return "json", None
    return (None, items) if _skip(text, tail) == len(text) else ("trailing", None)


def _slices(text: str, start: int, scan) -> list[bytes]:
    """Item slices of the (already scanned, so well-formed) array at ``start``."""
    out = []
    pos = _skip(text, start + 1)
    while text[pos] != "]":
        _, stop = scan(text, pos)
        out.append(text[pos:stop].encode("utf-8"))
        pos = _skip(text, stop)
        if text[pos] == ",":
            pos = _skip(text, pos + 1)
    return out


def _finite(text: str) -> float:
    v = float(text)
    if v in (float("inf"), float("-inf")):
        raise ValueError("outside float64")
    return v + 0.0 if v else 0.0


_CANONICAL = json.JSONDecoder(parse_int=_finite, parse_float=_finite, parse_constant=_no_constant)


def canonical(text: str | None):
    """One text per JSON value: float64 numbers, sorted keys. None when a number is outside float64."""
    if text is None:
        return None
    try:
        value = _CANONICAL.decode(text)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
