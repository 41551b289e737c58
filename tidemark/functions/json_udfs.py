"""Arrow (vectorised) UDFs over JSON columns. Spark's own JSON readers accept trailing
text, rewrite numbers and replace lone surrogates, so they cannot decide validity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import json_text

_COLUMNS = ["fault", "payload_fault", "event_id", "event_type", "occurred_at", "payload", "tenant_id", "received_at"]
EVENT_STRUCT = T.StructType([T.StructField(c, T.StringType()) for c in _COLUMNS])
ITEM_STRUCT = T.StructType([*EVENT_STRUCT.fields, T.StructField("large", T.BooleanType())])


def parse_event(kind: str):
    """A UDF from a UTF-8 document (binary) to the fields and first broken rule; NULL stays NULL."""
    fields = json_text.ENVELOPE_FIELDS if kind == "envelope" else json_text.EVENT_FIELDS

    @F.pandas_udf(EVENT_STRUCT)
    def parse_event_strict(raw: pd.Series) -> pd.DataFrame:
        rows = [{} if b is None else json_text.read_event(b, fields) for b in raw]
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="object") for c in _COLUMNS})

    return parse_event_strict


SPLIT_STRUCT = T.StructType([T.StructField("fault", T.StringType()), T.StructField("items", T.ArrayType(T.BinaryType()))])


@F.pandas_udf(SPLIT_STRUCT)
def split_batch(raw: pd.Series) -> pd.DataFrame:
    """Raw item slices of a batch document, or the fault that spoils it."""
    pairs = [(None, None) if b is None else json_text.split_batch(b) for b in raw]
    return pd.DataFrame({c: pd.Series([p[i] for p in pairs], dtype="object") for i, c in enumerate(("fault", "items"))})


def parse_items(max_item_bytes: int):
    """A UDF from a batch's item slices to one parsed struct per item, in order."""

    @F.pandas_udf(T.ArrayType(ITEM_STRUCT))
    def parse_batch_items(items: pd.Series) -> pd.Series:
        def one(b):
            if len(b) > max_item_bytes:
                return {"large": True}
            return {**json_text.read_event(bytes(b), json_text.EVENT_FIELDS), "large": False}

        def row(group):
            return None if group is None else [{c: None for c in _COLUMNS} | one(b) for b in group]

        return pd.Series([row(g) for g in items], dtype="object")

    return parse_batch_items


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for s in text:
        if s not in seen:
            seen[s] = json_text.canonical(s)
        out.append(seen[s])
    return pd.Series(out, dtype="object")
