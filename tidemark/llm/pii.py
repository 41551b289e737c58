"""Personal data by gradient boosting over proposed spans.

Base patterns give spans that always count. Generous generators propose further spans, overlapping ones too: numbers grouped in other ways,
telephone numbers without a plus sign, obfuscated addresses, longer addresses of hosts. Boosted trees judge format and context of a span.
They learn from the corpus itself: base spans, and the same spans rewritten in the other formats, are positive; proposals that no base
pattern confirms are negative. For each kind the threshold is the least probability at which held-out proposals keep the asked precision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch_of, prepared, stored

KINDS = ("email", "ip", "card", "phone")
MAX_TRAINING = 20_000  # rows of either label that the trees are fitted on
TREES, DEPTH = 12, 3
PRECISION = 0.98
CLASSES = 200  # of probability, counted to set thresholds

# Fixed patterns of the base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

# Generators: (kind, what the text must hold, pattern).
_PROPOSALS = (
    ("email", "at", re.compile(r"[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\]|\{at\}| at )[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)[ ]?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("ip", "hex", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", "digit", re.compile(r"(?<![0-9])[0-9]{1,3}(?:[ ]?\.[ ]?[0-9]{1,3}){3}(?![0-9])")),
    ("card", "digit", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./-]{1,2}[0-9]{2,7}){2,5}(?![0-9])")),
    ("card", "digit", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", "digit", re.compile(r"(?<![0-9])(?:(?:00|\+)?[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,5}){1,3}(?![0-9])")),
    ("phone", "digit", re.compile(r"(?<![0-9])(?:00|0)?[0-9]{2,4}(?:[ ./-][0-9]{2,5}){2,4}(?![0-9])")),
)
_CUES = {"email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I), "card": re.compile(r"card|visa|credit|konto|carte|tarjeta", re.I), "phone": re.compile(r"phone|tel|call|fax|mobil|whatsapp", re.I)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by the base rules, in order."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def proposals(text: str) -> list[tuple[int, int, int]]:
    lower = text.lower()
    digit = bool(_DIGIT.search(text))
    holds = {"digit": digit, "hex": digit and ":" in text, "at": "(at)" in lower or "[at]" in lower or "{at}" in lower or (" at " in lower and "dot" in lower)}
    found = {(m.start(), m.end(), KINDS.index(kind), len(_digits(m[0]))) for kind, need, pattern in _PROPOSALS if holds[need] for m in pattern.finditer(text)}
    least = (0, 0, 13, 9)  # digits of a kind
    return sorted((a, b, k) for a, b, k, n in found if n >= least[k] and (k < 2 or n <= 19))


def features(span: str, kind: int, before: str, after: str) -> list[float]:
    """Of format: lengths, groups, separators, checks. Of context: what stands beside, and words that announce the kind."""
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    edge = lambda c: 0.0 if not c or c.isspace() else 1.0 if c in ".,;:!?)\"'" else 2.0 if not c.isalnum() else 3.0
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[-1]),
        float(bool(digits) and luhn(digits)), float(span[:1] == "+"), float("(" in span), float("@" in span), float(span.count(".")), float(span.count("-")), float(span.count(" ")), float(span.count(":")), float(span.count("/")),
        float(len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)), float(len(set(digits))), float(len(set(sizes)) == 1), edge(before[-1:]), edge(after[:1]),
        *(float(bool(cue.search(before))) for cue in _CUES.values()),
    ]


def rewritten(span: str, kind: int) -> list[str]:
    """The same datum in formats that the base rules don't know."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} at {domain.replace('.', ' dot ')}"]
    if kind == 1:
        n = [int(x) for x in span.split(".")]
        return [span.replace(".", " . "), f"2001:db8:{n[0]:x}:{n[1]:x}:{n[2]:x}:{n[3]:x}:1:2"]
    d = _digits(span)
    if kind == 2:
        four = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [".".join(four), "/".join(four), " - ".join(four)[: len(d) + 3 * len(four)]]
    own = d[-10:]
    return [f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"00{d[:-10] or '1'} {own[:3]} {own[3:6]} {own[6:]}"]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_ROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float32()))])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("proposed", pa.list_(_ROW)), ("others", pa.list_(_ROW))])
_SPAN_DDL, _ROW_DDL = "struct<start: long, end: long, kind: int>", "struct<start: long, end: long, kind: int, label: int, x: array<float>>"


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans; proposals that aren't base spans; and rows for training that aren't proposals."""
    for batch in batches:
        base_column, rows, others = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            known, own, extra = set(base), [], []
            near = lambda a, b: (text[max(0, a - 40) : a], text[b : b + 2])
            for a, b, k in proposals(text):
                if (a, b, k) not in known:
                    own.append({"start": a, "end": b, "kind": k, "label": 0, "x": features(text[a:b], k, *near(a, b))})
            for a, b, k in base:
                extra += [{"start": a, "end": b, "kind": k, "label": 1, "x": features(s, k, *near(a, b))} for s in (text[a:b], *rewritten(text[a:b], k))]
            base_column.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            rows.append(own)
            others.append(extra)
        yield batch_of(_FOUND, batch.column(0), base_column, rows, others)


def _nodes(node) -> list[tuple]:
    """A tree as (feature, threshold, left, right, value) rows; a leaf has feature -1."""
    out: list[tuple] = []

    def put(n) -> int:
        at = len(out)
        out.append(())
        if n.subtreeDepth() == 0:
            out[at] = (-1, 0.0, 0, 0, n.prediction())
        else:
            left, right = put(n.leftChild()), put(n.rightChild())
            out[at] = (n.split().featureIndex(), n.split().threshold(), left, right, 0.0)
        return at

    put(node)
    return out


def probabilities(trees, x: np.ndarray) -> np.ndarray:
    margin = np.zeros(len(x))
    for weight, nodes in trees:
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            goes = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
            at = np.where(f < 0, at, np.where(goes, left[at], right[at]))
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def personal_data(documents: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``doc_id``, ``base`` (spans of the base rules) and ``added`` (of the trees): arrays of (start, end, kind) in characters.

    An added span never overlaps a base span, nor a likelier added one. A null text is empty. Repeated rows and null ids stay; other
    columns are ignored. Without base spans nothing can be learned, so nothing is added.
    """
    spark = prepared(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(rows.mapInArrow(_proposed, f"doc_id long, base array<{_SPAN_DDL}>, proposed array<{_ROW_DDL}>, others array<{_ROW_DDL}>"), "pii-spans")
    examples = found.select(F.explode(F.concat("proposed", "others")).alias("e")).select("e.*").withColumn("u", F.xxhash64("x", "start"))
    counts = {r.label: r.n for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    trees, limits = [], [2.0] * len(KINDS)
    if counts.get(1, 0) and counts.get(0, 0):
        # a bounded sample, by hash: as many rows of either label at any size of the corpus
        share = F.when(F.col("label") == 1, min(1.0, MAX_TRAINING / counts[1])).otherwise(min(1.0, MAX_TRAINING / counts[0]))
        held = F.pmod("u", F.lit(4)) == 0
        sample = stored(examples.where(~held & (F.pmod(F.hash("u"), F.lit(1 << 20)) < share * (1 << 20))).select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("x").cast("array<double>")).alias("x")), "pii-sample")
        if sample.select("label").distinct().count() == 2:
            model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(sample)
            trees = [(w, _nodes(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
            limits = _thresholds(examples.where(held), trees, precision)
    shared = spark.sparkContext.broadcast((trees, limits))
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("added", pa.list_(_SPAN))])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, limits = shared.value
        for batch in batches:
            added = []
            for base, proposed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                taken, own = [(s["start"], s["end"]) for s in base], []
                if proposed and trees:
                    p = probabilities(trees, np.array([r["x"] for r in proposed]))
                    for i in sorted(range(len(p)), key=lambda i: (-p[i], proposed[i]["start"] - proposed[i]["end"], proposed[i]["start"])):
                        r = proposed[i]
                        if p[i] >= limits[r["kind"]] and not any(a < r["end"] and r["start"] < b for a, b in taken):
                            taken.append((r["start"], r["end"]))
                            own.append({k: r[k] for k in ("start", "end", "kind")})
                added.append(sorted(own, key=lambda s: s["start"]))
            yield batch_of(schema, batch.column(0), batch.column(1), added)

    return found.select("doc_id", "base", "proposed").mapInArrow(select, f"doc_id long, base array<{_SPAN_DDL}>, added array<{_SPAN_DDL}>")


def _thresholds(held: DataFrame, trees, precision: float) -> list[float]:
    """For each kind the least probability from which held-out rows keep ``precision``; beyond 1 where none does."""
    schema = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("label", pa.int32())])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                yield batch_of(schema, batch.column(1), np.minimum(probabilities(trees, x) * CLASSES, CLASSES - 1).astype(np.int32), batch.column(2))

    seen = held.select("x", "kind", "label").mapInArrow(classes, "kind int, at int, label int").groupBy("kind", "at").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).toPandas()
    out = []
    for kind in range(len(KINDS)):
        own = seen[seen["kind"] == kind].sort_values("at", ascending=False)
        good = own["hit"].cumsum() >= precision * own["n"].cumsum()
        out.append(float(own["at"][good].min()) / CLASSES if good.any() else 2.0)
    return out


def spans_text(column: str) -> str:
    """SQL for kind:start:end of an array of spans, by start, then kind as listed."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({column}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.kind < b.kind THEN -1 WHEN a.kind > b.kind THEN 1 ELSE 0 END), s -> concat(element_at(array({kinds}), s.kind + 1), ':', s.start, ':', s.end)), ',')"
