"""Interpolated modified Kneser-Ney bigram model.

Spark counts the bigrams of the training texts, dealt by a hash of the first word into buckets whose number follows the size of the
corpus. Each bucket is written to the shared folder as an array of sorted bigram hashes beside one of counts; words go likewise into shards
with their counts as token, as context and as continuation. Workers map these files into memory and look up a block of text at a time,
sorted, so no worker holds the model and the system's page cache is shared.

The shared folder (``spark.checkpoint.dir``) must be mounted on the workers, since files elsewhere can't be mapped. Words are told apart
by 48-bit hashes, bigrams by 64-bit ones.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch_of, prepared, whole_groups
from tidemark.llm.words import MULTIPLIER, SPACES, blocks, find_words, mix
from tidemark.session import scratch_dir

MASK = np.uint64((1 << 48) - 1)
BEGIN, END = mix(np.array([11, 13], np.uint64) * MULTIPLIER) & MASK
SHARDS = 256
BUCKET_BYTES = 4 << 20  # of training text for each bucket
HELD_PAIRS = 1 << 22  # tokens a task counts before it hands on
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_BLOB_DDL = "bucket int, kind int, data binary"
_FIELDS = ("c", "n1", "n2", "n3", "continuations")


@dataclass
class Model:
    folder: str
    buckets: int
    tokens: float
    types: float
    continuations: float
    high: tuple[float, ...]  # discounts of bigrams seen once, twice, more often
    low: tuple[float, ...]  # of continuation counts
    spare: float  # mass that the discounts of continuation counts leave to words never seen


def _narrow(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(raw: memoryview | bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's ended by ``END``; of the tokens before them; and where texts begin."""
    words = find_words(data, offsets, SPACES)
    n = len(offsets) - 1
    first = words.first + np.arange(n + 1)
    tokens = np.full(first[-1], END)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    tokens[inner] = words.hashes & MASK
    before = np.concatenate(([BEGIN], tokens[:-1]))
    before[first[:-1]] = BEGIN
    return tokens, before, first


def _merged(*keys: np.ndarray, counts: np.ndarray):
    """Distinct keys, sorted by the last one first, with summed counts."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return [k[begin] for k in keys], np.add.reduceat(counts[order], begin, axis=0) if len(begin) else counts


def _pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            before, token = (np.concatenate(x) for x in zip(*held))
            bucket = (mix(before) % np.uint64(buckets)).astype(np.int32)
            (token, before, bucket), count = _merged(token, before, bucket, counts=np.ones(len(token), np.int64))
            parts = -(-count // 255)  # a larger count is several rows, so that one byte holds it
            at = np.repeat(np.arange(len(count)), parts)
            small = np.full(len(at), 255, np.uint8)
            small[np.cumsum(parts) - 1] = (count - 255 * (parts - 1)).astype(np.uint8)
            token, before, bucket = token[at], before[at], bucket[at]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                own = slice(cut[b], cut[b + 1])
                if cut[b] == cut[b + 1]:
                    continue
                context, runs = np.unique(before[own], return_counts=True)
                rows.append((b, 0, np.array([len(context), len(token[own])], "<i8").tobytes() + _narrow(context) + runs.astype("<u4").tobytes() + _narrow(token[own]) + small[own].tobytes()))
            return batch_of(_BLOB, *map(list, zip(*rows)))

        for batch in batches:
            for _, _, offsets, data in blocks(batch.column(0)):
                token, before, _ = tokens_of(data, offsets)
                held.append((before, token))
                size += len(token)
                if size > HELD_PAIRS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _unpack(raw: bytes):
    contexts, n = np.frombuffer(raw, "<i8", 2)
    at = 16
    context = _wide(raw[at : (at := at + 6 * contexts)])
    runs = np.frombuffer(raw[at : (at := at + 4 * contexts)], "<u4")
    token = _wide(raw[at : (at := at + 6 * n)])
    return np.repeat(context, runs), token, np.frombuffer(raw[at:], np.uint8).astype(np.int64)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task may write it again."""
    os.makedirs(folder, exist_ok=True)
    spare = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(spare, "wb") as f:
        np.save(f, array)
    os.replace(spare, f"{folder}/{name}.npy")


def bigram_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before) * MULTIPLIER + token)


def _counted(folder: str):
    """Writes the arrays of each bucket; hands on what its words count as contexts (kind 0) and continuations (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            (word,), values = _merged(np.concatenate([w for w, _ in held]), counts=np.concatenate([v for _, v in held]))
            shard = (word >> np.uint64(40)).astype(np.int32)
            cut = np.searchsorted(shard, np.arange(SHARDS + 1))
            rows = []
            for s in range(SHARDS):
                for kind in (0, 1):
                    own = np.arange(cut[s], cut[s + 1])
                    own = own[values[own, 0] > 0] if kind == 0 else own[values[own, 0] == 0]
                    if len(own):
                        few = values[own] if kind == 0 else values[own, 4]
                        rows.append((s, kind, np.array([len(own)], "<i8").tobytes() + _narrow(word[own]) + few.astype("<u4").tobytes()))
            return batch_of(_BLOB, *map(list, zip(*rows)))

        for table in whole_groups(batches, "bucket"):
            buckets = table["bucket"].to_numpy()
            for bucket in np.unique(buckets):
                parts = [_unpack(table["data"][int(i)].as_py()) for i in np.flatnonzero(buckets == bucket)]
                before, token, count = (np.concatenate(x) for x in zip(*parts))
                (token, before), count = _merged(token, before, counts=count)
                key = bigram_keys(before, token)
                order = np.argsort(key)
                _save(folder, f"bigrams-{bucket}", key[order])
                _save(folder, f"counts-{bucket}", count[order].astype(np.min_scalar_type(int(count.max()))))
                tally = np.bincount(np.minimum(count, 5), minlength=6)
                yield batch_of(_BLOB, [SHARDS], [2], [tally[1:5].astype("<i8").tobytes()])
                begin = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
                classes = np.stack([count, count == 1, count == 2, count > 2], 1).astype(np.int64)
                stats = np.zeros((len(begin), 5), np.int64)
                stats[:, :4] = np.add.reduceat(classes, begin)
                word, times = np.unique(token, return_counts=True)
                follow = np.zeros((len(word), 5), np.int64)
                follow[:, 4] = times
                ends = np.array([[count[token == END].sum(), 0, 0, 0, 0]])
                held += [(before[begin], stats), (word, follow), (np.array([END]), ends)]
                size += len(begin) + len(word)
                if size > HELD_PAIRS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _words(folder: str):
    """Writes the arrays of each shard of words; gives sums for the model."""
    schema = pa.schema([(c, pa.int64()) for c in ("tokens", "types", "continuations", "h1", "h2", "h3", "h4", "l1", "l2", "l3", "l4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            shards, kinds = table["bucket"].to_numpy(), table["kind"].to_numpy()
            for shard in np.unique(shards):
                words, values = [], []
                tally = np.zeros(4, np.int64)
                for i in np.flatnonzero(shards == shard):
                    raw = table["data"][int(i)].as_py()
                    if kinds[i] == 2:
                        tally += np.frombuffer(raw, "<i8")
                        continue
                    n = int(np.frombuffer(raw, "<i8", 1)[0])
                    words.append(_wide(raw[8 : 8 + 6 * n]))
                    given = np.frombuffer(raw[8 + 6 * n :], "<u4").astype(np.int64)
                    full = np.zeros((n, 5), np.int64)
                    if kinds[i] == 0:
                        full[:] = given.reshape(n, 5)
                    else:
                        full[:, 4] = given
                    values.append(full)
                if not words:
                    yield batch_of(schema, *([x] for x in (0, 0, 0, *tally, 0, 0, 0, 0)))
                    continue
                (word,), value = _merged(np.concatenate(words), counts=np.concatenate(values))
                _save(folder, f"words-{shard}", word)
                _save(folder, f"values-{shard}", value.astype(np.min_scalar_type(int(value.max()))))
                real = (word != BEGIN) & (value[:, 0] > 0)
                low = np.bincount(np.minimum(value[:, 4], 5), minlength=6)[1:5]
                yield batch_of(schema, *([int(x)] for x in (value[real, 0].sum(), real.sum(), value[:, 4].sum(), 0, 0, 0, 0, *low)))

    return run


def _discounts(n1, n2, n3, n4) -> tuple[float, ...]:
    """Of counts one, two, three and more, from how many were seen how often; halves where too few were seen."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def fit(texts: DataFrame) -> Model:
    """A model of the column ``text``, in the shared folder."""
    spark = prepared(texts)
    path = scratch_dir(spark, "kneser-ney")
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError("spark.checkpoint.dir must be a folder that is mounted on the workers: arrays are mapped from it")
    folder = path.removeprefix("file://").removeprefix("file:")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    pairs = texts.select("text").mapInArrow(_pairs(buckets), _BLOB_DDL)
    contexts = pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted(folder), _BLOB_DDL)
    names = ("tokens", "types", "continuations", "h1", "h2", "h3", "h4", "l1", "l2", "l3", "l4")
    sums = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_words(folder), ", ".join(f"{c} long" for c in names))
    x = {c: v or 0 for c, v in zip(names, sums.agg(*(F.sum(c) for c in names)).first())}
    low = _discounts(*(x[f"l{k}"] for k in range(1, 5)))
    model = Model(folder, buckets, x["tokens"], x["types"], x["continuations"], _discounts(*(x[f"h{k}"] for k in range(1, 5))), low, 0.0)
    more = max(x["types"] - x["l1"] - x["l2"], 0)
    model.spare = (low[0] * x["l1"] + low[1] * x["l2"] + low[2] * more) / x["continuations"] if x["continuations"] else 1.0
    return model


class _Arrays:
    """Look-ups in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def _file(self, name: str):
        if name not in self.open:
            path = f"{self.model.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, part: np.ndarray, key: np.ndarray, keys: str, values: str, width: int) -> np.ndarray:
        """Values of ``key`` (sorted within sorted ``part``), zeros where it's unknown."""
        out = np.zeros((len(key), width), np.int64)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
        for a, b in zip(begin, [*begin[1:], len(part)]):
            sorted_keys, stored_values = self._file(f"{keys}-{part[a]}"), self._file(f"{values}-{part[a]}")
            if sorted_keys is None:
                continue
            at = np.minimum(np.searchsorted(sorted_keys, key[a:b]), len(sorted_keys) - 1)
            hit = np.flatnonzero(sorted_keys[at] == key[a:b])
            out[a + hit] = np.asarray(stored_values[at[hit]]).reshape(len(hit), width)
        return out


def _scored(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def discount(by: tuple[float, ...], count: np.ndarray) -> np.ndarray:
        return np.array((0.0, *by))[np.minimum(count, 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, m = _Arrays(model), model
        for batch in batches:
            for low, high, offsets, data in blocks(batch.column(2)):
                token, before, first = tokens_of(data, offsets)
                words = np.unique(np.append(token, BEGIN))
                value = arrays.find((words >> np.uint64(40)).astype(np.int64), words, "words", "values", 5)
                w, v = np.searchsorted(words, token), np.searchsorted(words, before)
                key, bucket = bigram_keys(before, token), (mix(before) % np.uint64(m.buckets)).astype(np.int64)
                (key_u, bucket_u), _ = _merged(key, bucket, counts=np.ones(len(key), np.int64))
                seen_u = arrays.find(bucket_u, key_u, "bigrams", "counts", 1)[:, 0]
                order = np.argsort(key_u)
                seen = seen_u[order][np.searchsorted(key_u[order], key)]
                c, n1, n2, n3, follow = value.T
                unigram = np.maximum(follow - discount(m.low, follow), 0) / max(m.continuations, 1) + m.spare / (m.types + 1)
                context = np.maximum(c, 1)
                back = np.where(c > 0, (m.high[0] * n1 + m.high[1] * n2 + m.high[2] * n3) / context, 1.0)
                p = np.maximum(seen - discount(m.high, seen), 0) / context[v] + back[v] * unigram[w]
                base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
                at = first[:-1]
                sums = [np.add.reduceat(x, at) for x in ((c > 0)[w].astype(np.int64), base[w], np.log10(p))]
                own = slice(low, high)
                yield batch_of(schema, batch.column(0)[own], batch.column(1)[own], np.diff(first), sums[0], np.full(high - low, int(m.tokens)), sums[1], sums[2])

    return run


def language_model_scores(documents: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score`` (log10
    probability of the text by the model) of every document; documents of ``fold`` aren't learned from.

    A null or empty text is one end token. Rows without ``doc_id`` are learned from. Repeated rows stay and count as often as they occur;
    other columns are ignored. Of an empty table nothing is learned and nothing returned.
    """
    prepared(documents)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    model = fit(rows.where(~F.col("held_out")))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
