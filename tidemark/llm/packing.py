"""Packing along a space-filling curve.

Hashed token vectors of documents are projected to a few dimensions; documents are range-sorted by the Hilbert key of the projection and
packed in that order, so that the pieces of one sequence come from alike documents. Documents are cut wherever a sequence is full. What is
left at the end of a range is cut at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch_of, prepared, stored
from tidemark.llm.words import MULTIPLIER, SPACES, blocks, find_words, mix

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
DIMENSIONS, BITS = 4, 15  # of the curve
HASHED = 512  # of the document vector
CACHE_WORDS = 1 << 20  # words whose tokens a worker keeps
CALL_WORDS = 1 << 13  # words tokenised in one call: what a call allocates stays with the worker
BLOCK = 1 << 21  # bytes of text worked on together

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _projection() -> np.ndarray:
    """A fixed Gaussian matrix, the same on every machine."""
    u = mix(np.arange(1, 2 * HASHED * DIMENSIONS + 1, dtype=np.uint64) * MULTIPLIER) / 2.0**64
    u, v = np.maximum(u[: HASHED * DIMENSIONS], 1e-12), u[HASHED * DIMENSIONS :]
    return (np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)).reshape(HASHED, DIMENSIONS)


def hilbert_key(places: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of unsigned coordinates below ``2 ** bits``."""
    x = places.astype(np.uint64)
    n, d = x.shape
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, d - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.view(np.int64)


def curve_places(ids: np.ndarray, cuts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Of texts whose token ids lie between ``cuts``."""
    n, known = len(cuts) - 1, np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64)
    hashed = mix((known + np.uint64(1)) * MULTIPLIER)
    bucket, sign = (hashed % np.uint64(HASHED)).astype(np.int64), np.where(hashed >> np.uint64(63), 1.0, -1.0)
    doc = np.repeat(np.arange(n) * HASHED, np.diff(cuts))
    vectors = np.bincount(doc + bucket[ids], sign[ids], n * HASHED).astype(float).reshape(n, HASHED)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = 1 / (1 + np.exp(-1.702 * (vectors @ projection)))  # near the normal distribution function, so places fill the cube
    return hilbert_key(np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.uint64), BITS)


class WordTokens:
    """Token ids of words, each tokenised once; a tokenizer that never joins across white space gives the ids of the whole text."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self):
        # hashes in order and the row of each: 16 bytes a word, where a dictionary takes over 100
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin, self.end = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, words) -> np.ndarray:
        """The row of each word in the cache."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        fresh = np.flatnonzero(new)
        row = np.empty(len(unique), np.int64)
        row[~new] = self.place[at[~new]]
        row[fresh] = len(self.begin) + np.arange(len(fresh))
        flat, begin, end, size = [self.flat], [self.begin], [self.end], len(self.flat)
        for low in range(0, len(fresh), CALL_WORDS):
            some = first[fresh[low : low + CALL_WORDS]]
            texts = [data[words.starts[f] : words.ends[f]].tobytes().decode("utf-8", "replace") for f in some]
            # one call for many words: an encoding for each would cost more than its tokens
            found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))
            ends = size + np.cumsum(sizes)
            flat.append(np.array(found.ids, self.dtype))
            begin.append(ends - sizes)
            end.append(ends)
            size += len(flat[-1])
        if len(fresh):
            self.flat, self.begin, self.end = np.concatenate(flat), np.concatenate(begin), np.concatenate(end)
            self.known, self.place = np.insert(self.known, at[fresh], unique[fresh]), np.insert(self.place, at[fresh], row[fresh])
        return row[back]


_caches: dict[str, WordTokens] = {}


def word_tokens(vocabulary: str) -> WordTokens:
    """The cache of this worker, kept from task to task."""
    if vocabulary not in _caches:
        _caches[vocabulary] = WordTokens(vocabulary)
    return _caches[vocabulary]


def _tokenised(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, projection = word_tokens(vocabulary), _projection()
        schema = pa.schema([("curve", pa.int64()), ("doc_id", pa.int64()), ("check", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for low, high, offsets, data in blocks(batch.column(1), BLOCK):
                words = find_words(data, offsets, SPACES, lower=False)
                row = cache.rows(data, words)
                size = cache.end[row] - cache.begin[row]
                total = np.concatenate(([0], np.cumsum(size)))
                at = np.repeat(cache.begin[row] - total[:-1], size) + np.arange(total[-1])
                ids = cache.flat[at].astype(cache.dtype)
                cuts = total[words.first]
                texts = [np.append(ids[a:b], cache.dtype(end_id)).tobytes() for a, b in zip(cuts, cuts[1:])]
                check = [len(t) for t in texts]
                yield batch_of(schema, curve_places(ids, cuts, projection), batch.column(0).slice(low, high - low).cast(pa.int64()), check, texts)

    return run


def _powers(size: int) -> list[int]:
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


def _packed(capacity: int, dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, filled = 0, 0
        held: list[tuple] = []  # pieces of the open sequence: at most one for each of its places
        done: list[tuple] = []

        def put(out):
            return batch_of(_PIECES, *map(list, zip(*out)))

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start = 0
                while start < len(ids):
                    length = min(capacity - filled, len(ids) - start)
                    held.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), base + sequence, filled))
                    start, filled = start + length, filled + length
                    if filled == capacity:
                        done += held
                        held, filled, sequence = [], 0, sequence + 1
            if len(done) > 1000:
                yield put(done)
                done = []
        sizes, used = _powers(filled), 0
        for doc_id, start, length, raw, total, _, _ in held:  # the open sequence is cut anew, into full ones
            while length:
                part = min(length, sizes[0] - used)
                done.append((doc_id, start, part, raw[: 4 * part], total, base + sequence, used))
                start, length, raw, used = start + part, length - part, raw[4 * part :], used + part
                if used == sizes[0]:
                    sizes, used, sequence = sizes[1:], 0, sequence + 1
        if done:
            yield put(done)

    return run


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of token sequences: ``doc_id``, ``start`` and ``length`` within its document, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` within its sequence.

    ``vocabulary`` is a tokenizer file (a name of a public one, or a path that workers can open). A null or empty text is the end id
    alone. Repeated rows are packed as often as they occur, rows without ``doc_id`` too; other columns are ignored. Ties on the curve
    are dealt by ``doc_id``, so a large group of copies is split over ranges. Sequence ids have gaps between ranges.
    """
    prepared(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenised(vocabulary, end_id), "curve long, doc_id long, check long, ids binary")
    rows = stored(rows, "packing-tokens")  # so that finding the ranges doesn't tokenise again
    dealt = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "check", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(_packed(capacity, word_tokens(vocabulary).dtype), _PIECES_DDL)
