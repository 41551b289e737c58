"""Words of whole texts as 64-bit hashes, computed with numpy inside Spark tasks.

A batch of texts arrives as one Arrow buffer. Words are found with byte tables and hashed together, so a task spends a few
nanoseconds a byte and never builds a Python string per word. Two different words share a hash with probability 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 22  # bytes of text worked on together; a longer text is still taken whole
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes that separate words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))
PUNCTUATION = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # all of ASCII but letters and digits


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), MULTIPLIER)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """``first[d]`` to ``first[d + 1]`` are the words of text ``d``; starts and ends are byte places in the block."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets, bytes) of runs of rows of at most ``size`` bytes or one row; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(places, places[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, places[at : to + 1] - places[at], data[places[at] : places[to]]
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    """The words of the texts that ``offsets`` cut out of ``data``; ``lower`` folds A-Z only."""
    n = len(data)
    inside = ~separators[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finishes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = np.empty(len(starts), np.uint64)
    values = _VALUES_LOWER if lower else _VALUES
    powers = _powers_to(int((ends - starts).max(initial=0)) + 1)
    at = 0
    while at < len(starts):  # a block of words at a time, so that a very long text needs no long array of 8-byte values
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        low, high = starts[at], ends[to - 1]
        lengths = ends[at:to] - starts[at:to]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = values[data[low:high][inside[low:high]]] * powers[within]
        hashes[at:to] = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        at = to
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, offsets))


def sequences(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words within one text, and where each text's runs begin.

    A text of fewer words, but not none, has one run: all its words.
    """
    n = len(hashes)
    counts = np.diff(first)
    kept = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(kept)))
    at = np.repeat(first[:-1] - begin[:-1], kept) + np.arange(begin[-1])
    size = np.minimum(length, np.repeat(counts, kept))
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        more = size > j
        step = mix(out * MULTIPLIER + hashes[np.minimum(at + j, n - 1)] + np.uint64(j + 1)) if n else out
        out = np.where(more, step, out)
    return out, begin


def prefixes(data: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes, A-Z folded, of the words that are that long; and which words those are."""
    long = np.flatnonzero(words.ends - words.starts >= size)
    powers, sums = _powers_to(size), np.full(len(long), size * int(MULTIPLIER) % 2**64, np.uint64)
    for j in range(size):
        sums += _VALUES_LOWER[data[words.starts[long] + j]] * powers[j]
    return mix(sums), long
