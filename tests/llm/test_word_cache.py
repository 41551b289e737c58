"""The cache of word tokens: right ids over many blocks, few bytes a word."""

import random
import tracemalloc

import numpy as np

from tidemark.llm import packing
from tidemark.llm.words import SPACES, find_words


def words_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, find_words(data, np.array([0, len(data)], np.int64), SPACES, lower=False)


def test_cached_words_keep_their_tokens(monkeypatch):
    monkeypatch.setattr(packing, "CALL_WORDS", 7)
    monkeypatch.setattr(packing, "CACHE_WORDS", 150)
    rng, cache = random.Random(2), packing.WordTokens(packing.VOCABULARY)
    for _ in range(8):
        text = " ".join(f"w{rng.randrange(200)} é{rng.randrange(9)}" for _ in range(60))
        data, words = words_of(text)
        rows = cache.rows(data, words)
        got = [i for r in rows for i in cache.flat[cache.begin[r] : cache.end[r]].tolist()]
        assert got == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_takes_few_bytes_a_word():
    cache, n = packing.WordTokens(packing.VOCABULARY), 200_000
    data, words = words_of(" ".join(str(i) for i in range(n)))
    tracemalloc.start()
    cache.rows(data, words)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 70 * n
