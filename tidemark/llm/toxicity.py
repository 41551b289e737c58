"""Toxic passages by maximum-scoring segments.

Log-odds of tokens between toxic and clean training texts (a token counts once a text) are shrunk by a Dirichlet prior in proportion to
the token's overall share.
Tokens are words and
beginnings of words; of those in a word the most significant one counts. Tokens whose log-odds are significant carry their log-odds; every other token carries the small negative log-odds of "no such token".
One linear scan of a text finds all maximal scoring segments. As scores are log likelihood ratios, a segment's score has the extreme-value
law P(S > s) = 1 - exp(-K n exp(-s)) in clean text of n tokens; K is estimated from clean training texts. A text's evidence is the
logarithm of one more than the sum of s - ln(K n) over its significant segments, and a logistic curve fitted to training labels turns it into a probability.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SMALL_ROWS, batch_of, prepared, stored, whole_groups
from tidemark.llm.kneser_ney import _save
from tidemark.llm.words import PUNCTUATION, blocks, find_words, prefixes
from tidemark.session import scratch_dir

PRIOR = 0.02  # weight of the Dirichlet prior against the counts: a token is expected in either class by its overall share
Z, LEAST = 5.0, 1.0  # signed root of the likelihood ratio statistic, and log-odds, from which a token counts
BLOCK = 1 << 20  # bytes of text worked on together
LEXICON = 100_000  # tokens of a model that is broadcast; a larger one is mapped from the shared folder
BIN = 1 / 32  # width of the evidence classes that the calibration counts
STEMS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are tokens too, for words that toxic texts inflect
MAX_BINS = 1_000  # evidence above BIN * MAX_BINS is one class


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    z: np.ndarray
    other: float
    log_k: float = 0.0
    slope: float = 1.0
    middle: float = 0.0
    folder: str = ""  # of the arrays, where the tokens are too many to broadcast

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Significance and score of tokens, zeros of those that aren't listed."""
        if not self.folder:
            return _looked_up(h, self.hashes, np.stack([self.z, self.scores], 1))
        h, back = np.unique(h, return_inverse=True)
        out = np.zeros((2, len(h)))
        cut = np.searchsorted(h >> np.uint64(56), np.arange(257))
        for shard in np.flatnonzero(np.diff(cut)):
            tokens = _mapped(f"{self.folder}/tokens-{shard}.npy")
            if tokens is not None:
                own = slice(cut[shard], cut[shard + 1])
                out[:, own] = _looked_up(h[own], tokens, _mapped(f"{self.folder}/values-{shard}.npy"))
        return out[0][back], out[1][back]


@lru_cache(maxsize=2 * 256)
def _mapped(path: str):
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _looked_up(h: np.ndarray, tokens: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(h)))
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
        hit = np.flatnonzero(tokens[at] == h)
        out[:, hit] = values[at[hit]].T
    return out[0], out[1]


def maximal_segments(places, scores, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a sequence that scores ``other`` (below 0) but at ``places``.

    Candidates stand in a stack with the cumulative score before and after each; every candidate knows the nearest earlier one that begins
    lower, so each is looked at a constant number of times in all.
    """
    begin, end, low, high, link = [], [], [], [], []
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        total += other * (place - at)
        at = place + 1
        b, e, lo, hi = place, place, total, total + score
        total = hi
        j = len(begin) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            b, lo = begin[j], low[j]
            for stack in (begin, end, low, high, link):
                del stack[j:]
            j = j - 1
        begin.append(b), end.append(e), low.append(lo), high.append(hi), link.append(j)
    return [(b, e, hi - lo) for b, e, lo, hi in zip(begin, end, low, high)]


def _shards(folder: str):
    """Writes the listed tokens of each shard as sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shards, h = table["shard"].to_numpy(), table["h"].to_numpy().view(np.uint64)
            values = np.stack([table["z"].to_numpy(), table["delta"].to_numpy()], 1)
            for shard in np.unique(shards):
                own = np.flatnonzero(shards == shard)
                own = own[np.argsort(h[own])]
                _save(folder, f"values-{shard}", values[own])
                _save(folder, f"tokens-{shard}", h[own])
                yield batch_of(pa.schema([("n", pa.int64())]), [len(own)])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("h", "toxic", "clean", "toxic_all", "clean_all")])
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for low, high, offsets, data in blocks(batch.column(0), BLOCK):
            words = find_words(data, offsets, PUNCTUATION)
            if not len(words.hashes):
                continue
            doc = np.repeat(np.arange(high - low), words.counts())
            tokens = [(words.hashes, doc), *((h, doc[own]) for h, own in (prefixes(data, words, k) for k in STEMS))]
            tokens, doc = (np.concatenate(x) for x in zip(*tokens))
            order = np.lexsort((doc, tokens))
            tokens, doc = tokens[order], doc[order]
            begin = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(np.concatenate((begin, [len(tokens)])))
            toxic = label[low:high][doc[begin]]
            h, back = np.unique(tokens[begin], return_inverse=True)
            weighed = [np.bincount(back, w, len(h)).astype(np.int64) for w in (toxic, 1 - toxic, toxic * times, (1 - toxic) * times)]
            yield batch_of(schema, h.view(np.int64), *weighed)


def _hits(data: np.ndarray, words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Word places with a listed token, and the scores of their most significant one."""
    n = len(words.hashes)
    best, scores = np.zeros(n), np.zeros(n)
    for h, own in [(words.hashes, np.arange(n)), *(prefixes(data, words, k) for k in STEMS)] if n and (model.folder or len(model.hashes)) else []:
        z, found = model.find(h)
        better = z > best[own]
        best[own[better]], scores[own[better]] = z[better], found[better]
    hit = np.flatnonzero(best)
    return hit, scores[hit]


def _scanned(texts: pa.Array, model: Model):
    """(row, words of the text, segments by word place, words of the block, bytes) for each text."""
    for low, high, offsets, data in blocks(texts, BLOCK):
        words = find_words(data, offsets, PUNCTUATION)
        places, scores = _hits(data, words, model)
        cut = np.searchsorted(places, words.first)
        for d in range(high - low):
            own = slice(cut[d], cut[d + 1])
            segments = []
            if cut[d] < cut[d + 1]:
                first = words.first[d]
                segments = maximal_segments((places[own] - first).tolist(), scores[own].tolist(), model.other)
            yield low + d, int(words.first[d + 1] - words.first[d]), segments, words, offsets, data, d


def evidence(n: int, segments, log_k: float) -> float:
    """The logarithm of one more than the summed excess over the level that one segment of a clean text reaches."""
    level = log_k + math.log(max(n, 1))
    return math.log1p(sum(max(0.0, s - level) for _, _, s in segments))


def _training(documents: DataFrame, labels: DataFrame, folds: int, fold: int) -> DataFrame:
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    if marked.count() <= SMALL_ROWS:
        marked = F.broadcast(marked)
    return documents.select("doc_id", "text").join(marked, "doc_id").select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """A model from every labelled document outside ``fold``; exact copies of a text with one label weigh as one, near copies in full.

    The driver gets a lexicon of up to ``LEXICON`` tokens and counts by evidence class only.
    """
    spark = prepared(documents)
    train = _training(documents, labels, folds, fold)
    train = stored(train.groupBy(F.xxhash64("text").alias("copy"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-training")
    names = ("toxic", "clean", "toxic_all", "clean_all")  # texts with the token, and occurrences
    counts = train.mapInArrow(_counts, ", ".join(["h long", *(f"{c} long" for c in names)])).groupBy("h").agg(*(F.sum(c).alias(c) for c in names))
    counts = stored(counts, "toxicity-counts")
    n1, n0, all1, all0 = (x or 0 for x in counts.agg(*(F.sum(F.col(c).cast("double")) for c in names)).first())
    model = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -0.01)
    if n1 and n0:
        share1, share0 = n1 / (n1 + n0), n0 / (n1 + n0)
        ratio = f"toxic * ln(toxic / ({share1} * (toxic + clean))) + CASE WHEN clean > 0 THEN clean * ln(clean / ({share0} * (toxic + clean))) ELSE 0 END"
        odds = counts.where("toxic > 0").withColumn("z", F.expr(f"CASE WHEN toxic > {share1} * (toxic + clean) THEN sqrt(2 * greatest({ratio}, 0)) ELSE 0 END"))
        prior = f"{PRIOR} * (toxic_all + clean_all)"
        odds = odds.where(f"z >= {Z}").withColumn("t", F.expr(f"toxic_all + {all1 / (all1 + all0)} * {prior}")).withColumn("c", F.expr(f"clean_all + {all0 / (all1 + all0)} * {prior}"))
        odds = odds.withColumn("delta", F.expr(f"ln(t / ({all1 * (1 + PRIOR)} - t)) - ln(c / ({all0 * (1 + PRIOR)} - c))")).where(f"delta >= {LEAST}")
        odds = stored(odds.select("h", "delta", "z"), "toxicity-lexicon")
        if odds.count() <= LEXICON:
            best = odds.toArrow()
            h, delta, z = (best[c].to_numpy() for c in ("h", "delta", "z"))
            order = np.argsort(h.view(np.uint64))
            model = Model(h.view(np.uint64)[order], delta[order], z[order], -0.01)
        else:
            path = scratch_dir(spark, "toxicity-tokens")
            if "://" in path and not path.startswith("file://"):
                raise RuntimeError("spark.checkpoint.dir must be a folder that is mounted on the workers: arrays are mapped from it")
            model.folder = path.removeprefix("file://").removeprefix("file:")
            shards = odds.withColumn("shard", F.shiftrightunsigned("h", 56).cast("int")).repartition("shard").sortWithinPartitions("shard")
            shards.mapInArrow(_shards(model.folder), "n long").agg(F.sum("n")).first()
    shared = spark.sparkContext.broadcast(model)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and listed words, by label."""
        schema = pa.schema([(c, pa.int64()) for c in ("w1", "h1", "w0", "h0")])
        for batch in batches:
            toxic, tally = batch.column(1).to_numpy(zero_copy_only=False), np.zeros((2, 2), np.int64)
            for low, high, offsets, data in blocks(batch.column(0), BLOCK):
                words = find_words(data, offsets, PUNCTUATION)
                hits = np.diff(np.searchsorted(_hits(data, words, shared.value)[0], words.first))
                for label in (0, 1):
                    own = toxic[low:high] == label
                    tally[label] += words.counts()[own].sum(), hits[own].sum()
            yield batch_of(schema, *([x] for x in (*tally[1], *tally[0])))

    w1, h1, w0, h0 = (x or 0 for x in train.mapInArrow(listed, "w1 long, h1 long, w0 long, h0 long").agg(*(F.sum(c) for c in ("w1", "h1", "w0", "h0"))).first())
    if h1 and w0:
        model.other = min(-1e-4, math.log(max(1 - h1 / w1, 1e-6)) - math.log(max(1 - h0 / w0, 1e-6)))
    shared = spark.sparkContext.broadcast(model)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean texts: exceedances n exp(-s) that the law weighs, summed."""
        schema = pa.schema([("texts", pa.int64()), ("weight", pa.float64())])
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            texts, weight = 0, 0.0
            for row, n, segments, *_ in _scanned(batch.column(0), shared.value):
                if not toxic[row] and n:
                    texts += 1
                    weight += n * math.exp(-max((s for _, _, s in segments), default=0.0))
            yield batch_of(schema, [texts], [weight])

    # P(max <= s) = exp(-K n exp(-s)): the likelihood of K over clean texts is greatest at texts / sum of n exp(-s)
    seen = train.mapInArrow(maxima, "texts long, weight double").agg(F.sum("texts"), F.sum("weight")).first()
    model.log_k = math.log(seen[0] / seen[1]) if seen[0] and seen[1] else 0.0
    shared = spark.sparkContext.broadcast(model)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bin", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            tally: dict[int, list[int]] = {}
            for row, n, segments, *_ in _scanned(batch.column(0), shared.value):
                tally.setdefault(min(MAX_BINS, int(evidence(n, segments, shared.value.log_k) / BIN)), [0, 0])[0 if toxic[row] else 1] += 1
            yield batch_of(schema, list(tally), [t for t, _ in tally.values()], [c for _, c in tally.values()])

    seen = train.mapInArrow(classes, "bin long, toxic long, clean long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    model.slope, model.middle = _curve(seen["bin"].to_numpy(float) * BIN, seen["toxic"].to_numpy(float), seen["clean"].to_numpy(float))
    return model


def _curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve; one pseudo-count at either end keeps it finite when classes are separable."""
    if not len(x) or not toxic.sum() or not clean.sum():
        return 1.0, 2.0
    x, toxic, clean = np.append(x, [0.0, x.max() + 1]), np.append(toxic, [0.5, 0.5]), np.append(clean, [0.5, 0.5])
    a, b, n = 0.0, math.log(toxic.sum() / clean.sum()), toxic + clean
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(x * (toxic - n * p)).sum() - 1e-3 * a, (toxic - n * p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return (a, -b / a) if a > 1e-6 else (1.0, 2.0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``passages`` (start, stop in characters, score, p_value) of each document.

    Null and empty texts have no passage and the score of no evidence. Repeated rows and null ids stay; other columns are ignored.
    """
    spark = prepared(documents)
    shared = spark.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for _, n, segments, words, offsets, data, d in _scanned(batch.column(1), m):
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * (evidence(n, segments, m.log_k) - m.middle))))))
                found = []
                for a, b, s in segments:
                    rate = math.exp(m.log_k) * n * math.exp(-s)
                    if rate < 1:  # above the level that one segment of a clean text reaches
                        low, start, stop = offsets[d], words.starts[words.first[d] + a], words.ends[words.first[d] + b]
                        before = int(((data[low:start] & 0xC0) != 0x80).sum())
                        found.append({"start": before, "stop": before + int(((data[start:stop] & 0xC0) != 0x80).sum()), "score": s, "p_value": -math.expm1(-rate)})
                passages.append(found)
            yield batch_of(schema, batch.column(0).cast(pa.int64()), scores, passages)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, stop: long, score: double, p_value: double>>")


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Scores of all documents by a model that has not seen the labels of ``fold``."""
    out = score(documents, fit(documents, labels, folds, fold))
    held = F.crc32(F.col("doc_id").cast("string")) % folds == fold
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
