"""Substring dedup by difference-cover anchors.

Every run of ``window`` words that also starts in a document with a smaller ``doc_id`` goes. Word places are read modulo a period, and shorter
runs (anchors) are hashed only where that remainder is in a difference cover. Any two remainders differ by the difference of two members of the
cover, so two copies of one window, wherever they stand in their documents, share an anchor at the same place within the window.

1. Anchors of all documents are grouped; those of two or more documents are shared.
2. A shared anchor is extended to all windows around it, and those are hashed. Windows without a shared anchor occur once.
3. The smallest document of each window keeps it. Within a task, and against windows the task met before, this is settled at once, so a window
   that a third of all documents hold is a few rows of each task when it is shuffled.
4. Removed places come back to their documents as runs of starts.

Tasks know shared anchors by a bit set. Its size follows their number up to a bound; false hits only cost rows, which fall away in step 3.
Beyond some 10^8 shared anchors the set gets fuller and more windows are hashed for nothing, up to one row a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch_of, bit_set, in_bit_set, prepared, row_schema, stored
from tidemark.llm.words import MULTIPLIER, blocks, find_words, mix

WINDOW = 50
# Difference covers by period; every remainder is a difference of two members.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
BLOCK = 1 << 20  # bytes of text worked on together
REMEMBERED = 1 << 20  # windows that a task remembers as met in several documents
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period, with its cover, that leaves an anchor at least a third of the window; period 1 for very short windows."""
    fit = [p for p in COVERS if 3 * (window - p + 1) >= window]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class Runs:
    """Hashes of runs of any length of the words of a block, from running sums of ``word * base ** place``."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.back = [], []
        for k, base in enumerate(_BASES):
            up, down = np.full(n + 1, base), np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)))
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            own = words if not k else mix(words ^ MULTIPLIER)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * up[:n], dtype=np.uint64))))
            self.back.append(down)

    def hashes(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """64 bits, and 32 more, of the runs of ``length`` words that begin ``at``."""
        a, b = ((s[at + length] - s[at]) * back[at] for s, back in zip(self.sums, self.back))
        b = mix(b)
        return mix(a + b), (b >> np.uint64(33)).astype(np.int32)


def _anchors(first: np.ndarray, window: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place in the block, text) of the anchors of texts of at least ``window`` words, and their length."""
    period, cover = cover_of(window)
    length = window - period + 1
    counts = np.where((np.diff(first) >= window) & usable, np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = np.isin(place % period, cover)
    return (place + first[:-1][text])[chosen], text[chosen], length


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0)
    return ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid())


def _anchor_rows(window: int):
    """(h, low, high): each anchor of a block of texts with its smallest and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
        for batch in batches:
            ids, usable = _ids(batch)
            for at, to, offsets, data in blocks(batch.column(1), BLOCK):
                words = find_words(data, offsets, lower=False)
                place, text, length = _anchors(words.first, window, usable[at:to])
                if not len(place):
                    continue
                h = Runs(words.hashes).hashes(place, length)[0].view(np.int64)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], ids[at:to][text[order]]
                begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                yield batch_of(schema, h[begin], np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin))

    return run


def shared_anchors(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h): anchors that occur in two documents or more; ``documents`` has ``doc_id`` (long) and ``text``."""
    rows = documents.mapInArrow(_anchor_rows(window), "h long, low long, high long")
    return rows.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h")


class _Met:
    """Windows that a task met in several documents, with the smallest of them; of a bounded number, since it only saves rows."""

    def __init__(self):
        self.h, self.low = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def low_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), np.iinfo(np.int64).max)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.low[at], np.iinfo(np.int64).max)

    def add(self, h: np.ndarray, low: np.ndarray) -> None:
        if len(self.h) + len(h) > REMEMBERED:
            self.__init__()
            h, low = h[:REMEMBERED], low[:REMEMBERED]
        h, low = np.concatenate((self.h, h)), np.concatenate((self.low, low))
        order = np.lexsort((low, h))
        h, low = h[order], low[order]
        begin = np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1]))
        self.h, self.low = h[begin], low[begin]


_WINDOWS = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc", pa.int64()), ("sig", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _window_rows(window: int, shared):
    """Windows around shared anchors; a null ``g`` marks a run of starts that the task has settled as removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = shared.value, _Met()
        for batch in batches:
            ids, usable = _ids(batch)
            sigs = batch.column(2).to_numpy()
            for at, to, offsets, data in blocks(batch.column(1), BLOCK):
                words = find_words(data, offsets, lower=False)
                place, text, length = _anchors(words.first, window, usable[at:to])
                if not len(place):
                    continue
                runs = Runs(words.hashes)
                hit = in_bit_set(runs.hashes(place, length)[0], known)
                place, text = place[hit], text[hit]
                if not len(place):
                    continue
                # every start whose window holds a shared anchor
                marks = np.zeros(len(words.hashes) + 2, np.int32)
                np.add.at(marks, np.maximum(place + length - window, words.first[text]), 1)
                np.add.at(marks, np.minimum(place, words.first[text + 1] - window) + 1, -1)
                start = np.flatnonzero(np.cumsum(marks) > 0)
                text = np.searchsorted(words.first, start, "right") - 1
                h, g = runs.hashes(start, window)
                doc, sig, begin = ids[at:to][text], sigs[at:to][text], start - words.first[text]
                order = np.lexsort((doc, g, h))
                edge = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
                low = np.empty(len(h), np.int64)
                low[order] = doc[order][np.flatnonzero(edge)][np.cumsum(edge) - 1]
                mixed = mix(h ^ g.astype(np.uint64))
                low = np.minimum(low, met.low_of(mixed))
                settled = doc > low
                fresh, one = np.unique(mixed[settled], return_index=True)
                met.add(fresh, low[settled][one])
                open_ = np.flatnonzero(~settled)
                gone = np.flatnonzero(settled)
                breaks = np.concatenate((np.ones(min(len(gone), 1), bool), (np.diff(start[gone]) != 1) | (np.diff(text[gone]) != 0)))
                head, tail = gone[breaks], gone[np.concatenate((breaks[1:], np.ones(min(len(gone), 1), bool)))]
                none = pa.array(np.zeros(len(head), np.int32), mask=np.ones(len(head), bool))
                spread = mix(start[head].astype(np.uint64) + sig[head].view(np.uint64)).view(np.int64)
                yield batch_of(_WINDOWS, h[open_].view(np.int64), g[open_], doc[open_], sig[open_], begin[open_].astype(np.int32), begin[open_].astype(np.int32) + 1)
                if len(head):
                    yield batch_of(_WINDOWS, spread, none, doc[head], sig[head], begin[head].astype(np.int32), begin[tail].astype(np.int32) + 1)

    return run


def removed_starts(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, sig, runs): places where removed windows begin, as sorted runs; ``documents`` has ``doc_id`` (long), ``text`` and ``sig``."""
    spark = prepared(documents)
    shared = spark.sparkContext.broadcast(bit_set(stored(shared_anchors(documents.select("doc_id", "text"), window), "shared-anchors")))
    rows = documents.select("doc_id", "text", "sig").mapInArrow(_window_rows(window, shared), "h long, g int, doc long, sig long, start int, stop int")
    rows = rows.withColumn("low", F.expr("min(doc) OVER (PARTITION BY h, g)")).where("g IS NULL OR doc > low")
    return rows.groupBy("doc", "sig").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def _without_windows(window: int):
    """(row, text, n_words, n_removed): the words that no removed window covers, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes are split at ASCII spaces only
                kept, upto, gone = [], 0, 0
                for part in runs.as_py() or ():
                    low, high = max(part["start"], upto), part["stop"] - 1 + window
                    if high > upto:
                        kept += words[upto:low]
                        gone, upto = gone + high - low, high
                kept += words[upto:]
                texts.append(b" ".join(kept) if text.is_valid else None)
                counts.append(len(words))
                removed.append(gone)
            done = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done], names=["row", "text", "n_words", "n_removed"])

    return run


def drop_repeated_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with ``text`` less all words of windows that also start in a smaller ``doc_id``, and ``n_words``, ``n_removed``.

    Words are runs of anything but ASCII white space, taken unchanged; kept ones are joined by one space. A null text stays null and has no
    words, an empty one stays empty. Windows repeated within one document, or between rows of one ``doc_id``, stay; a row without ``doc_id``
    neither loses words nor takes them from others. Repeated rows each come back. A very long text is worked on as a whole. Empty
    input gives no rows. Other columns pass, whatever their names; ``n_words`` and ``n_removed`` of the input are replaced.
    """
    prepared(documents)
    others = [c for c in documents.columns if c not in ("text", "n_words", "n_removed")]
    kept = documents.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("sig", F.xxhash64("text"))
    gone = removed_starts(kept.where("text IS NOT NULL AND doc_id IS NOT NULL"), window)
    joined = kept.join(gone.withColumnRenamed("sig", "own"), (F.col("doc_id") == F.col("doc")) & (F.col("sig") == F.col("own")), "left").select("row", "text", "runs")
    out = joined.mapInArrow(_without_windows(window), row_schema(kept, "text string, n_words long, n_removed long"))
    named = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c in others or c == "text"]
    return out.select(*named, "n_words", "n_removed")


def repeated_windows_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the query's rows: all windows of all texts, grouped by their words."""
    words = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS words FROM documents),
w AS (SELECT r, doc_id, p, array_to_string(words[p:p + {window - 1}], ' ') AS run FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {window - 2})) AS p FROM d WHERE len(words) >= {window})),
firsts AS (SELECT run, min(doc_id) AS low FROM w GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {window})) AS place FROM w JOIN firsts USING (run) WHERE doc_id > low),
each_word AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM each_word ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
