"""Importance resampling towards a target corpus, with n-gram buckets derived from running CRCs.

The words of a block of documents are laid out with one space after each, and one scan stores the running CRC-32 behind every byte. A CRC without
its start value is linear over GF(2): the state behind a string is the state before it, moved on over as many zero bytes, xor the string's own
CRC. So the CRC of any n-gram follows from two stored states: the earlier one is moved on by the n-gram's length and cancels out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import prepared, row_schema, stored
from tidemark.llm.words import PUNCTUATION, blocks

ORDER, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
POLYNOMIAL = 0xEDB88320  # CRC-32, bits reflected
ONES = np.uint32(0xFFFFFFFF)
BLOCK = 1 << 20  # bytes of text worked on together
LANE_BITS = 8  # a block is scanned in lanes of 2 ** LANE_BITS bytes side by side
ROWS = 500_000  # rows that are ranked in one task


def _byte_steps() -> np.ndarray:
    """What a state's low byte adds to the state one byte later."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


_STEP = _byte_steps()
_MOVES: list[np.ndarray] = []  # k: tables, by byte of the state, that move it on over 2 ** k zero bytes


def _moved(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][states & np.uint32(255)]
    for j in range(1, 4):
        out = out ^ table[j][(states >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def _move(k: int) -> np.ndarray:
    if not _MOVES:
        places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        _MOVES.append(_STEP[places & np.uint32(255)] ^ (places >> np.uint32(8)))
    while len(_MOVES) <= k:
        _MOVES.append(_moved(_MOVES[-1], _MOVES[-1]))
    return _MOVES[k]


def moved_on(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after so many zero bytes."""
    out = states.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero((lengths >> k) & 1)
        out[some] = _moved(out[some], _move(k))
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The state, from a start value of 0, before the first byte and behind each one."""
    n, lane = len(data), 1 << LANE_BITS
    lanes = -(-n // lane) or 1
    columns = np.zeros(lanes * lane, np.uint8)
    columns[:n] = data
    columns = np.ascontiguousarray(columns.reshape(lanes, lane).T)
    state = np.zeros(lanes, np.uint32)
    for row in columns:
        state = _STEP[(state ^ row) & np.uint32(255)] ^ (state >> np.uint32(8))
    k, reach = LANE_BITS, 1
    while reach < lanes:  # lane ends, from 0 at the lane's start, to lane ends from 0 at the block's start
        state[reach:] ^= _moved(state[:-reach], _move(k))
        k, reach = k + 1, 2 * reach
    state = np.concatenate((np.zeros(1, np.uint32), state[:-1]))
    behind = np.empty((lane, lanes), np.uint32)
    for i, row in enumerate(columns):
        state = behind[i] = _STEP[(state ^ row) & np.uint32(255)] ^ (state >> np.uint32(8))
    return np.concatenate((np.zeros(1, np.uint32), behind.T.reshape(-1)[:n]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, A-Z folded, one space after each; their starts and ends there, and the first word of each text."""
    inside = ~PUNCTUATION[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    word = np.cumsum(begins)[inside] - 1
    begin = np.flatnonzero(begins)
    lengths = np.bincount(word, minlength=len(begin))
    out = np.full(len(word) + len(begin), 0x20, np.uint8)
    out[np.arange(len(word)) + word] = _LOWER[data[inside]]
    ends = np.cumsum(lengths + 1) - 1
    return out, ends - lengths, ends, np.searchsorted(begin, offsets)


def ngram_crcs(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """CRC-32 of all runs of 1 to ``order`` words, as an array for each text, and its number of words."""
    text, starts, ends, first = normalised(data, offsets)
    crcs = running_crcs(text)
    parts = []
    for n in range(1, order + 1):
        counts = np.maximum(np.diff(first) - n + 1, 0)
        at = np.arange(counts.sum()) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
        begin, end = starts[at], ends[at + n - 1]
        own = crcs[end] ^ moved_on(crcs[begin] ^ ONES, end - begin) ^ ONES
        parts.append(np.split(own, np.cumsum(counts)[:-1]))
    return [np.concatenate(x) for x in zip(*parts)], np.diff(first)


def _features(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, offsets, data in blocks(batch.column(1), BLOCK):
                crcs, words = ngram_crcs(data, offsets, order)
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in crcs])))
                flat = (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(words, pa.int64()), lists], names=["row", "n_words", "features"])

    return run


def features(rows: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(row, n_words, features) of (row, text): buckets of all n-grams, repeats included."""
    return rows.mapInArrow(_features(order, buckets), row_schema(rows, "n_words long, features array<int>"))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows lie in each bucket; a task sends no more rows than there are buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    got = found.select("features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, a thousand times the log of its share in the target over that in the source, add-one smoothed, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weights(by_bucket):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = by_bucket.value
        for batch in batches:
            lists = batch.column(2)
            sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy()])))
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (row, score, seq, ...) with ``rank`` of the first ``n`` by falling score, then doc_id, then seq; the rest has none.

    Scores are whole numbers in a narrow range, so their counts, a few thousand rows, give the least drawn score. Rows from there on are
    range-partitioned, which splits ties as well, and numbered within each range behind those of the ranges before it.
    """
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    least, above = None, 0
    for r in sorted(rows.groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True):
        least, above = r.score, above + r.n
        if above >= n:
            break
    order = [F.desc("score"), F.asc_nulls_first(F.col("row.doc_id")), F.col("seq")]
    dealt = rows.where(F.col("score") >= least).repartitionByRange(-(-above // ROWS), *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "resampling-ranges")
    before, at = {}, 0
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):  # one row for each range
        before[r.part], at = at, at + r.n
    offset = F.create_map(*(F.lit(x) for item in before.items() for x in item))[F.col("part")]
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    top = dealt.withColumn("rank", rank.cast("long")).withColumn("rank", F.expr(f"CASE WHEN rank <= {n} THEN rank END")).drop("part")
    return top.unionByName(rows.where(F.col("score") < least).withColumn("rank", F.lit(None).cast("long")))


OUT = ("n_features", "weight", "score", "rank")


def importance_scores(documents: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``documents`` without ``text``, with ``n_features``, ``weight``, ``score`` and ``rank``.

    Every feature of all texts of both tables counts. A document's weight is the floored mean gain of its features (none: 0), its score
    adds Gumbel noise from a hash of ``doc_id``; of the N documents of at least ``min_words`` words, ``percent`` per cent of N with the highest scores
    are drawn and ranked from 1, equal scores by smaller ``doc_id``; all others have a null rank. Null texts have no words. A null ``doc_id``
    counts as an empty text in the hash and comes first among equal scores. Rows of one ``doc_id`` are ranked one by one, equal ones in any
    order. A very long text is worked on as a whole. Empty ``documents`` give no rows, an empty target only smooths. Other columns pass,
    whatever their names; the four new ones replace those of the same name.
    """
    spark = prepared(documents)
    others = [c for c in documents.columns if c not in ("text", *OUT)]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "text")
    found = stored(features(rows, order, buckets), "resampling-features")
    wanted = features(target.select(F.struct(F.lit(0).alias("none")).alias("row"), "text"), order, buckets)
    shared = spark.sparkContext.broadcast(gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))
    out = found.mapInArrow(_weights(shared), row_schema(rows, "n_words long, n_features long, weight long"))
    h = f"conv(substring(sha2(concat('{seed}:', coalesce(cast(row.doc_id AS string), '')), 256), 1, 8), 16, 10)"
    noise = F.expr(f"floor(-1000 * ln(-ln((cast({h} AS double) + 0.5D) / 4294967296D)))")
    out = stored(out.withColumn("score", F.col("weight") + noise).withColumn("seq", F.monotonically_increasing_id()), "resampling-scores")
    usable = F.col("n_words") >= min_words
    n = out.where(usable).count()
    out = ranked(out.where(usable), percent * n // 100).unionByName(out.where(~usable).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in others), *OUT)


def resampled(documents: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``documents``, whole, with their ``rank``; rows of one ``doc_id`` that all hold the same text come once each."""
    keyed = documents.withColumn("sig", F.xxhash64("text"))
    drawn = importance_scores(keyed.select("doc_id", "text", "sig"), target, **settings).where("rank IS NOT NULL").selectExpr("doc_id AS drawn_id", "sig AS drawn_sig", "rank")
    drawn = drawn.groupBy("drawn_id", "drawn_sig").agg(F.min("rank").alias("rank"))
    same = F.col("doc_id").eqNullSafe(F.col("drawn_id")) & F.col("sig").eqNullSafe(F.col("drawn_sig"))
    return keyed.drop("rank").join(drawn, same).drop("drawn_id", "drawn_sig", "sig")


CRC_TABLE_SQL = f"crc AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}) ELSE a >> 1 END) AS c FROM range(256) AS t(i)))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, with ``steps`` of ``CRC_TABLE_SQL`` at hand."""
    octets = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex({text}), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


def importance_sql(buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> str:
    """DuckDB SQL for the query's rows, for single words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS words FROM documents),
dw AS (SELECT r, unnest(words) AS word FROM d),
tw AS (SELECT unnest(words) AS word FROM (SELECT {words} AS words FROM benchmark)),
hashed AS (SELECT word, {crc32_sql('word')} % {buckets} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM tw), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {buckets}.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM tw) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN total < 0 AND total % n <> 0 THEN total // n - 1 ELSE total // n END, 0) AS weight,
CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
summed AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM summed WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM summed LEFT JOIN drawn USING (r)"""
