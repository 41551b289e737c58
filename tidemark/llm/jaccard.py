"""N-gram Jaccard join: a blocked sparse matrix product of documents by word shingles.

Rows of the matrix are distinct shingle sets, columns are shingles. The product is taken column by column: the sets that share a
column meet, overlap counts of pairs are summed over columns, and a pair whose count cannot reach what its sizes ask for is dropped.
Columns beyond the first ``n - ceil(0.75 n) + 1`` of a set are left out, because two sets that agree only there cannot link.

Steps, each over written tables:

1. Frequent shingles are found, so that every set can order its columns with the rare ones first. Any set of frequent shingles
   gives the same links; it only keeps shared passages out of the leading columns. That is why its size may be bounded.
2. Leading columns meet by shingle. Copies of one set are one row of the matrix.
3. Each set is tried with one partner: of the sets that lead its columns by their share of common columns, the most frequent. The original of
   a group of copies has the largest share, so this joins such groups in linear work.
4. What is left are pairs of sets in different classes that share a column; those in one class are linked already and need no test. In
   columns of many classes, bitmaps of the sets bound the overlap of a pair first, so unlike copies of one original make few candidates;
   a pair that passes needs no count, and is not made again where the sets show that they also meet in an earlier broad column.
5. Candidates are verified on their whole sets, block by block; then components are taken.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SMALL_ROWS, batch_of, prepared, stored, whole_groups
from tidemark.llm.components import components
from tidemark.llm.words import MULTIPLIER, SPACES, blocks, find_words, mix, sequences

WIDTH = 5
PERCENT = 75
MAX_FREQUENT = 1_000_000  # size bound of the ordering hint
FREQUENT = 24  # sets that hold a shingle, for it to be called frequent
TILE = 1024  # rows of a column multiplied together
BROAD = 64  # classes of a column from which its pairs are first held against bitmaps
BITS = 2048  # of a bitmap
SLOTS = 16  # classes of broad columns, of which a set carries its least one each
BLOCK = 1 << 19  # bytes of text whose words are found together
ITEMS = 1 << 18  # cells or pairs that a task holds before it hands them on
SEEN = 1 << 16  # sets that a task remembers, to skip copies; more are met again, which only costs rows

_LISTS = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("at", pa.int64())])
_LISTS_DDL = "kind byte, h long, key long, n int, at long"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for low, high, offsets, data in blocks(texts, BLOCK):
        words = find_words(data, offsets, SPACES)
        runs, begin = sequences(words.hashes, words.first, width)
        for d in range(high - low):
            yield low + d, np.unique(runs[begin[d] : begin[d + 1]])


def set_key(items: np.ndarray) -> int:
    return int(mix(np.sum(mix(items + np.uint64(len(items))), keepdims=True)).view(np.int64)[0])


def bitmap(items: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(mix(items + MULTIPLIER) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _frequent(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("sets", pa.int64())])
        held, size, seen = [], 0, set()

        def flush():
            h = np.concatenate(held)
            held.clear()
            h.sort()
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            c = np.diff(np.concatenate((begin, [len(h)])))
            return batch_of(schema, h[begin[c > 1]].view(np.int64), c[c > 1])

        for batch in batches:
            for _, items in shingle_sets(batch.column(0), width):
                if not len(items) or (key := set_key(items)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                held.append(items)
                size += len(items)
                if size > BLOCK_ITEMS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return count


BLOCK_ITEMS = 1 << 21


def _columns(width: int, percent: int, frequent):
    """Leading columns (kind 0) and documents (kind 1), both dealt by ``h``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen, spread = frequent.value, set(), 0
        schema = _LISTS

        def leading():
            total = sum(map(len, h))
            return batch_of(schema, np.zeros(total, np.int8), np.concatenate(h), np.concatenate(key), np.concatenate(n), np.concatenate(at))

        for batch in batches:
            ids = batch.column(0)
            h, key, n, at, held = [], [], [], [], 0
            doc_key, doc_n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for row, items in shingle_sets(batch.column(1), width):
                size = doc_n[row] = len(items)
                if not size or not ids[row].is_valid:
                    continue
                own = doc_key[row] = set_key(items)
                if own in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                if len(late):
                    place = np.minimum(np.searchsorted(late, items), len(late) - 1)
                    common = late[place] == items
                    items = np.concatenate((items[~common], items[common]))
                lead = items[: size - -(-percent * size // 100) + 1]
                h.append(lead.view(np.int64))
                key.append(np.full(len(lead), own))
                n.append(np.full(len(lead), size, np.int32))
                at.append(np.arange(len(lead)))
                held += len(lead)
                if held > ITEMS:
                    yield leading()
                    h, key, n, at, held = [], [], [], [], 0
            if h:
                yield leading()
            linked = np.asarray(ids.is_valid()) & (doc_n > 0)
            # dealt by row, not by key, so that copies do not meet in one task
            places = mix(np.arange(spread, spread + batch.num_rows, dtype=np.uint64)).view(np.int64)
            spread += batch.num_rows
            yield batch_of(schema, np.ones(batch.num_rows, np.int8), places, pa.array(doc_key, mask=~linked), doc_n, ids.cast(pa.int64()))

    return rows


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns that two sets share; documents pass."""
    for table in whole_groups(batches, "h"):
        kind = table["kind"].to_numpy()
        docs = table.filter(pa.array(kind == 1))
        if docs.num_rows:
            yield batch_of(_LISTS, *(docs[c].combine_chunks() for c in _LISTS.names))
        cells = table.filter(pa.array(kind == 0))
        if not cells.num_rows:
            continue
        h, key, n, at = (cells[c].to_numpy() for c in ("h", "key", "n", "at"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key, n, at = h[new], key[new], n[new], at[new]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((begin, [len(h)])))
        keep = np.repeat(size > 1, size)
        if keep.any():
            yield batch_of(_LISTS, np.zeros(keep.sum(), np.int8), h[keep], key[keep], n[keep], at[keep])


def _values(column: pa.Array) -> np.ndarray:
    """All values of a binary column, end to end, as 64-bit numbers; nothing is copied."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    places = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[places[0] : places[-1]].view(np.uint64)


def _pairs(percent: int):
    """Pairs of sets of different classes and like sizes in one column, with the number of columns of this task that they share.

    Where bitmaps bound the overlap, the smaller size stands for that number: such a pair is a candidate without a count. If the least
    columns of one slot are the same for both sets, they meet in that column, so it alone of the two makes the pair.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_n", pa.int32()), ("b_n", pa.int32()), ("shared", pa.int64())])

    def product(h, key, cls, n, bits, least):
        slot = h % SLOTS
        for x in range(0, len(key), TILE):
            for y in range(x, len(key), TILE):
                i, j = np.arange(x, min(x + TILE, len(key))), np.arange(y, min(y + TILE, len(key)))
                low, high = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
                ok = (100 * low >= percent * high) & (cls[i][:, None] != cls[j][None, :]) & (i[:, None] < j[None, :])
                p, q = np.nonzero(ok)
                if bits is not None:  # every bit of one set that the other lacks is at least one item that it lacks
                    for at in range(0, len(p), 1 << 16):
                        a, b = i[p[at : at + (1 << 16)]], j[q[at : at + (1 << 16)]]
                        most = np.minimum(n[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(1), n[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(1))
                        keep = (100 + percent) * most >= percent * (n[a].astype(np.int64) + n[b])
                        a, b = a[keep], b[keep]
                        met = (least[a, : slot + 1] == least[b, : slot + 1]) & (least[a, : slot + 1] != 0)
                        met[:, slot] &= least[a, slot] != h
                        keep = ~met.any(1)
                        if keep.any():
                            yield a[keep], b[keep]
                elif len(p):
                    yield i[p], j[q]

    def summed(parts):
        a, b, an, bn, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, an, bn, c = a[order], b[order], an[order], bn[order], c[order]
        begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return a[begin], b[begin], an[begin], bn[begin], np.add.reduceat(c, begin)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for table in whole_groups(batches, "h"):
            h, key, cls, n = (table[c].to_numpy() for c in ("h", "key", "cls", "n"))
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            for low, high in zip(begin, [*begin[1:], len(h)]):
                if (cls[low:high] == cls[low]).all():
                    continue
                own = slice(low, high)
                raw, bits, least = table["bits"].slice(low, high - low), None, None
                if not raw.null_count:
                    bits = np.concatenate([_values(c) for c in raw.chunks]).reshape(high - low, BITS // 64)
                    least = np.concatenate([c.flatten().to_numpy() for c in table["least"].slice(low, high - low).chunks]).reshape(high - low, SLOTS)
                for i, j in product(int(h[low]), key[own], cls[own], n[own], bits, least):
                    p, q = low + i, low + j
                    swap = key[p] > key[q]
                    p, q = np.where(swap, q, p), np.where(swap, p, q)
                    parts.append((key[p], key[q], n[p], n[q], np.ones(len(p), np.int64) if bits is None else np.minimum(n[p], n[q]).astype(np.int64)))
                    size += len(p)
                    if size > ITEMS:
                        done = summed(parts)
                        parts, size = [done], 0
                        if len(done[0]) > ITEMS // 2:
                            yield batch_of(schema, *done)
                            parts = []
        if parts:
            yield batch_of(schema, *summed(parts))

    return multiply


def _bitmaps(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, bits) of the sets ``wanted`` (key, first_id)."""
    schema = pa.schema([("key", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, bitmap(items)) for row, items in shingle_sets(batch.column(0), width) if len(items) and (k := set_key(items)) == batch.column(1)[row].as_py()]
            yield batch_of(schema, [k for k, _ in found], [b for _, b in found])

    if wanted.count() <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    rows = documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("first_id")).select("text", "key")
    return rows.mapInArrow(run, "key long, bits binary").dropDuplicates(["key"])


def _verified(documents: DataFrame, keys: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link: each set is sent to the blocks of its partners and multiplied there."""
    fan = pairs.groupBy("a").agg(F.count("*").alias("fan"))
    dealt = pairs.join(fan, "a").select("a", "b", F.expr("pmod(xxhash64(b), ceil(fan / 256))").alias("part"))
    places = dealt.select(F.col("a").alias("key"), F.col("a").alias("block"), "part", F.lit(0).alias("role")).distinct()
    places = places.unionAll(dealt.select(F.col("b").alias("key"), F.col("a").alias("block"), "part", F.lit(1).alias("role")))
    wanted = places.groupBy("key").agg(F.collect_list(F.struct("block", "part", "role")).alias("places")).join(keys, "key")
    wanted = stored(wanted.select(F.col("first_id").alias("doc_id"), "key", "places"), "jaccard-wanted")
    if wanted.count() <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("role", pa.int32()), ("key", pa.int64()), ("items", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for row, items in shingle_sets(batch.column(0), width):
                if not len(items) or set_key(items) != (key := batch.column(1)[row].as_py()):
                    continue
                raw = items.tobytes()
                for p in batch.column(2)[row].as_py():
                    out.append((p["block"], p["part"], p["role"], key, raw))
                    held += len(items)
                    if held > ITEMS:
                        yield batch_of(schema, *map(list, zip(*out)))
                        out, held = [], 0
            if out:
                yield batch_of(schema, *map(list, zip(*out)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            values = _values(batch.column(4))
            sizes = pa.compute.binary_length(batch.column(4)).to_numpy().astype(np.int64) // 8
            ends = np.cumsum(sizes)
            for block, part, role, key, end, size in zip(*(batch.column(i).to_pylist() for i in range(4)), ends.tolist(), sizes.tolist()):
                other = values[end - size : end]
                if not role:
                    at, row = (block, part), other.copy()
                elif at == (block, part):
                    overlap = int((row[np.minimum(np.searchsorted(row, other), len(row) - 1)] == other).sum())
                    if 100 * overlap >= percent * (len(row) + len(other) - overlap):
                        found.append((block, key))
            if found:
                yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), *map(list, zip(*found)))

    sets = documents.select("doc_id", "text").join(wanted, "doc_id").select("text", "key", "places")
    rows = sets.mapInArrow(send, "block long, part long, role int, key long, items binary")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "role").mapInArrow(multiply, "a long, b long").distinct()


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` it reaches by links.

    A null or wordless text has an empty set and links with nothing. A row whose ``doc_id`` is null links with nothing and has a null
    component. Repeated rows stay; rows that share a ``doc_id`` are one document if their texts are equal, and else each keeps the
    component of its own text. Other columns are ignored.
    """
    spark = prepared(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    top = docs.select("text").mapInArrow(_frequent(width), "h long, sets long").groupBy("h").agg(F.sum("sets").alias("sets"))
    top = top.where(F.col("sets") >= FREQUENT).orderBy(F.desc("sets"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(top["h"].to_numpy().view(np.uint64)))

    rows = docs.mapInArrow(_columns(width, percent, frequent), _LISTS_DDL)
    lists = stored(rows.repartition("h").sortWithinPartitions("h", "kind", "key").mapInArrow(_lists, _LISTS_DDL), "jaccard-lists")
    cells, owners = lists.where("kind = 0"), lists.where("kind = 1")
    keys = stored(owners.where("key IS NOT NULL").groupBy("key").agg(F.min("at").alias("first_id")), "jaccard-keys")

    # the centre of a group of copies shares nearly all its columns, a copy lacks those that it has changed
    own = cells.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).selectExpr("key", f"c / (n - ceil({percent} * n / 100.0) + 1) AS share")
    ranked = cells.select("h", "key", "n").join(own, "key")
    middle = ranked.groupBy("h").agg(F.max(F.struct("share", "key", "n")).alias("m")).select("h", F.col("m.key").alias("partner"), F.col("m.n").alias("partner_n"))
    tried = cells.select("h", "key", "n").join(middle, "h").where(f"partner <> key AND 100 * least(n, partner_n) >= {percent} * greatest(n, partner_n)")
    tried = tried.groupBy("key", "partner").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "partner")).alias("best"))
    stars = stored(tried.select(F.col("best.partner").alias("a"), F.col("key").alias("b")), "jaccard-stars")
    links = stored(_verified(docs, keys, stars, width, percent), "jaccard-links")
    classes = stored(components(links, "jaccard"), "jaccard-classes")

    marked = stored(cells.join(classes, cells.key == classes.node, "left").select("h", "key", F.coalesce("component", "key").alias("cls"), "n"), "jaccard-marked")
    # the columns of one shared passage have the same sets: dealt by their smallest set they meet in one task, which makes each pair once
    columns = marked.groupBy("h").agg(F.min("key").alias("least_key"), F.approx_count_distinct("cls").alias("classes"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    columns = stored(columns.where("low <> high").select("h", "least_key", "classes"), "jaccard-columns")
    # a column of many classes holds a group of copies that mostly don't link: there a bitmap of each set rules out pairs at once
    broad = stored(columns.where(f"classes >= {BROAD}").select("h"), "jaccard-broad")
    within = marked.join(broad, "h")
    bits = stored(_bitmaps(docs, stored(within.select("key").distinct().join(keys, "key"), "jaccard-wanted"), width), "jaccard-bitmaps")
    slots = F.array(*(F.coalesce(F.min(F.expr(f"CASE WHEN pmod(h, {SLOTS}) = {i} THEN h END")), F.lit(0)) for i in range(SLOTS)))
    within = within.join(bits.join(within.groupBy("key").agg(slots.alias("least")), "key"), "key").withColumn("place", F.col("h"))
    marked = marked.join(columns.where(f"classes < {BROAD}").select("h", F.col("least_key").alias("place")), "h")
    marked = marked.selectExpr("*", "cast(NULL AS binary) AS bits", "cast(NULL AS array<long>) AS least").unionByName(within)
    pairs = marked.repartition("place").sortWithinPartitions("place", "h").mapInArrow(_pairs(percent), "a long, b long, a_n int, b_n int, shared long")
    pairs = pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.sum("shared").alias("shared"))
    # beyond its leading columns a set has ceil(p n) - 1 more
    rest = F.greatest(*(F.ceil(F.col(c) * percent / 100.0) - 1 for c in ("a_n", "b_n")))
    pairs = pairs.where(F.col("shared") + rest >= F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100.0 + percent)))
    pairs = stored(pairs.select("a", "b"), "jaccard-pairs")
    if not pairs.isEmpty():
        more = stored(_verified(docs, keys, pairs, width, percent), "jaccard-links")
        classes = stored(components(links.unionAll(more), "jaccard"), "jaccard-classes")

    grouped = keys.join(classes, keys.key == classes.node, "left").select("key", "first_id", F.coalesce("component", "key").alias("cls"))
    lowest = grouped.groupBy("cls").agg(F.min("first_id").alias("component_id"))
    named = stored(grouped.join(lowest, "cls").select("key", "component_id"), "jaccard-named")
    out = owners.select(F.col("at").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
