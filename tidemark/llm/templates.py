"""Line dedup by a fixed-depth template tree.

A line goes down the tree by its number of tokens, then by its leading tokens; a token with a digit is a variable field and takes the
wildcard branch. Within a leaf, places whose tokens vary are generalised as well: the template of a line is the half of its tokens that are the
most frequent ones at their places in the leaf, so families of lines in one leaf have templates of their own, however rare they are in it.
Lines whose template recurs in enough documents are dropped.

The tree has no nodes to build: a leaf is the hash of its path. Only lines of leaves that recur are looked at further, as token numbers, never as
texts. The lines of a leaf meet in one task, but a leaf of very many lines is counted token by token over all tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SMALL_ROWS, batch_of, bit_set, in_bit_set, prepared, row_schema, stored, whole_groups
from tidemark.llm.words import mix

DEPTH = 3  # leading tokens of a path
MIN_DOCS = 3  # documents a template must occur in to be dropped
LONG_WORDS, LONG_DOCS = 50, 2  # a line of more words is a passage, which recurs from so many documents on
CONSTANT = 0.5  # share of a line's places that its template holds constant
ROWS = 1_000  # texts whose lines are held at once
HOT = 1 << 15  # distinct lines of a leaf that one task counts
SENT = 1 << 17  # lines that a task remembers as sent; others may go twice, which only costs rows
_FIELD = re.compile(r"\S*\d\S*")
WILD = "<*>"
_DIGIT = re.compile(r"\d")


def masked(line: str) -> str:
    """Tokens, single spaced, those with a digit as the wildcard."""
    line = " ".join(line.split())
    return _FIELD.sub(WILD, line) if _DIGIT.search(line) else line


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def leaf_of(line: str) -> int:
    """Of a masked line."""
    tokens = line.split(" ", DEPTH)
    return _hash(f"{line.count(' ')} {' '.join(tokens[:DEPTH])}")


def _forms(text: str | None) -> set[str]:
    """The distinct masked lines of a text."""
    return {masked(x) for x in (text or "").split("\n")} - {""}


def _lines(long_words: int):
    """Leaf and hash of each distinct masked line of a text, and whether it is a passage, which all lines of a leaf are or none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("leaf", pa.int64()), ("h", pa.int64()), ("passage", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                forms = [x for text in batch.column(0).slice(at, ROWS).to_pylist() for x in _forms(text)]
                yield batch_of(schema, [leaf_of(x) for x in forms], [_hash(x) for x in forms], [x.count(" ") >= long_words for x in forms])

    return run


def _token_rows(wanted, hot, constant: float):
    """(leaf, h, need, tokens, hot) of the lines that may be wanted: a number for each token, 0 for a variable field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, large, sent = wanted.value, hot.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                forms = {_hash(x): x for text in batch.column(0).slice(at, ROWS).to_pylist() for x in _forms(text)}
                hashes = np.fromiter(forms, np.int64, len(forms))
                out = []
                for h in hashes[in_bit_set(hashes.view(np.uint64), known)].tolist():
                    if h in sent:
                        continue
                    tokens = forms[h].split(" ")
                    numbers = [(_hash(t) & 0x7FFFFFFE) + 1 if t != WILD else 0 for t in tokens]
                    out.append((leaf_of(forms[h]), h, math.ceil(constant * len(tokens)), numbers))
                    sent.add(h)
                if len(sent) > SENT:
                    sent.clear()
                if out:
                    leaf = np.array([x[0] for x in out], np.int64)
                    yield batch_of(_TOKENS, leaf, *(pa.array([x[k] for x in out], _TOKENS[k].type) for k in (1, 2, 3)), in_bit_set(leaf.view(np.uint64), large))

    return run


_TOKENS = pa.schema([("leaf", pa.int64()), ("h", pa.int64()), ("need", pa.int32()), ("tokens", pa.list_(pa.int32())), ("hot", pa.bool_())])
_TOKENS_DDL = "leaf long, h long, need int, tokens array<int>, hot boolean"


def _leaf_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of the rarer lines of small leaves whose template recurs; a leaf's counts and its lines' tokens come together, sorted by line."""
    for table in whole_groups(batches, "leaf"):
        found = []
        rows = table.to_pydict()
        begin = 0
        while begin < len(rows["leaf"]):
            end = begin
            while end < len(rows["leaf"]) and rows["leaf"][end] == rows["leaf"][begin]:
                end += 1
            found += _recurring_in_leaf(*(rows[c][begin:end] for c in ("h", "docs", "least", "need", "tokens")))
            begin = end
        yield batch_of(pa.schema([("h", pa.int64())]), found)


def _recurring_in_leaf(hs: list, docs: list, least: list, needs: list, tokens: list) -> list[int]:
    weight, need, words = {}, {}, {}
    for h, d, m, n, t in zip(hs, docs, least, needs, tokens):
        if t is None:
            weight[h] = (d, m)
        else:
            need[h], words[h] = n, t
    times: dict[tuple[int, int], int] = {}
    known = [h for h in weight if h in words]
    for h in known:
        for place in enumerate(words[h]):
            if place[1]:
                times[place] = times.get(place, 0) + weight[h][0]
    shapes: dict[tuple, list[int]] = {}
    for h in known:
        places = sorted((-times[p], p) for p in enumerate(words[h]) if p[1] and times[p] >= weight[h][1])
        if len(places) >= need[h]:  # the most frequent tokens, equally frequent ones by place
            shapes.setdefault(tuple(sorted(p for _, p in places[: need[h]])), []).append(h)
    out = []
    for own in shapes.values():
        if sum(weight[h][0] for h in own) >= weight[own[0]][1]:
            out += [h for h in own if weight[h][0] < weight[h][1]]
    return out


def _flagged(hot):
    """Count rows with ``hot``, told by the same bit set as for tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flag = in_bit_set(batch.column(0).to_numpy().view(np.uint64), hot.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag)], names=[*batch.schema.names, "hot"])

    return run


def recurring_lines(documents: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS, long_words: int = LONG_WORDS, constant: float = CONSTANT) -> DataFrame:
    """(h): hashes of masked lines whose template occurs in ``min_docs`` documents, of passages in ``long_docs``.

    A line that does so itself is its own template. Lines of one leaf meet in one task, as numbers; leaves of over ``HOT`` lines are counted token
    by token over all tasks instead.
    """
    spark = prepared(documents)
    texts = documents.select("text")
    # copies of a line are one row with a count from here on
    counted = texts.mapInArrow(_lines(long_words), "leaf long, h long, passage boolean").groupBy("leaf", "h").agg(F.count("*").alias("docs"), F.max("passage").alias("passage"))
    counted = stored(counted.withColumn("least", F.when(F.col("passage"), min(long_docs, min_docs)).otherwise(min_docs)).drop("passage"), "template-lines")
    # of leaves with rarer lines, all lines: the frequent ones are few distinct rows, and weigh by their documents
    leaves = counted.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.max("least").alias("leaf_least"), F.min("docs").alias("rarest"), F.count("*").alias("lines"))
    leaves = leaves.where("leaf_docs >= leaf_least AND rarest < leaf_least").select("leaf", "lines")
    rows = stored(counted.join(leaves, "leaf"), "template-leaves")
    # only lines that may be wanted are read as tokens and shuffled
    wanted = spark.sparkContext.broadcast(bit_set(rows.select("h")))
    large = rows.where(F.col("lines") > HOT).select(F.col("leaf").alias("h")).distinct()
    hot = spark.sparkContext.broadcast(bit_set(large))
    rows = rows.select("leaf", "h", "docs", F.col("least").cast("int").alias("least")).mapInArrow(_flagged(hot), "leaf long, h long, docs long, least int, hot boolean")
    tokens = stored(texts.mapInArrow(_token_rows(wanted, hot, constant), _TOKENS_DDL), "template-tokens")
    cold = rows.selectExpr("leaf", "h", "docs", "least", "cast(NULL AS int) AS need", "cast(NULL AS array<int>) AS tokens", "hot")
    cold = cold.unionAll(tokens.selectExpr("leaf", "h", "cast(NULL AS long)", "cast(NULL AS int)", "need", "tokens", "hot")).where("NOT hot").drop("hot")
    found = cold.repartition("leaf").sortWithinPartitions("leaf", "h").mapInArrow(_leaf_lines, "h long").unionAll(counted.where("docs >= least").select("h"))
    if large.isEmpty():
        return found
    own = tokens.where("hot").groupBy("h").agg(F.first("need").alias("need"), F.first("tokens").alias("tokens"))
    # a token at its place in a leaf is a number; a variable field has none
    numbers = "filter(transform(tokens, (t, i) -> CASE WHEN t <> 0 THEN xxhash64(leaf, i, t) END), k -> k IS NOT NULL)"
    split = stored(rows.where("hot").join(own, "h").selectExpr("h", "docs", "least", "need", f"{numbers} AS tokens").where("size(tokens) >= need"), "template-hot")
    common = split.selectExpr("docs", "least", "explode(tokens) AS token").groupBy("token").agg(F.sum("docs").alias("n"), F.max("least").alias("least"))
    common = stored(common.where("n >= least").select("token", "n"), "template-common")
    template = stored(_templates(split, common), "templates")
    frequent = template.groupBy("template").agg(F.sum("docs").alias("n"), F.max("least").alias("least")).where("n >= least").select("template")
    return template.where("docs < least").join(frequent, "template").select("h").unionAll(found)


def _templates(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(h, docs, least, template) of the lines that have enough common tokens; the most frequent tokens are broadcast, others come by a join."""
    top = common if common.count() <= SMALL_ROWS else common.orderBy(F.desc("n"), "token").limit(SMALL_ROWS)
    top = top.toArrow()
    token, n = top["token"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(token)
    shared = rows.sparkSession.sparkContext.broadcast((token[order], n[order]))
    rows = rows.withColumn("more", F.lit(None).cast("map<long, long>"))
    if common.count() > SMALL_ROWS:
        rare = common.where(F.col("n") <= int(n.min()))  # none of these is in many lines
        own = rows.select("h", F.explode("tokens").alias("token")).join(rare, "token").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("token", "n"))).alias("own"))
        rows = rows.join(own, "h", "left").withColumn("more", F.col("own")).drop("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("docs", pa.int64()), ("least", pa.int32()), ("template", pa.int64())])
        known, weight = shared.value
        for batch in batches:
            tokens, need = batch.column(3), batch.column(4).to_numpy()
            sizes = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, line = tokens.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes)
            times = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                times = np.where(known[at] == flat, weight[at], 0)
            begin = np.cumsum(sizes) - sizes
            for d, more in enumerate(batch.column(5).to_pylist() if batch.column(5).null_count < batch.num_rows else ()):
                if more:
                    more = dict(more)
                    own = slice(begin[d], begin[d] + sizes[d])
                    times[own] = [max(t, more.get(k, 0)) for k, t in zip(flat[own].tolist(), times[own].tolist())]
            # by line, the most frequent tokens first, equal ones by place
            order = np.lexsort((np.arange(len(flat)), -times, line))
            rank = np.arange(len(flat)) - begin[line]
            chosen = order[rank < need[line]]
            enough = np.bincount(line[chosen], times[chosen] > 0, batch.num_rows) == need
            total = np.zeros(batch.num_rows, np.uint64)
            np.add.at(total, line[chosen], mix(flat[chosen].view(np.uint64)))
            keep = np.flatnonzero(enough)
            yield batch_of(schema, *(batch.column(c).take(pa.array(keep)) for c in range(3)), total.view(np.int64)[keep])

    return rows.select("h", "docs", F.col("least").cast("int").alias("least"), "tokens", "need", "more").mapInArrow(run, "h long, docs long, least int, template long")


_OUT = pa.schema([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("n_recurring", pa.int64())])


def _kept(text: str | None, known) -> tuple[str | None, int, int, int]:
    """The text without known lines, its lines with a word, how many of them went, and how many are known; a text of known lines only stays."""
    if text is None:
        return None, 0, 0, 0
    lines = text.split("\n")
    forms = [masked(x) for x in lines]
    gone = [bool(m) and known(_hash(m)) for m in forms]
    n = sum(map(bool, forms))
    if sum(gone) in (0, n):
        return text, n, 0, sum(gone)
    return "\n".join(x for x, g in zip(lines, gone) if not g), n, sum(gone), sum(gone)


def _owned(known):
    """(uid, h) of the lines that may recur."""
    schema = pa.schema([("uid", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                pairs = [(u, _hash(m)) for u, t in zip(*(batch.column(c).slice(at, ROWS).to_pylist() for c in (0, 1))) for m in _forms(t)]
                uid, h = np.array(pairs, np.int64).reshape(-1, 2).T
                keep = in_bit_set(h.view(np.uint64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.uint64), known.value)
                yield batch_of(schema, uid[keep], h[keep])

    return run


def drop_recurring_lines(documents: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS, long_words: int = LONG_WORDS, constant: float = CONSTANT) -> DataFrame:
    """``documents`` with ``text`` less its recurring lines, and ``n_lines`` (lines with a word), ``n_dropped`` and ``n_recurring``.

    A line recurs if its template occurs in ``min_docs`` documents, one of over ``long_words`` words if in ``long_docs``. A null text stays null,
    an empty one empty; lines without a word are never dropped. Recurring lines go whatever their share of a document; a text that has no other
    line becomes empty, unless other rows hold exactly the same text: those stay whole, for removal of copies to keep one. Repeated
    rows count as documents of their own. A very long text is worked on as a whole; an empty table gives no rows. All other columns pass,
    whatever their names; the three new ones replace those of the same name.
    """
    spark = prepared(documents)
    known = stored(recurring_lines(documents, min_docs, long_docs, long_words, constant), "template-hashes")
    new = ("n_lines", "n_dropped", "n_recurring")
    others = [c for c in documents.columns if c not in ("text", *new)]
    rows = documents.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in others)).alias("row"), "text")
    if known.count() <= SMALL_ROWS:
        shared = spark.sparkContext.broadcast(frozenset(known.toArrow()["h"].to_pylist()))
        rows = rows.withColumn("known", F.lit(None).cast("array<long>"))
        member = lambda own: shared.value.__contains__
    else:  # too many to broadcast: each document's recurring lines come to it by a join
        rows = rows.withColumn("uid", F.xxhash64("text"))
        maybe = spark.sparkContext.broadcast(bit_set(known))
        uses = rows.select("uid", "text").mapInArrow(_owned(maybe), "uid long, h long").join(known, "h").groupBy("uid").agg(F.collect_set("h").alias("known"))
        rows = rows.join(uses, "uid", "left").select("row", "text", "known")
        member = lambda own: frozenset(own or ()).__contains__

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [_kept(t, member(k)) for t, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                done = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(_OUT)]
                yield pa.RecordBatch.from_arrays([part.column(0), *done], names=["row", *_OUT.names])

    out = rows.mapInArrow(apply, row_schema(rows, "text string, n_lines long, n_dropped long, n_recurring long"))
    out = stored(out.withColumn("sig", F.when(F.expr("n_lines > 0 AND n_recurring = n_lines"), F.xxhash64("text"))), "template-texts")
    single = stored(out.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("rows")).where("rows = 1").selectExpr("sig AS single"), "template-single")
    if single.count() <= SMALL_ROWS:
        single = F.broadcast(single)
    # rows without a signature stay out of the join: they would all be one key
    rest, whole = out.where("sig IS NULL").drop("sig"), out.where("sig IS NOT NULL").join(single, F.col("sig") == F.col("single"), "left")
    whole = whole.withColumn("n_dropped", F.expr("CASE WHEN single IS NULL THEN 0L ELSE n_lines END")).withColumn("text", F.expr("CASE WHEN single IS NULL THEN text ELSE '' END"))
    out = rest.unionAll(whole.drop("sig", "single"))
    named = [F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in new]
    return out.select(*named, *new)
