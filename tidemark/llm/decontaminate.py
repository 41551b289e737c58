"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of an item, or all words of a shorter one. A window's tokens are its shingles of three words (fewer in
shorter windows). Shingles are ordered by rarity over all documents; a text that contains a window contains its rarest shingle, so that is
the prefix to join on. A match fixes where the window would begin; it must lie within the text (positional bound), which must be long
enough (length bound), and then the words there are compared one by one.

The shingles and words of a text are never shuffled: windows are joined where the text is read, in blocks of a bounded size.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored

WINDOW = 13
SHINGLE = 3
BLOCK_WINDOWS = 50_000  # windows that are broadcast together; more are joined in several blocks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> str:
    """SQL for the words of a text; only A-Z is folded, and a null has none."""
    folded = f"CASE WHEN octet_length({text}) = length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END"
    return rf"array_remove(split(coalesce({folded}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"


def _shingle(width: int) -> str:
    """The shingle that begins at ``pos`` of ``words``; null where the text ends before it does."""
    parts = ["word", *(f"get(words, pos + {j})" for j in range(1, width))]
    return f"CASE WHEN pos + {width} <= size(words) THEN xxhash64({', '.join(parts)}) END"


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of their items: ``w`` (words), ``items``, ``width`` of their shingles."""
    rows = items.selectExpr("cast(item_id AS string) AS item", f"{words_of('text')} AS words").where("size(words) > 0 AND item IS NOT NULL")
    rows = rows.selectExpr("item", f"explode(transform(sequence(0, greatest(size(words) - {window}, 0)), i -> slice(words, i + 1, {window}))) AS w")
    return rows.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("width", F.expr(f"least(size(w), {SHINGLE})"))


def _places(documents: DataFrame) -> DataFrame:
    """Every word of every text by place; place -1 holds an empty word, so that a text without any is seen as well."""
    rows = documents.selectExpr("doc_id", "xxhash64(text) AS sig", f"{words_of('text')} AS words")
    return rows.selectExpr("*", "posexplode(concat(array(''), words)) AS (place, word)").withColumn("pos", F.expr("place - 1"))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) of every document.

    Null and wordless texts have no words and no hits; items without words or id have no windows. Repeated rows stay, each with its own
    result; a null ``doc_id`` is kept. Columns other than ``doc_id``, ``text`` and ``item_id``, ``text`` are ignored.
    """
    docs = documents.select("doc_id", "text")
    windows = stored(windows_of(items, window), "windows")
    widths = {r.width: r.n for r in windows.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    parts = []
    for width, n in sorted(widths.items()):
        blocks = -(-n // BLOCK_WINDOWS)
        own = windows.where(F.col("width") == width).withColumn("block", F.expr(f"pmod(xxhash64(w), {blocks})"))
        for block in range(blocks):
            few = own.where(F.col("block") == block)
            shingles = few.selectExpr("w", "items", "posexplode(w) AS (pos, word)").withColumnRenamed("w", "words")
            shingles = shingles.selectExpr("words AS w", "items", "pos AS place_in", f"{_shingle(width)} AS shingle").where("shingle IS NOT NULL")
            keys = shingles.select("shingle").distinct()
            seen = _places(docs).where("place > 0").selectExpr(f"{_shingle(width)} AS shingle").join(F.broadcast(keys), "shingle")
            rarity = stored(seen.groupBy("shingle").agg(F.count("*").alias("df")), "rarity")
            ranked = shingles.join(rarity, "shingle")  # a shingle of no text leaves: its windows occur nowhere
            whole = ranked.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("df", "place_in", "shingle")).alias("rarest"), F.first("items").alias("items"))
            prefix = whole.where(F.expr(f"n = size(w) - {width - 1}")).selectExpr("w", "items", "rarest.shingle AS shingle", "rarest.place_in AS place_in", "size(w) AS size")
            parts.append((width, stored(prefix, "prefixes")))
    marker = "CASE WHEN place = 0 THEN 0L ELSE {} END"
    found = None
    for width, prefix in parts or [(1, None)]:
        rows = _places(docs).withColumn("shingle", F.expr(marker.format(_shingle(width))))
        if prefix is None:
            hits = rows.where("place = 0").selectExpr("doc_id", "sig", "size(words) AS n_words", "-1 AS start", "0 AS size", "cast(NULL AS array<string>) AS items", "1 AS copies")
        else:
            mark = prefix.sparkSession.range(1).selectExpr("cast(array() AS array<string>) AS w", "cast(NULL AS array<string>) AS items", "0L AS shingle", "0 AS place_in", "0 AS size")
            joined = rows.join(F.broadcast(prefix.select(mark.columns).unionAll(mark)), "shingle")
            ok = "CASE WHEN size = 0 THEN place = 0 ELSE place > 0 AND pos >= place_in AND pos - place_in + size <= size(words) AND slice(words, greatest(pos - place_in, 0) + 1, size) = w END"
            joined = joined.where(ok) if found is None else joined.where(ok).where("size > 0")
            hits = joined.selectExpr("doc_id", "sig", "size(words) AS n_words", "pos - place_in AS start", "size", "items", "cast(size = 0 AS int) AS copies")
        found = hits if found is None else found.unionAll(hits)
    spans = "array_sort(collect_set(CASE WHEN size > 0 THEN struct(start, start + size AS stop) END))"
    grouped = found.groupBy("doc_id", "sig").agg(F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.expr(spans).alias("spans"), F.expr("array_sort(array_distinct(flatten(collect_set(items))))").alias("item_ids"))
    covered = "aggregate(spans, struct(0 AS n, 0 AS upto), (a, s) -> struct(a.n + greatest(s.stop - greatest(s.start, a.upto), 0) AS n, greatest(a.upto, s.stop) AS upto), a -> a.n)"
    out = grouped.selectExpr("doc_id", "cast(n_words AS long) AS n_words", f"cast({covered} AS long) AS n_hit", "item_ids", "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "n_hit", "item_ids")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the query's rows: all windows of all texts against all windows of the items."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(u=UPPER, l=LOWER)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark),
iw AS (SELECT DISTINCT item, words[p:p + {window - 1}] AS w FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {window - 1}, 1) + 1)) AS p FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(w) AS size FROM iw),
dw AS (SELECT r, size, p, words[p:p + size - 1] AS w FROM (SELECT r, size, words, unnest(range(1, len(words) - size + 2)) AS p FROM d, sizes WHERE len(words) >= size)),
hit AS (SELECT r, p, size, item FROM dw JOIN iw USING (w)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""
