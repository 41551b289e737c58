"""Robust multivariate outliers among documents, in SQL only.

Four statistics of each text are transformed to a vector. For each language and source the minimum-covariance-determinant estimate is
found by concentration: from a start at medians and deviations, the half of the rows nearest to the centre gives the next mean and
covariance, and so on. The estimate is made consistent, reweighted once, and rows too far away by Mahalanobis distance are rejected.

Every step is one grouped aggregate over the table of statistics, with sums and counts merged before the shuffle; the half is cut at the
median of distances on a fixed grid, whose counts are merged likewise. So a source that holds a third of the rows costs nothing extra.
Small groups take the estimate of their language, small languages that of all documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SMALL_ROWS, stored

D = 4
FLOORS = (0.08, 0.304, 0.24, 0.179)  # least deviation of each transformed statistic that is told apart: of the last three a tenth of the range
MIN_GROUP = 60
STEPS = 4
MEDIAN, INNER, OUTER = 3.357, 11.143, 23.513  # of the chi-squared law of four degrees: half, 0.975, and 0.9999, so that one normal row in 10,000 is rejected
NARROWED = 1.0645  # 0.975 by the share of the law of six degrees below INNER: what the reweighted covariance lacks
WHITE = r"\x20\x09-\x0D"
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]

VECTOR = """ln((word_chars + 1.0) / (n_words + 1.0)) AS x0, ln(1.0 + 20.0 * n_symbols / (n_words + 20.0)) AS x1,
ln(1.0 + 10.0 * n_dup_lines / (n_lines + 10.0)) AS x2, ln(1.0 + 10.0 * n_repeat_words / (n_words + 50.0)) AS x3"""
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def statistics(documents: DataFrame) -> DataFrame:
    """Counts of every text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``, ``n_repeat_words``."""
    flat = r"translate(text, '\t\n\u000b\u000c\r', '     ')"
    rows = documents.selectExpr("doc_id", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "coalesce(text, '') AS text")
    rows = rows.selectExpr(
        "doc_id", "lang", "source", f"array_remove(split({flat}, ' '), '') AS words", r"length(translate(text, ' \t\n\u000b\u000c\r', '')) AS word_chars",
        "length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols",
        r"filter(split(text, '\n'), l -> translate(l, ' \t\u000b\u000c\r', '') <> '') AS lines")
    rows = rows.selectExpr(
        "doc_id", "lang", "source", "size(words) AS n_words", "word_chars", "n_symbols", "size(lines) AS n_lines", "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
        "CASE WHEN size(words) > 2 THEN sort_array(transform(sequence(0, size(words) - 3), p -> struct(xxhash64(words[p], words[p + 1], words[p + 2]) AS k, p AS p))) END AS runs")
    kept = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.selectExpr(*kept, "sort_array(transform(filter(runs, (s, i) -> s.k <=> get(runs, i - 1).k OR s.k <=> get(runs, i + 1).k), s -> s.p)) AS places")
    covered = "aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), 0, (a, b) -> a + b)"
    return rows.selectExpr(*kept[:3], *(f"cast({c} AS long) AS {c}" for c in kept[3:]), f"cast(coalesce({covered}, 0) AS long) AS n_repeat_words")


def _grid(x: str, cells: int) -> str:
    return f"floor(({x}) * {cells}.0 + 0.5) / {cells}.0"


def _sum(terms) -> str:
    return " + ".join(terms)


def _plan(half: str) -> list[tuple[str, str]]:
    """Named queries, each over the earlier ones. ``half`` is the dialect's exact median of ``{}``."""
    median = half.format
    out = [
        ("own", "SELECT lang, source, count(*) AS n FROM stats WHERE NOT base_failed GROUP BY lang, source"),
        ("whole", "SELECT lang, sum(n) AS n_lang FROM own GROUP BY lang"),
        ("groups", f"SELECT o.lang, o.source, CASE WHEN n >= {MIN_GROUP} THEN concat('s ', o.lang, ' ', o.source) WHEN n_lang >= {MIN_GROUP} THEN concat('l ', o.lang) ELSE 'all' END AS own_g, concat('l ', o.lang) AS lang_g FROM own o JOIN whole w ON o.lang = w.lang"),
        ("used", "SELECT DISTINCT own_g AS g FROM groups"),
        ("grouped", f"SELECT s.*, own_g, {VECTOR} FROM stats s JOIN groups p ON s.lang = p.lang AND s.source = p.source WHERE NOT base_failed"),
        # an estimate is made from the rows of its own kind only: sources, languages, all
        ("member", "SELECT g, x0, x1, x2, x3 FROM (SELECT own_g AS g, x0, x1, x2, x3 FROM grouped WHERE own_g LIKE 's %' UNION ALL SELECT concat('l ', lang) AS g, x0, x1, x2, x3 FROM grouped UNION ALL SELECT 'all' AS g, x0, x1, x2, x3 FROM grouped) a WHERE g IN (SELECT g FROM used)"),
        ("centre", "SELECT g, " + ", ".join(f"{median(_grid(f'x{i}', 64))} AS m{i}" for i in range(D)) + " FROM member GROUP BY g"),
        ("spread", "SELECT g, " + ", ".join(f"greatest(1.4826 * {median(_grid(f'abs(x{i} - m{i})', 64))}, {FLOORS[i]}) AS s{i}, min(m{i}) AS m{i}" for i in range(D)) + " FROM member JOIN centre USING (g) GROUP BY g"),
    ]
    cells = 256
    place = lambda d2: _grid(f"ln(1.0 + {d2})", cells)
    start = _sum(f"(x{i} - m{i}) * (x{i} - m{i}) / (s{i} * s{i})" for i in range(D))
    out += [("fit0", f"SELECT g, x0, x1, x2, x3, {place(start)} AS d FROM member JOIN spread USING (g)")]
    for k in range(STEPS + 1):
        last = k == STEPS
        out += [(f"cut{k}", f"SELECT g, {median('d')} AS cut FROM fit{k} GROUP BY g")]
        near = f"SELECT f.* FROM fit{k} f JOIN cut{k} c USING (g) WHERE d <= cut"
        if last:  # consistent, then reweighted
            near = f"SELECT f.* FROM fit{k} f JOIN cut{k} c USING (g) WHERE exp(d) - 1.0 <= {INNER} * greatest((exp(cut) - 1.0) / {MEDIAN}, 1.0)"
        out += [(f"near{k}", near), (f"law{k}", f"SELECT g, {_moments()} FROM near{k} GROUP BY g"), (f"factor{k}", _factor(f"law{k}"))]
        if not last:
            out += [(f"fit{k + 1}", f"SELECT g, x0, x1, x2, x3, {place('d2')} AS d FROM ({_distances('member', f'factor{k}', 'g, x0, x1, x2, x3')}) a")]
    final = _distances("(SELECT *, own_g AS g FROM grouped) b", f"factor{STEPS}", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words")
    out += [("judged", f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, false AS base_failed, d2 <= {OUTER * NARROWED:.3f} AS kept FROM ({final}) a")]
    return out


def _moments() -> str:
    return ", ".join([*(f"avg(x{i}) AS m{i}" for i in range(D)), *(f"avg(x{i} * x{j}) - avg(x{i}) * avg(x{j})" + (f" + {FLOORS[i] ** 2}" if i == j else "") + f" AS c{i}{j}" for i, j in PAIRS)])


def _factor(law: str) -> str:
    """The lower triangular factor of each covariance, column by column."""
    inner = f"SELECT * FROM {law}"
    for j in range(D):
        own = _sum([f"c{j}{j}", *(f"-l{j}{k} * l{j}{k}" for k in range(j))])
        inner = f"SELECT *, sqrt(greatest({own}, 1e-12)) AS l{j}{j} FROM ({inner}) q{j}"
        below = [f"({_sum([f'c{i}{j}', *(f'-l{i}{k} * l{j}{k}' for k in range(j))])}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, D)]
        if below:
            inner = f"SELECT *, {', '.join(below)} FROM ({inner}) r{j}"
    return f"SELECT g, {', '.join([f'm{i}' for i in range(D)] + [f'l{i}{j}' for i, j in PAIRS])} FROM ({inner}) t"


def _distances(rows: str, factor: str, keep: str) -> str:
    """``keep`` and ``d2``, the squared Mahalanobis distance, by forward substitution."""
    inner = f"SELECT * FROM {rows} JOIN {factor} USING (g)"
    for i in range(D):
        inner = f"SELECT *, ({_sum([f'x{i} - m{i}', *(f'-l{i}{k} * y{k}' for k in range(i))])}) / l{i}{i} AS y{i} FROM ({inner}) u{i}"
    return f"SELECT {keep}, {_sum(f'y{i} * y{i}' for i in range(D))} AS d2 FROM ({inner}) v"


def outliers(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document.

    A null text has no words and fails the base rules; so do all short texts. Null languages and sources are a group of their own. Repeated
    rows stay and weigh as often as they occur. Other columns are ignored.
    """
    spark = documents.sparkSession
    stats = stored(statistics(documents).withColumn("base_failed", F.expr(BASE_FAILED)), "outlier-statistics")
    frames = {"stats": stats}
    written = {"groups", "spread", *(f"factor{k}" for k in range(STEPS + 1))}
    each = written | {"used", "centre", *(f"cut{k}" for k in range(STEPS + 1))}  # a row for each group
    few = False
    for name, sql in _plan("percentile({}, 0.5)"):
        text = _named(sql, frames)
        df = spark.sql(text, **{f"t_{k}": v for k, v in frames.items() if "{t_%s}" % k in text})
        if name in written:
            df = stored(df, f"outlier-{name}")
        if name == "groups":
            few = df.count() <= SMALL_ROWS
        frames[name] = F.broadcast(df) if few and name in each else df
    judged = frames["judged"]
    failed = stats.where("base_failed").withColumn("kept", F.lit(False)).select(judged.columns)
    return judged.unionAll(failed)


def _named(sql: str, frames) -> str:
    return re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{t_{m[2]}}}" if m[2] in frames else m[0], sql)


def outliers_sql() -> str:
    """DuckDB SQL for the query's rows."""
    words = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    lines = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    head = f"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, {words} AS words, {lines} AS lines FROM documents),
runs AS (SELECT r, p, words[p:p + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
counted AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN repeats USING (r)),
stats AS MATERIALIZED (SELECT doc_id, lang, source, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed FROM counted)"""
    steps = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in _plan("quantile_cont({}, 0.5)"))
    return f"WITH {head},\n{steps}\nSELECT * FROM judged UNION ALL SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, false AS kept FROM stats WHERE base_failed"
