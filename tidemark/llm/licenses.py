"""Licences by sentence rules, in DataFrame operations only.

A text is cut at punctuation, blank lines (also those of comments) and list items. What is left between two cuts is a sentence as a whole, wherever it is wrapped,
and each of its lines is one as well, since a short notice often has no mark at its end. Sentences are normalised, which takes comment
leaders away, and looked up among known licence sentences. What is left of a text is a sequence of sentence numbers, which is
matched against ordered rules: a rule applies where its sentences follow one another, with unknown ones between them, within ``SPAN`` cuts.
A match within a longer one is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Normalised sentences of well-known licence notices, by licence, in the order in which the notice has them.
_NOTICES = {
    "MIT": [
        ["released under the mit license"], ["licensed under the mit license"], ["this software is released under the mit license"],
        ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
        ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    ],
    "Apache-2.0": [
        ["licensed under the apache license version 2.0"], ["released under the apache license version 2.0"],
        ["licensed under the apache license version 2.0 the license", "you may not use this file except in compliance with the license"],
    ],
    "BSD-3-Clause": [
        ["released under the bsd 3 clause license"], ["licensed under the bsd 3 clause license"],
        ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    ],
    "BSD-2-Clause": [
        ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    ],
    "MPL-2.0": [["this source code form is subject to the terms of the mozilla public license v"], ["this source code form is subject to the terms of the mozilla public license v 2.0"], ["licensed under the mozilla public license version 2.0"]],
    "ISC": [["released under the isc license"], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"]],
    "Unlicense": [["this is free and unencumbered software released into the public domain"], ["released under the unlicense"]],
    "CC0-1.0": [["licensed under cc0 1.0"], ["released under cc0 1.0"], ["licensed under cc0 1.0 universal"], ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"]],
    "Zlib": [["licensed under the zlib license"], ["released under the zlib license"], ["this software is provided as is without any express or implied warranty", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"]],
    "EPL-2.0": [["licensed under the eclipse public license version 2.0"], ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0"], ["this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which is available at https www.eclipse.org legal epl v20.html"]],
    "BSL-1.0": [["distributed under the boost software license version 1.0"], ["licensed under the boost software license version 1.0"]],
    "Proprietary": [["all rights reserved"]],
}
_CREATIVE = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_TERMS, _LATER = "you can redistribute it and or modify it under the terms of the", "of the license or at your option any later version"
_GNU = (("GPL", "gnu general public license"), ("LGPL", "gnu lesser general public license"), ("AGPL", "gnu affero general public license"))


def rules() -> list[tuple[str, list[str]]]:
    """(licence, normalised sentences in order); numbered families are built from their parts."""
    out = [(name, notice) for name, notices in _NOTICES.items() for notice in notices]
    for kind in _CREATIVE:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            short = f"cc {kind.replace('-', ' ')} {version}"
            out += [(f"CC-{kind.upper()}-{version}", [f"{verb} {short}"]) for verb in ("licensed under", "released under", "this work is licensed under", "this text is available under")]
    for short, long in _GNU:
        for version in ("2", "2.1", "3"):
            out += [(f"{short}-{version}", [f"{verb} the {long} version {version}"]) for verb in ("licensed under", "released under", "this work is licensed under", "distributed under")]
            # 'This program is free software' stands before a colon or semicolon; the version after a comma or a semicolon
            terms = f"{_TERMS} {long} as published by the free software foundation"
            out += [(f"{short}-{version}", [f"{terms} either version {version} {_LATER}"]), (f"{short}-{version}", [terms, f"either version {version} {_LATER}"])]
            out += [(f"{short}-{version}", [f"{_TERMS} {long} version {version} as published by the free software foundation"])]
    return out


def _tables() -> tuple[list[tuple[int, str]], list[tuple[int, str, list[int]]]]:
    sentences = sorted({s for _, notice in rules() for s in notice})
    number = {s: i + 1 for i, s in enumerate(sentences)}
    return [(i, s) for s, i in number.items()], [(k, name, [number[s] for s in notice]) for k, (name, notice) in enumerate(rules())]


SPLIT = r"[.;:!?]+[\\x20\\x09-\\x0D]+|[.;:!?]+$|\\n[ \\t#*/]*\\n|\\n[ \\t#*/]*(?:-|[0-9]+[.)])[ \\t]"
SPAN = 40  # cuts within which the sentences of a rule stand


def _normal(sentence: str, last: str = "") -> str:
    return f"trim(regexp_replace(lower({sentence}), '[^a-z0-9.]+', ' '{last}))"


def licences(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_sentences`` (known ones), ``matches`` (array of place among them, licence) and ``licences`` (sorted) of every document.

    Null and empty texts have none. Repeated rows stay, null ids too; other columns are ignored. Very long texts are cut as a whole; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    sentences, patterns = _tables()  # fixed tables of a few hundred rows
    known = spark.createDataFrame([(0, "\u0001"), *sentences], "sentence int, normal string")
    rule = spark.createDataFrame(patterns, "rule int, licence string, ids array<int>").withColumn("head", F.expr("ids[0]"))
    rows = documents.selectExpr("doc_id", "xxhash64(text) AS sig", f"split(coalesce(text, ''), '{SPLIT}') AS parts")
    # place -1 holds a mark, so that texts without a licence stay; 0 under a place is a whole sentence, then come its lines
    pieces = "flatten(transform(parts, (s, i) -> transform(concat(array(s), CASE WHEN instr(s, '\\n') > 0 THEN split(s, '\\n') ELSE array() END), (x, k) -> struct(i AS place, k AS sub, x AS part))))"
    rows = rows.selectExpr("doc_id", "sig", f"explode(concat(array(struct(-1 AS place, 0 AS sub, '\u0001' AS part)), {pieces})) AS piece").selectExpr("doc_id", "sig", "piece.place", "piece.sub", "piece.part")
    rows = rows.selectExpr("doc_id", "sig", "place", "sub", f"CASE WHEN place < 0 THEN part ELSE {_normal('part')} END AS normal")
    found = rows.join(F.broadcast(known), "normal").where("(place < 0) = (sentence = 0)")
    found = found.groupBy("doc_id", "sig").agg(F.expr("count_if(sentence = 0)").alias("copies"), F.expr("array_sort(collect_set(CASE WHEN sentence > 0 THEN struct(place, sub, sentence) END))").alias("known"))
    found = found.selectExpr("doc_id", "sig", "copies", "known.place AS places", "known.sentence AS ids")
    heads = found.selectExpr("doc_id", "sig", "copies", "ids", "places", "posexplode_outer(ids) AS (at, head)").join(F.broadcast(rule.withColumnRenamed("ids", "wanted")), "head", "left")
    near = f"places[at + size(wanted) - 1] - places[at] <= {SPAN}"
    hit = f"CASE WHEN slice(ids, at + 1, size(wanted)) = wanted AND {near} THEN struct(at AS at, at + size(wanted) AS upto, licence AS licence) END"
    matched = heads.groupBy("doc_id", "sig").agg(F.first("copies").alias("copies"), F.first("ids").alias("ids"), F.expr(f"array_sort(collect_set({hit}))").alias("all"))
    best = "filter(all, m -> NOT exists(all, o -> o.at <= m.at AND o.upto >= m.upto AND o.upto - o.at > m.upto - m.at))"
    out = matched.selectExpr("doc_id", "copies", "cast(size(ids) AS long) AS n_sentences", f"{best} AS matches")
    out = out.selectExpr("doc_id", "copies", "n_sentences", "transform(matches, m -> struct(m.at, m.licence)) AS matches", "array_sort(array_distinct(transform(matches, m -> m.licence))) AS licences")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_sentences", "matches", "licences")


def licences_sql() -> str:
    """DuckDB SQL for the query's rows."""
    sentences, patterns = _tables()
    known = ", ".join(f"({i}, '{s}')" for i, s in sentences)
    rule = ", ".join(f"('{name}', {ids})" for _, name, ids in patterns)
    split = SPLIT.replace("\\\\", "\\")
    return f"""
WITH known(sentence, normal) AS (VALUES {known}), rule(licence, wanted) AS (VALUES {rule}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '{split}') AS parts FROM documents),
w AS (SELECT r, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM d),
l AS (SELECT r, place, CASE WHEN contains(part, chr(10)) THEN list_prepend(part, string_split(part, chr(10))) ELSE [part] END AS pieces FROM w),
s AS (SELECT r, place, unnest(pieces) AS part, unnest(range(len(pieces))) AS sub FROM l),
f AS (SELECT r, list(sentence ORDER BY place, sub) AS ids, list(place ORDER BY place, sub) AS places FROM s JOIN known ON normal = {_normal('part', ", 'g'").replace("' ', 'g')", "' ', 'g')")} GROUP BY r),
h AS (SELECT r, pos, pos + len(wanted) AS upto, licence FROM (SELECT r, ids, places, unnest(range(len(ids))) AS pos FROM f), rule WHERE ids[pos + 1:pos + len(wanted)] = wanted AND places[pos + len(wanted)] - places[pos + 1] <= {SPAN}),
b AS (SELECT DISTINCT r, pos, licence FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.pos <= h.pos AND o.upto >= h.upto AND o.upto - o.pos > h.upto - h.pos)),
g AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS l FROM b GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(l, '') AS licences FROM d LEFT JOIN f USING (r) LEFT JOIN g USING (r)"""
