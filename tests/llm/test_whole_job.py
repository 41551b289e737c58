"""Cases in which operators did less than the whole job."""

import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from tidemark.llm import licenses, outliers, templates, toxicity

RANDOM = random.Random(11)
VOCABULARY = ["".join(RANDOM.choice("abcdeé") for _ in range(RANDOM.randint(2, 7))) for _ in range(2_000)]


def prose(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


def test_recurring_lines_go_whatever_their_share(spark):
    often, twice, short = prose(60), prose(51), prose(50)
    rows = [(i, f"{often}\n{prose(20)}") for i in range(4)] + [(4, f"{twice}\n{prose(5)}"), (5, f"{prose(6)}\n{twice}"), (6, f"{short}\n{prose(7)}"), (7, f"{short}\n{prose(8)}")]
    got = {r.doc_id: r for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(often not in got[i].text and got[i].n_dropped == 1 for i in range(4))
    assert all(twice not in got[i].text and got[i].n_dropped == 1 for i in (4, 5))
    assert all(short in got[i].text and got[i].n_dropped == 0 for i in (6, 7))


def test_pipeline_empties_texts_of_recurring_lines_only(spark):
    one, two = prose(60), prose(60)
    texts = [f"{one}\n{prose(20)}", f"{two}\n{prose(20)}", f"{one}\n{two}", one, one, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert len(got) == len(texts) and (got[2].text, got[2].n_chars) == ("", 0)
    assert got[3].text == got[4].text == one and got[5].text is None and got[6].text == ""


def plain_recurring(texts, min_docs=3, long_docs=2, long_words=50, constant=0.5):
    """The lines that recur, from the definition: half of a line's tokens, the most frequent at their places in its leaf, are its template."""
    docs = Counter(m for t in texts for m in templates._forms(t))
    leaf = {m: (m.count(" "), *m.split(" ")[:3]) for m in docs}
    places, leaf_docs = Counter(), Counter()
    for m, n in docs.items():
        leaf_docs[leaf[m]] += n
        for i, t in enumerate(m.split(" ")):
            if t != templates.WILD:
                places[leaf[m], i, t] += n
    least = {m: long_docs if m.count(" ") >= long_words else min_docs for m in docs}
    shape = {}
    for m in docs:
        tokens = [(-places[leaf[m], i, t], i, t) for i, t in enumerate(m.split(" ")) if t != templates.WILD and places[leaf[m], i, t] >= least[m]]
        need = math.ceil(constant * len(m.split(" ")))
        if len(tokens) >= need:
            shape[m] = (leaf[m], frozenset((i, t) for _, i, t in sorted(tokens)[:need]))
    together = Counter()
    for m, x in shape.items():
        together[x] += docs[m]
    return {m for m in docs if docs[m] >= least[m] or m in shape and together[shape[m]] >= least[m]}


@pytest.mark.parametrize("hot", [1 << 15, 0, 3])
def test_templates_like_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(templates, "HOT", hot)
    heads, tails = ["the post was", "run 7 took", "a b c"], ["red", "green", "blue", "now 12", "here"]
    for _ in range(3):
        texts = ["\n".join(f"{RANDOM.choice(heads)} {RANDOM.choice(tails)} {RANDOM.choice(tails)} {RANDOM.choice('xyz')}{RANDOM.choice(['', ' end', ' ' + prose(1)])}" for _ in range(RANDOM.randint(0, 4))) for _ in range(40)]
        texts += [texts[0], texts[1], "", None, "the post was red red x"]
        gone = plain_recurring(texts)
        want = []
        for t in texts:
            lines = [(x, templates.masked(x)) for x in (t or "").split("\n")]
            known = sum(m in gone for _, m in lines)
            whole = known and known == sum(bool(m) for _, m in lines)
            if t is None or not known or whole and texts.count(t) > 1:
                want.append((t, known, 0))
            else:
                want.append(("" if whole else "\n".join(x for x, m in lines if m not in gone), known, known))
        frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_dropped int, `a.b` string").repartition(3)
        got = templates.drop_recurring_lines(frame)
        assert got.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped", "n_recurring"]
        assert [(r.text, r.n_recurring, r.n_dropped) for r in sorted(got.collect())] == want


def test_variants_of_a_frequent_line_go(spark):
    def name(i):
        return "".join(chr(97 + int(d)) for d in f"{i:04d}")

    same = "This post was written by nobody yesterday"
    rows = [(i, f"{prose(60)}\n{same}") for i in range(200)]
    rows += [(200 + i, f"{prose(60)}\nThis post was removed from {name(i)} today") for i in range(20)]  # a tenth of the leaf
    rows += [(300, f"{prose(60)}\nThis post was written by somebody yesterday")]  # one variant of a line that recurs
    rows += [(301, f"{prose(60)}\nThis post was never shown anywhere else")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in templates.drop_recurring_lines(frame).collect()}
    assert all(got[i] == 1 for i in range(220)) and got[300] == 1 and got[301] == 0


def test_templates_alike_where_tokens_are_joined(spark, monkeypatch):
    rows = [(i, f"{prose(60)}\nall the same words by {'abcdefghijkl'[i]} here\n{prose(9)}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(templates.drop_recurring_lines(frame).collect())
    assert all(r.n_dropped == 1 for r in one)
    monkeypatch.setattr(templates, "SMALL_ROWS", 2)
    assert sorted(templates.drop_recurring_lines(frame).collect()) == one


def test_toxic_near_copies_of_clean_texts_are_witnesses(spark, monkeypatch):
    shared = prose(1_000)
    rows = [(i, f"{shared} {prose(5)}{' nasty vile' if i % 4 == 0 else ''}") for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = sorted(toxicity.toxicity(frame, labels).collect())
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    monkeypatch.setattr(toxicity, "LEXICON", 2)  # too many to broadcast: mapped
    assert sorted(toxicity.toxicity(frame, labels).collect()) == got


def test_exact_copies_with_both_labels_stay(spark):
    rows = [(i, f"{prose(50)}{' nasty vile' if i < 40 else ''}") for i in range(160)] + [(160 + i, f"alike {'nasty vile ' * 3}text") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, int(i < 40 or i >= 180)) for i in range(200)], "doc_id long, toxic int"))
    assert len(model.hashes) and model.slope > 0


def test_each_statistic_rejects_by_itself(spark):
    lines = "\n".join(f"{prose(40)}\nShare\nShare\nShare" for _ in range(10))
    words = prose(100).split()
    symbols = " ".join(w + "#" * (i % 10 < 3) for i, w in enumerate(words))
    again = prose(45)
    planted = {"lines": lines, "symbols": symbols, "windows": f"{prose(110)} {again} {prose(10)} {again}"}
    rows = [(f"good {i}", prose(100), "en", "s") for i in range(150)] + [(f"few {i}", prose(100), "de", "t") for i in range(20)]
    rows += [(f"{name} {lang}", text, lang, source) for name, text in planted.items() for lang, source in (("en", "s"), ("de", "t"))]
    got = {r.doc_id: r for r in outliers.outliers(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    for name, r in got.items():
        assert not r.base_failed and r.kept == name.startswith(("good", "few")), name


def test_real_notices(spark):
    mit = (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    )
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    want = {
        "MIT": mit, "MPL-2.0": mpl, "GPL-2": gnu.format("program", ";", "", ";", 2), "GPL-3": gnu.format("program", ":", "", ",", 3),
        "LGPL-2.1": gnu.format("library", ";", "Lesser ", ";", 2.1), "AGPL-3": gnu.format("program", ":", "Affero ", ",", 3),
        "ISC": "Released" + " " * 5_000 + "under the ISC License.",
    }
    rows = spark.createDataFrame(list(want.items()), "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licenses.licences(rows).collect()} == {name: [name] for name in want}


def test_wrapped_notices(spark):
    """Each notice at two widths, plain and as a comment, also beside other text; and notices too far apart."""
    import textwrap

    raw = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.",
        "BSD-3-Clause": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "GPL-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE)",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    rows, want = [], {}
    for name, text in raw.items():
        for width in (72, 80):
            for leader in ("", "# ", " * ", "// "):
                lines = [x for par in text.split("\n\n") for x in [*textwrap.wrap(par, width - len(leader)), ""]]
                wrapped = "\n".join((leader + x).rstrip() for x in lines)
                key = f"{name} {width} {leader}"
                rows.append((key, f"def f():\n    pass\n\n{wrapped}\n\nAnd more text\nof another kind"))
                want[key] = [name]
    rows += [("line", "Some words\nReleased under the MIT License\nmore words"), ("far", raw["MIT"].split("\n\n")[0] + " Word. " * 60 + raw["MIT"].split("\n\n")[1])]
    want |= {"line": ["MIT"], "far": []}
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.licences for r in licenses.licences(frame).collect()}
    assert got == want
