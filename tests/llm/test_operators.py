"""Operators against brute force, and odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import decontaminate, jaccard, kneser_ney, licenses, outliers, packing, pii, revisit, templates, toxicity, words

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdeé") for _ in range(RANDOM.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000)
BASE = prose(120)
TEXTS = [None, "", "   \n\t ", "a", BASE, BASE, BASE.replace(" ", "  ").upper(), BASE + " more", LONG, prose(60), "x y z", "X  y\nz", "\x00 \x1f ünï 😀 <|endoftext|>"]
DOCS = list(enumerate(TEXTS)) + [(3, "a"), (None, BASE), (None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, h long, key string, words string, place int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", 1, "k", "w", 2, 0.5) for i, t in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().lower().split()


def test_words_match_split():
    import pyarrow as pa

    texts = pa.array(TEXTS)
    seen = {}
    for low, high, offsets, data in words.blocks(texts):
        found = words.find_words(data, offsets)
        for d in range(high - low):
            own = found.hashes[found.first[d] : found.first[d + 1]].tolist()
            want = split(TEXTS[low + d])
            assert len(own) == len(want)
            for h, w in zip(own, want):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_packing_round_trip(docs, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.pack(docs, capacity=64).collect()
    want = Counter()
    for i, t in DOCS:
        want[(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    whole = {(i, ids) for i, ids in want}
    for (i, ids), n in want.items():
        own = [r for r in rows if r.doc_id == i and r.doc_tokens == len(ids) and tuple(np.frombuffer(r.ids, "<u4")) == ids[r.start : r.start + r.length]]
        assert sum(r.length for r in own) >= n * len(ids)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert whole and packing.pack(none).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    path = grid[np.argsort(packing.hilbert_key(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def links(rows, width=5, percent=75):
    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def test_jaccard_against_brute_force(spark, docs, none):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == links(DOCS)
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROAD", 4)
    base, rows = prose(100).split(), []
    for i in range(150):
        own = list(base)
        for _ in range(i % 9):
            own[RANDOM.randrange(100)] = RANDOM.choice(VOCABULARY)
        rows.append((i, " ".join(own)))
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == links(rows)


def test_kneser_ney_sums_to_one(spark, docs, none):
    rows = kneser_ney.language_model_scores(docs).collect()
    assert len(rows) == len(DOCS)
    train = Counter()
    for i, t in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*split(t), None])
    for r in rows:
        own = [split(t) + [None] for i, t in DOCS if i == r.doc_id]
        assert r.train_tokens == sum(train.values()) and r.n_tokens in [len(w) for w in own] and r.score <= 0
        assert r.n_known in [sum(train[x] > 0 for x in w) for w in own]
    assert kneser_ney.language_model_scores(none).count() == 0
    # the model's next-token probabilities after one context, over all training tokens and one unknown, sum to one
    texts = [w.decode() for w in train if w is not None] + ["¤unknown"]
    model = kneser_ney.fit(docs.where("doc_id IS NULL OR crc32(cast(doc_id AS string)) % 5 <> 1"))
    one = spark.createDataFrame([(k, False, t) for k, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    first = one.mapInArrow(kneser_ney._scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").toPandas()
    empty = spark.createDataFrame([(0, False, "")], "doc_id long, held_out boolean, text string").mapInArrow(kneser_ney._scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").first()
    assert first["score"].notna().all() and 0 < 10**empty.score < 1


def test_toxicity_finds_learned_words(spark, none):
    rows = [(i, f"{prose(40)} {'nasty vile ' if i % 4 == 0 else ''}{prose(40)}") for i in range(240)] + [(240, None), (None, "nasty vile"), (241, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(240, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 240:
            assert r.predicted == int(r.doc_id % 4 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    text = dict(rows)
    assert any("nasty" in text[r.doc_id][p.start : p.stop] for r in got for p in r.passages if r.doc_id is not None)
    assert toxicity.toxicity(none.select("doc_id", "text"), labels).count() == 0


def test_maximal_segments_against_definition():
    for _ in range(200):
        n = RANDOM.randint(1, 12)
        places = sorted(RANDOM.sample(range(n), RANDOM.randint(0, n)))
        scores = [RANDOM.choice([1.0, 2.0, 3.0]) for _ in places]
        found = toxicity.maximal_segments(places, scores, -1.0)
        line = [-1.0] * n
        for p, s in zip(places, scores):
            line[p] = s
        best = max((sum(line[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        if places:
            assert max(s for _, _, s in found) == pytest.approx(best)
        assert all(sum(line[a : b + 1]) == pytest.approx(s) for a, b, s in found)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def test_contamination_windows(spark, docs, none):
    item = " ".join(LONG.split()[100:140])
    items = spark.createDataFrame([("long", item), ("short", "x y z"), ("one", "a"), ("none", None), (None, "a b"), ("empty", "")], "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contamination(docs, items).collect())
    windows = {"short": [["x", "y", "z"]], "one": [["a"]], "long": [item.split()[k : k + 13] for k in range(len(item.split()) - 12)]}
    want = Counter()
    for i, t in DOCS:
        import re

        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        hit, found = set(), set()
        for name, own in windows.items():
            for win in own:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(name)
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    assert got == want
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).count() == len(DOCS)


def test_outliers_reject_far_rows(spark, docs, none):
    rows = [(i, prose(100), "en", "s") for i in range(150)] + [(150, " ".join(w + "#$%&***" for w in prose(100).split()), "en", "s"), (151, None, None, None)]
    got = {r.doc_id: r for r in outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(150)) and not got[150].kept and not got[150].base_failed and got[151].base_failed
    out = outliers.outliers(docs).collect()
    assert len(out) == len(DOCS)
    assert outliers.outliers(none).count() == 0


def test_personal_data(spark, docs, none):
    rows = [(i, f"{prose(5)} a{i}@mail.example.com {prose(3)} 4111 1111 1111 1111 or +1 (212) 555-01{i % 90 + 10} {prose(3)} 10.0.0.{i} {i}1234567890123456") for i in range(60)]
    rows += [(60, None), (61, "call (212) 555-0199 now"), (None, "x@y.zz")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert all({s.kind for s in got[i].base} == {0, 1, 2, 3} for i in range(60))
    assert got[60].base == [] and got[None].base[0].kind == 0
    assert all(s.end <= a.start or a.end <= s.start for r in got.values() for s in r.base for a in r.added)
    assert pii.personal_data(docs).count() == len(DOCS) and pii.personal_data(none).count() == 0


def test_licences(spark, docs, none):
    text = "Intro. Licensed under the Apache License, Version 2.0.\nAll rights reserved."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Released under the MIT License."), (3, "Released under the MIT License.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_sentences, tuple(r.licences)) for r in licenses.licences(rows).collect())
    assert got == [(1, 2, ("Apache-2.0", "Proprietary")), (2, 0, ()), (3, 1, ("MIT",)), (3, 1, ("MIT",))]
    assert licenses.licences(docs).count() == len(DOCS) and licenses.licences(none).count() == 0


def test_line_templates(spark, docs, none):
    passage = prose(60)
    rows = [(i, f"{prose(80)}\n{passage}\nRun {i} took {i * 7} seconds in all\n{prose(70)}", "x") for i in range(8)] + [(8, None, "x"), (9, "", "x"), (10, passage, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = {r.doc_id: r for r in templates.drop_recurring_lines(frame).collect()}
    assert all(passage not in got[i].text and "seconds" not in got[i].text and got[i].n_dropped == 2 for i in range(8))
    assert got[8].text is None and got[9].text == "" and got[10].text == "" and got[0].line == "x"
    assert templates.drop_recurring_lines(docs).count() == len(DOCS) and templates.drop_recurring_lines(none).count() == 0


def test_lines_alike_where_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, f"{prose(30)}\nall the same words here\n{prose(30)}") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(templates.drop_recurring_lines(frame).collect())
    monkeypatch.setattr(templates, "SMALL_ROWS", 0)
    assert sorted(templates.drop_recurring_lines(frame).collect()) == one


def test_revisits(spark):
    ddl = "record_id long, url string, time long, etag string, last_modified string, headers map<string, string>"
    full = spark.createDataFrame([(1, "http://www.A.com/p?b=2&a=1#x", 100, '"1"', None, {"etag": '"1"', "content-type": "t"}), (2, "https://a.com/p/?a=1&b=2&utm_x=1", 200_000, '"2"', None, {}), (3, None, 5, None, None, {})], ddl)
    again = spark.createDataFrame([(10, "a.com/p?a=1&b=2", 100, '"1"', None, {}), (11, "a.com/p?a=1&b=2", 199_999, 'W/"1"', None, {"content-type": "no", "date": "d"}), (12, "a.com/p?a=1&b=2", 400_000, '"1"', None, {}), (13, "a.com/p?a=1&b=2", 101, None, None, None), (14, None, 9, None, None, {})], ddl)
    got = {r.record_id: (r.refers_to, r.verdict, r.headers) for r in revisit.resolve_revisits(full, again).collect()}
    assert got[10][:2] == (None, "missing") and got[14][:2] == (None, "missing")
    assert got[11] == (1, "resolved", {"etag": '"1"', "content-type": "t", "date": "d"})
    assert got[12][:2] == (2, "mismatch") and got[13][:2] == (1, "unvalidated")


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
