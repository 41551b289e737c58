"""Resampling, conversation tries and substring dedup against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import common, resampling, substrings, tries

R = random.Random(5)


def prose(n, vocabulary="abcdefg"):
    return " ".join(R.choice(vocabulary) for _ in range(n))


# substring dedup


def plain_dedup(rows, window):
    texts = [[w for w in re.split("[ \t-\r]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), words in zip(rows, texts):
        for p in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, text), words in zip(rows, texts):
        gone = set()
        for p in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, None if text is None else " ".join(w for p, w in enumerate(words) if p not in gone), len(words), len(gone)))
    return sorted(out, key=repr)


def test_covers_hold_every_difference():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 20, 50])
def test_repeated_windows_like_plain_python(spark, window):
    passages = [prose(R.randint(window, 3 * window), ["on", "two", "thrée", "IV", "x."]) for _ in range(4)]
    rows = [(i, f"{prose(R.randint(0, 30), ['q', 'r', str(i)])}\t{R.choice(passages)}  {prose(R.randint(0, 9))}\n{R.choice(passages)}") for i in range(60)]
    rows += [(60, passages[0]), (61, passages[0]), (61, passages[0]), (-7, passages[1]), (None, passages[2]), (None, passages[2]), (62, None), (63, ""), (64, " \n"), (65, "a " * 400), (66, "a " * 300), (67, "a b c " * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substrings.drop_repeated_windows(frame, window).collect()), key=repr)
    assert got == plain_dedup(rows, window)


def test_repeated_windows_keep_other_columns(spark):
    frame = spark.createDataFrame([(1, "t", "x", 5, 7), (2, None, "y", 6, 8)], "doc_id long, text string, `a.b` string, row int, n_words int")
    got = substrings.drop_repeated_windows(frame)
    assert got.columns == ["doc_id", "text", "a.b", "row", "n_words", "n_removed"] and sorted(r["a.b"] for r in got.collect()) == ["x", "y"]
    assert substrings.drop_repeated_windows(frame.where("false")).collect() == []


def test_repeated_windows_past_every_bound(spark):
    """A full bit set and a full memory of met windows only cost rows."""
    words = np.array([R.randrange(1 << 62) for _ in range(300)], np.uint64)
    h, g = substrings.Runs(words).hashes(np.arange(290), 10)
    again = substrings.Runs(words[100:]).hashes(np.arange(190), 10)
    assert (h[100:] == again[0]).all() and (g[100:] == again[1]).all() and len(set(h.tolist())) == 290
    full = np.full(64, np.uint64(2**64 - 1))
    assert common.in_bit_set(h, full).all() and not common.in_bit_set(h, np.zeros(64, np.uint64)).any()
    met = substrings._Met()
    met.add(h[:5], np.arange(5))
    met.add(h[3:8], np.full(5, 1))
    assert met.low_of(h[:9]).tolist() == [0, 1, 2, 1, 1, 1, 1, 1, np.iinfo(np.int64).max]


# resampling


def plain_features(text, order, buckets):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)


@pytest.mark.parametrize("order, buckets", [(1, 10_000), (3, 50)])
def test_resampling_like_plain_python(spark, order, buckets):
    rows = [(i, prose(R.randint(0, 60), ["Étude", "a1", "The", "the,", "x--y", "zu"])) for i in range(80)] + [(80, None), (81, ""), (82, "... !"), (None, prose(40)), (5, prose(30)), (5, prose(30)), (83, "long " * 70_000)]
    target = [(i, prose(30, ["Étude", "the", "und"])) for i in range(5)] + [(None, None)]
    frame = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, score int, row string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_features, r.weight, r.score, r["rank"] or 0) for r in resampling.importance_scores(frame, spark.createDataFrame(target, "item_id long, text string"), order, buckets, percent=30).collect())
    found = [plain_features(t, order, buckets) for _, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for x, _ in found:
        for b in x:
            s[b] += 1
    for _, text in target:
        for b in plain_features(text, order, buckets)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (x, words) in zip(rows, found):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([-1 if i is None else i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), 0, words])
    usable = [x for x in out if x[5] >= 20]
    for place, x in enumerate(sorted(usable, key=lambda x: (-x[3], x[0]))[: 30 * len(usable) // 100]):
        x[4] = place + 1
    assert got == sorted(tuple(x[:5]) for x in out)


def test_resampling_of_nothing_and_ties(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_scores(empty, empty).collect() == []
    monkeypatch.setattr(resampling, "ROWS", 7)  # ranks run on over many ranges, and ties are split
    same = spark.createDataFrame([(3, "w " * 25)] * 90 + [(4, "w " * 25)] * 10, "doc_id long, text string")
    got = resampling.importance_scores(same, empty, percent=95).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 96))
    drawn = resampling.resampled(same, empty, percent=95)
    assert drawn.columns == ["doc_id", "text", "rank"] and drawn.count() == 100


# conversation tries


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {c: tuple(own.get(c - int(math.fmod(c, 100)), [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_turns, fan", [(100_000, 64), (40, 2), (5, 3)])
def test_trie_like_plain_python(spark, shard_turns, fan):
    texts = ["Hi", "Hello é", "", None, "long " * 3_000]
    rows = [(c, t, R.choice(["user", None]), R.choice(texts[: 2 + t])) for c in [*range(40), *range(100, 160, 3), *range(200, 230), -150, -149, -100, 345] for t in range(R.randint(1, 4))]
    rows += [(7, None, "system", "first"), (100, None, None, None), (None, 0, "user", "no conversation"), (230, 0, "user", "Hi"), (230, 1, "user", "Hi"), (230, 1, "user", "Hi")]
    rows += [(c, t, "user", f"turn {t}") for c in (300, 301) for t in range(120)] + [(c, 0, "user", "same") for c in range(400, 500)]
    rows = [(c, 10 * i if t is not None and c not in (230,) else t, role, text) for i, (c, t, role, text) in enumerate(rows)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)
    got = sorted((tuple(r) for r in tries.prefix_trie(frame, shard_turns, fan).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tries.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # loses its only turn, and conversation 100 is absent
    got = tries.prefix_trie(spark.createDataFrame([(c, 0, "user", "x")], schema)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_digests_run_on_over_slices(spark):
    schema = "conv_id long, turn long, role string, text string"
    ids = [c for c in range(0, 60_000, 7)]
    got = tries.prefix_trie(spark.createDataFrame([(c, 0, "u", "x") for c in ids], schema)).collect()
    kept = {True: [], False: []}
    for c in ids:
        base, h = c - c % 100, zlib.crc32(str(c).encode()) % 6
        kept[h == 0 or base % 7 == 0].append(c)
    want = {hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in kept.values()}
    assert {r.ends_sha256 for r in got} == want


def test_tree_is_balanced():
    tree = tries.TernaryTree()
    tree.insert_sorted([([i, i + 1], [1, 1], (1, i, "")) for i in range(1_000)])
    for i in range(1_000):
        at, steps = tree.down[0], 0
        while tree.key[at] != i:
            at, steps = (tree.low if i < tree.key[at] else tree.high)[at], steps + 1
        assert steps <= 10
