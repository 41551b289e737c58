"""The corpus pipeline stage by stage, with null and repeated ids, and from end to end."""

import random

import corpus_pipeline
import pytest

RANDOM = random.Random(17)
VOCABULARY = ["".join(RANDOM.choice("abcdefgh") for _ in range(RANDOM.randint(3, 8))) for _ in range(3_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and benchmark items beside documents, of which a quarter is toxic."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("item", ITEM)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


ITEM = prose(40)
LABELLED = [(i, f"{prose(60)}{' nasty vile' if i % 4 == 0 else ''}") for i in range(200)]


def left(out):
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_toxic_rows_go_whatever_their_id(spark, folder):
    bad = [(None, f"{prose(40)} nasty vile"), (1, f"{prose(40)} vile nasty")]
    good = [(i, t) for i, t in LABELLED if i % 4] + [(None, prose(40)), (None, None), (500, ""), (500, "")]
    rows = [r for r in LABELLED if r[0] % 4 == 0] + bad + good
    assert left(corpus_pipeline.drop_toxic(spark, frame(spark, rows), folder)) == sorted(good, key=repr)


def test_one_row_of_each_class_stays(spark, folder):
    one, other = prose(200), prose(200)
    near = one.split()
    near[100] = "changed"
    rows = [(5, one), (3, one), (None, one), (7, " ".join(near)), (8, other), (8, prose(50)), (None, other + " end"), (None, None), (9, None), (10, ""), (11, ""), (12, " \n"), (None, prose(60))]
    got = left(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), folder))
    assert sum(t in (one, " ".join(near)) for _, t in got) == 1 and sum(t in (other, other + " end") for _, t in got) == 1
    assert (5, one) not in got and (None, one) not in got
    assert [r for r in rows if r[1] in (None, "", " \n") or r[1] not in (one, other, other + " end", " ".join(near))] == [r for r in rows if r in got and r[1] not in (one, other, other + " end", " ".join(near))]


def test_contaminated_rows_go_whatever_their_id(spark, folder):
    passage = " ".join(ITEM.split()[5:25])
    bad = [(None, f"{prose(30)} {passage}"), (1, passage)]
    good = [(1, prose(60)), (None, prose(50)), (None, None), (2, ""), (3, f"{prose(900)} {passage}")]
    assert left(corpus_pipeline.drop_contaminated(spark, frame(spark, bad + good), folder)) == sorted(good, key=repr)


def test_packing_holds_every_token(spark, folder):
    rows = [(1, prose(300)), (1, prose(20)), (None, prose(5)), (2, None), (3, "")]
    out = corpus_pipeline.pack_documents(spark, frame(spark, rows), folder).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0) and {r.doc_id for r in out} == {1, 2, 3, None}


def test_the_whole_pipeline(spark, folder):
    often, copy = prose(60), prose(100)
    rows = LABELLED + [(300 + i, f"{prose(80)}\n{often}") for i in range(3)] + [(400, copy), (401, copy), (None, copy), (402, f"{prose(20)} {ITEM}"), (403, prose(70)), (None, f"{prose(50)} nasty vile")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert ids & set(range(0, 200, 4)) == set() and set(range(1, 200, 2)) <= ids
    assert len(ids & {400, 401, None}) == 1 and 402 not in ids and {300, 301, 302, 403} <= ids
    sums = {}
    for r in out:
        sums.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(have == want for have, want in sums.values())
