from collections import Counter

import corpus_pipeline as cp
from claimloom.llm import mixing
from claimloom.llm._shared import table, written
from tests.llm.test_byte_bpe import brute as encoded
from tests.llm.test_ngram_join import brute as grouped

SPACES = " \t\n\x0b\x0c\r"


def by_hand(docs):
    """The first three stages, on rows (doc_id, text)."""
    docs = [r for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]
    best = {}
    for r in docs:
        key = "".join(c for c in r["text"] if c not in SPACES)
        if key not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[key]["text"]), best[key]["doc_id"]):
            best[key] = r
    groups, _ = grouped([(r["doc_id"], r["text"]) for r in best.values()])
    return {r["doc_id"]: r for r in best.values() if groups[r["doc_id"]][1] == r["doc_id"]}


def staged(spark, docs, sf):
    out = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        if name != cp.STAGES[-1][0]:
            assert tuple(docs.columns) == cp.COLUMNS
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    _, _, near, mix, ids = staged(spark, docs, sf)
    want = by_hand([r.asDict() for r in docs.collect()])
    assert {r["doc_id"]: r.asDict() for r in near.collect()} == want
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(near).collect()}
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert sorted(tuple(r) for r in ids.collect()) == sorted(
        (i, *encoded(want[i]["text"])) for i, n in copies.items() for _ in range(n)
    )


def test_edges(spark, sf):
    long = "lorem ipsum dolor sit amet " * 30
    rows = [
        (1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long + " ", "en", "a", 1), (3, None, "en", "a", 1), (4, "", "en", "a", 1),
        (5, "123 !!", "en", "b", 1), (6, long + "other", "en", None, 1), (None, "a text without a number of its own", None, "b", 1), (7, "x", "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("body", cp.F.lit(1))
    _, exact, near, _, ids = staged(spark, docs, sf)
    assert sorted((r["doc_id"] for r in exact.collect()), key=str) == [2, 6, 7, None]
    assert sorted((r["doc_id"] for r in near.collect()), key=str) == [2, 7, None]
    assert ids.count() > 0
    assert all(x.count() == 0 for x in staged(spark, docs.limit(0), sf))


def test_null_and_repeated_ids_whose_texts_are_kept_elsewhere(spark, sf):
    rows = [(None, "aa"), (None, "a a"), (None, "bb"), (5, "bb"), (7, "cc"), (7, "cc"), (7, "dd"), (8, "d d"), (None, "cc")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.one_of_equal_texts(spark, docs, sf)
    assert tuple(got.columns) == cp.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, "a a"), (5, "bb"), (7, "cc"), (8, "d d")], key=str)
