import random

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import ngram_join as nj
from claimloom.llm._graph import components
from claimloom.llm._shared import table


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(i)
    links = 0
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want, links = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_groups(df).collect()}
    assert got == want
    return links


def test_shingles_are_those_of_the_rule():
    texts = [None, "", " \n", "A b", "a B", "a b c d", "a b c d e", "A b\tc\x0bd e f", "É a É a É a É a", "é a é a", "x " * 50, "a\x1cb c d e f", "a b c d e f g"]
    got = nj.shingle_sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b)), (a, b)


@pytest.mark.parametrize("seed", range(6))
def test_sets_that_link_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    pairs, sets = [], []
    for _ in range(250):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 31, 33, 50, 64, 90, 130, 260, 600]))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone, new = int(rng.integers(0, n // 9 + 2)), int(rng.integers(0, n // 4 + 2))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        both = n - gone
        if len(b) and 100 * both >= 80 * (n + len(b) - both):
            pairs.append((len(sets), len(sets) + 1))
        sets += [np.unique(a), np.unique(b)]
    sets = [s if len(s) else np.array([1], dtype=np.uint64) for s in sets]
    owner, sig = nj.signatures(sets)
    mine = [set(sig[owner == i].tolist()) for i in range(len(sets))]
    assert len(pairs) > 50
    assert all(mine[a] & mine[b] for a, b in pairs)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 1)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(500, i) for i in range(501, 560)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if i in {x for e in edges if e[0] != e[1] for x in e}}


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    common = " ".join(rng.choices(vocabulary, k=60))
    for size in (1, 4, 5, 7, 12, 30, 80, 200, 700):
        for _ in range(6):
            words = rng.choices(vocabulary, k=size)
            for copy in range(8):
                mine = list(words)
                for _ in range(rng.randrange(0, max(2, size // 40))):
                    mine[rng.randrange(len(mine))] = rng.choice(vocabulary)
                text = " ".join(mine) if copy % 3 else "  ".join(mine).upper()
                rows.append((at, text + (" " + common if copy == 7 else "")))
                at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "q " * 30000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    assert check(df) > 300


def test_whole_table(spark, sf):
    check(table(spark, sf.replace("0.001", "0.01"), "documents").select("doc_id", "text"))


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "A b c d e f"), (None, "z z"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in nj.ngram_groups(df).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9)], key=str)
    assert nj.ngram_groups(df.limit(0)).count() == 0


def test_copies_let_through_by_the_bitmap(spark, monkeypatch):
    """Chains of edits whose copies have ids that share slots of the bitmap with those of the originals."""
    monkeypatch.setattr(nj, "BLOOM_BITS", 15)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        words = rng.choices(vocabulary, k=80)
        for _ in range(25):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    ids = spark.range(200_000).selectExpr("id", "pmod(xxhash64(id), 32768) AS slot").toPandas()
    taken = set(ids.slot[: len(texts)])
    likely = ids[(ids.index >= len(texts)) & ids.slot.isin(taken)].id.tolist()
    rows = list(enumerate(texts)) + list(zip(likely, rng.sample(texts * 3, len(texts) * 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 2 * len(texts)
    assert check(df) > 500
    table = nj.set_table(df)
    wanted = table.groupBy("node").agg(nj.F.min("doc_id").alias("doc_id"))
    assert nj.sets_of(df, wanted).groupBy("node").count().filter("count > 1").count() == 0


def edited(rng, vocabulary, words, share):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [7, 4096])
def test_large_buckets_in_blocks(spark, block):
    """Many copies edited so far that some link with some others only."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(2):
        words = rng.choices(vocabulary, k=120)
        texts += [edited(rng, vocabulary, words, rng.choice([0.005, 0.02, 0.04])) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, links = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert links > 500 and 2 < len({c for _, c in want.values()}) < 200
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_groups(df, block=block).collect()}
    assert got == want


def test_sets_that_share_a_passage_alone_are_dropped(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(rng.choices([f"w{k}" for k in range(5000)], k=60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = nj.set_table(df).select("doc_id", "node", nj.F.col("n_shingles").alias("n"))
    lone = [r["lone"] for r in nj.lone_shingles(df, wanted).collect()]
    assert len(lone) == 300 and min(lone) >= 58
    assert check(df) == 0


def test_sets_that_run_out_of_splits(monkeypatch):
    monkeypatch.setattr(nj, "SPLITS", 1)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 20).astype(np.uint64)
    sets = [np.unique(a), np.unique(a[:18])]
    owner, sig = nj.signatures(sets * 20)
    assert set(sig[owner % 2 == 0].tolist()) & set(sig[owner % 2 == 1].tolist())


def test_a_doc_id_with_several_texts_is_one_node(spark):
    a, b = "a b c d e f", "q r s t u v"
    df = spark.createDataFrame([(1, a), (3, a), (3, b), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in nj.ngram_groups(df).collect()} == {1}


def test_lone_owners_by_hand_and_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    for n, kinds, many in ((0, 5, 1), (1, 5, 1), (400, 150, 9), (5000, 90_000, 300)):
        nodes, counts = rng.integers(-(1 << 60), 1 << 60, many).repeat(2), rng.multinomial(n, [1 / (2 * many)] * (2 * many)).astype("<u4")
        features = rng.integers(0, kinds, n).astype("<u4") * np.uint32(40_000)
        holders = {}
        for x, f in zip(np.repeat(nodes, counts).tolist(), features.tolist()):
            holders.setdefault(f, set()).add(x)
        assert sorted(nj.lone_owners(nodes, counts, features).tolist()) == sorted(x for s in holders.values() if len(s) == 1 for x in s)
    n = nj.SLICE
    nodes, counts, features = np.arange(n // 100), np.full(n // 100, 100, "<u4"), rng.integers(0, 1 << 31, n).astype("<u4")
    tracemalloc.start()
    nj.lone_owners(nodes, counts, features)
    assert tracemalloc.get_traced_memory()[1] < 30 * n  # owners, their order and both reordered take more than 40
    tracemalloc.stop()
    cut = pa.chunked_array([pa.array([b"\1\0\0\0", b"", b"\2\0\0\0\3\0\0\0"]).slice(1), pa.array([], pa.binary()), pa.array([b""]), pa.array([b"\4\0\0\0"])])
    assert nj.joined(cut, "<u4").tolist() == [2, 3, 4]
