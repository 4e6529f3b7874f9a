import hashlib

import pytest
from pyspark.sql import functions as F

from claimloom.llm import exact_dedup as ed
from claimloom.llm._shared import table
from tests.oracle import compare

ROWS = [
    (1, "a b"), (2, "ab "), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "ab\xa0"), (8, "é b" * 20000), (9, "éb" * 20000),
    (None, "x"), (10, "x"), (None, "only null"), (11, "dup"), (11, "dup"), (12, "d u p"), (13, "AB"),
]


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), float("inf") if i is None else i, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: x[:2])
        out.append((i, best[2], len(g), i == best[2] and len(t or "") == -best[0], hashlib.sha256(norm(t).encode()).hexdigest(), 1))
    return sorted(out, key=str)


def test_edges(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, key string").repartition(3)
    for capacity in (1, 4096):
        assert sorted((tuple(r) for r in ed.exact_dedup(df, capacity).collect()), key=str) == brute(ROWS)
    assert ed.exact_dedup(df.limit(0)).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("key"))
    rows = ed.directory_of(keys, 50).collect()
    assert len({r["slot"] for r in rows}) == len(rows)
    held = {}
    for r in keys.collect():
        slot = r["key"] >> (ed.KEY_BITS - ed.SLOT_BITS)
        bucket = next(x for x in rows if x["slot"] == slot)
        assert bucket["bucket"] <= slot < bucket["bucket"] + (1 << (ed.SLOT_BITS - bucket["depth"]))
        held[bucket["bucket"]] = held.get(bucket["bucket"], 0) + 1
    assert max(held.values()) <= 50
    one = ed.directory_of(spark.range(100).select((F.col("id") + 7).alias("key")), 50).collect()
    assert [r["depth"] for r in one] == [ed.SLOT_BITS]  # one slot can't be split: stays overfull
    assert [r["depth"] for r in ed.directory_of(spark.range(100).select(F.lit(7).cast("long").alias("key")), 50).collect()] == [0]


@pytest.mark.parametrize("bits", [0, 3])
def test_colliding_keys_are_told_apart_in_their_chain(spark, bits):
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = ed.exact_dedup(df, capacity=4, key_bits=bits).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == [r[:5] for r in brute(rows)]
    places = {r["text_sha256"]: r["chain"] for r in found}
    assert len(places) == 40 and max(places.values()) == (40 if bits == 0 else max(places.values())) and max(places.values()) > 4
    assert sorted((tuple(r) for r in ed.exact_dedup(df, capacity=4, key_bits=bits).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_texts_forgotten_by_the_fold_meet_in_the_index(spark, monkeypatch):
    monkeypatch.setattr(ed, "FOLD_BYTES", 0)
    df = spark.createDataFrame([(i, "a" if i % 3 else f"b{i}") for i in range(60)], "doc_id long, text string").coalesce(2)
    rows = ed.folded(df)
    assert rows.filter("body IS NOT NULL").count() > rows.filter("body IS NOT NULL").select("body").distinct().count()
    assert {(r["keep_id"], r["group_size"]) for r in ed.exact_dedup(df).filter("text_sha256 = sha2('a', 256)").collect()} == {(1, 40)}


def test_query(spark, sf):
    assert compare(spark, sf, lambda s, d: ed.exact_dedup(table(s, d, "documents")), ed.ORACLE) is None
