import pytest
from pyspark.sql import functions as F

from claimloom.llm import mixing
from claimloom.llm._shared import table
from tests.oracle import compare


def targets(sizes, weights=(1, 2, 3), most=3):
    """By rounds: what is cut off is shared by weight among those that aren't cut."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        cut = {s for s in free if level * w[s] >= most * sizes[s]}
        for s in cut:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= cut
        if not cut:
            return out | {s: level * w[s] for s in free}
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 100, None: 5}, {"a": 0, "b": 0}, {"a": 6, "b": 1, "c": 1, "d": 500, "e": 2, "f": 7, "g": 7}, {"b": 5, "B": 5, "é": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets_of(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_no_sources(spark):
    assert mixing.targets_of(spark.createDataFrame([], "source string, source_size long")).count() == 0


def rows(spark):
    data = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}") for i in range(600)] + [(600 + i, "w " * 30, "s9") for i in range(20)]
    data += [(700, None, "s1"), (701, "", "s2"), (702, " \n", None), (703, "one two", None), (None, "a b c", "s0"), (5, "w " * 36, "s2"), (5, "w " * 36, "s2"), (800, "w " * 20000, "s0")]
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_mix_meets_its_targets_and_reruns_agree(spark):
    df = rows(spark)
    first, again = (sorted(map(tuple, mixing.mixed(x).collect()), key=str) for x in (df, df.repartition(5)))
    assert first == again and len(first) == df.count()
    got = mixing.mixed(df).collect()
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert max(r["copies"] for r in own if r["size"]) - min(r["copies"] for r in own if r["size"]) <= 1 or own[0]["source_size"] == 0


def test_slices_change_nothing(spark):
    df = rows(spark)
    runs = [sorted(map(tuple, mixing.mixed(df, slices=n).collect()), key=str) for n in (1, 7, 4096)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("weight", [1e-6, 1e-4, 0.05, 1.0, 50.0, 1e6])
def test_slices_are_even_whatever_the_weights(spark, weight):
    key = mixing.key_of(mixing.uniform_of(F.col("id")), F.lit(weight))
    rows = spark.range(100_000).select(mixing.slice_of(key, 400).alias("slice"), key.alias("key"))
    by = rows.groupBy("slice").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("slice").collect()
    assert max(r["n"] for r in by) < 1.2 * 100_000 * 15 / 400
    assert all(r["n"] == r["keys"] for r in by)
    assert all(a["low"] > b["high"] for a, b in zip(by, by[1:]))


def test_quality_raises_the_chance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mixed(df, quality=F.when(F.col("doc_id") % 8 == 1, 8.0).otherwise(1.0), weights=(3, 1)).filter("source = 'b'")
    share = {r["good"]: r["x"] for r in got.groupBy((F.col("doc_id") % 8 == 1).alias("good")).agg(F.avg("copies").alias("x")).collect()}
    assert share[True] > 1.5 * share[False] > 0


def test_carried_rows(spark):
    df = rows(spark)
    plain = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mixed(df.filter("doc_id != 5")).collect() if r["doc_id"] is not None)
    held = mixing.mixed(df.filter("doc_id != 5"), carry="row").select("row.*", F.col("taken"), F.length("row.text").alias("n")).collect()
    assert sorted((r["doc_id"], len((r["text"] or "").split()), r["taken"]) for r in held if r["doc_id"] is not None) == plain


def test_query(spark, sf):
    assert compare(spark, sf, lambda s, d: mixing.mixed(table(s, d, "documents")), mixing.oracle()) is None
    assert mixing.mixed(rows(spark).limit(0)).count() == 0
