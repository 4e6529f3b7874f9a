import numpy as np
import pytest

from claimloom.llm import embedding_join as ej
from claimloom.llm._shared import table


def brute(rows, cosine=0.98):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            good[i] = (label, len(x), x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    ids = sorted(good)
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i in links}
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if good[i][:2] == good[j][:2] and good[i][2] @ good[j][2] >= cosine:
                links[i] += 1
                links[j] += 1
                ri, rj = root[i], root[j]
                root = {k: min(ri, rj) if r in (ri, rj) else r for k, r in root.items()}
    return {i: (links[i], root[i], root[i] == i) for i in links}


def check(df, cosine=0.98, **kw):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: tuple(r)[1:] for r in ej.near_vectors(df, cosine, **kw).collect()}
    assert got == brute(rows, cosine)
    return got


@pytest.mark.parametrize("block, cosine", [(5, 0.2), (256, 0.98)])
def test_whole_table(spark, sf, block, cosine):
    got = check(table(spark, sf, "embeddings"), cosine, block=block)
    assert cosine > 0.9 or any(n for n, _, _ in got.values())


def test_groups_labels_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=8)
            for scale in rng.uniform(0, 0.12, 9):
                rows.append((at, (centre + scale * rng.normal(size=8)).tolist(), label, 1.0))
                at += 1
    bad = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(at + i, v, 0, 1.0) for i, v in enumerate(bad)]
    rows += [(900, rows[0][1], None, 1.0), (901, [2 * x for x in rows[0][1]], 0, 1.0), (902, [1e200] * 8, 0, 1.0), (903, [1e-200] * 8, 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, vector double").repartition(3)
    got = check(df, block=7, fit_rows=20)
    assert got[902][0] == 1 and got[900] == (0, 900, True)


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3)] * 2 + [(2, [1.0, 0.001], 3), (None, [1.0, 0.0], 3)], "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in ej.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (None, 0, None, True)], key=str)
    assert ej.near_vectors(df.limit(0)).count() == 0


def test_many_equal_vectors_stay_one(spark):
    """50,000 copies, and as many close ones of another: rows between the steps grow with the vectors."""
    n = 50_000
    copies = spark.range(n).selectExpr("id AS vec_id", "array(1D, 0.5D, 0.25D) AS embedding", "'x' AS label")
    other = spark.range(n, n + 5_000).selectExpr("id AS vec_id", "array(0D, 1D, 1e-7D * id) AS embedding", "'x' AS label")
    df = copies.unionByName(other)
    clean = ej.clean_vectors(df)
    classes = ej.classes_of(clean)
    assert classes.count() == 5_001
    blocks = ej.grid_ordered(classes, 0.98)
    pairs = ej.near_blocks(blocks, 0.98)
    assert ej.block_links(pairs, blocks, 0.98).count() < 20 * 5_001
    got = ej.near_vectors(df).groupBy("component_id", "n_links").count().collect()
    assert sorted(map(tuple, got)) == [(0, n - 1, n), (n, 4_999, 5_000)]


def test_blocks_are_found_from_one_interval(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), "a" if i % 3 else "b") for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(6)
    check(df, 0.9, block=3)
