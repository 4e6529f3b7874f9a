import hashlib

import numpy as np
import pytest

from claimloom.llm import centroid_clusters as cc
from claimloom.llm._shared import table
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dim, scale=256.0, seed="2:"):
    kept = [(i, [int(np.floor(scale * v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()
    cs = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for t in range(rounds + 1):
        at = [min(range(len(cs)), key=lambda j: (far(x, cs[j]), j)) for _, x in kept]
        if t < rounds:
            for j in range(len(cs)):
                own = [x for (_, x), a in zip(kept, at) if a == j]
                if own:
                    cs[j] = [sum(v) // len(own) for v in zip(*own)]
    out = [(i, j, far(x, cs[j])) for (i, x), j in zip(kept, at)]
    return sorted(((i, j, d, sum(e for _, g, e in out if g == j), sum(e for _, _, e in out), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def check(spark, rows, k, rounds, dim, **options):
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], SCHEMA)
    got = sorted((tuple(r) for r in cc.clusters(df, k=k, rounds=rounds, dim=dim, **options).collect()), key=str)
    assert got == brute(rows, k, rounds, dim)
    return got


@pytest.mark.parametrize("spread, k, group", [(0.02, 9, 2), (0.3, 12, 3), (1.0, 7, 8)])
def test_same_as_plain_rounds(spark, spread, k, group):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(6, 5))
    rows = [(i, (middle[i % 6] + spread * rng.normal(size=5)).tolist()) for i in range(300)]
    check(spark, rows, k, 6, 5, group=group)


def test_ties_copies_and_odd_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (None, [0.0, 1.0, 1.0])]
    rows = grid + odd + grid[:7] + [(200, [-0.001, -1000.5, 1000.25])]
    got = check(spark, rows, 10, 4, 3, group=3)
    assert len(got) == len(grid) + 10 and all(r[0] not in (100, 101, 102, 103, 104, 105) for r in got)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, -3.0])], 40, 3, 2)
    check(spark, [], 5, 2, 2)


def test_large_components_are_exact_or_refused(spark):
    check(spark, [(i, [float(2**19 - i), float(-(2**19) + 3 * i)]) for i in range(20)], 4, 3, 2)
    with pytest.raises(Exception, match="fits a long"):
        check(spark, [(1, [2.0**20, 0.0])], 4, 3, 2)


def test_a_centroid_that_comes_back_costs_nothing():
    """The total displacement counts, not the way: with it undone no distance is evaluated."""
    rng = np.random.default_rng(1)
    first = rng.integers(-500, 500, size=(12, 6))
    x = first[rng.integers(0, 12, 200)] + rng.integers(-3, 4, size=(200, 6))
    away = first + 400
    state = cc.Rounds([first], 4).begin(x)
    state = cc.Rounds([first, away, first], 4).step(x, state)
    assert state["evaluated"].tolist() == [12] * 200
    assert (cc.Rounds([first, away], 4).step(x, state)["evaluated"] > 12).any()


def test_bounds_spare_most_distances(spark, sf):
    found, history = cc.clustered(table(spark, sf.replace("0.001", "0.1"), "embeddings"))
    n, evaluated = found.count(), found.groupBy().sum("evaluated").first()[0]
    assert len(history) == 6 and evaluated < 0.8 * n * 40 * 6


def test_query(spark, sf):
    assert compare(spark, sf, lambda s, d: cc.clusters(table(s, d, "embeddings")), cc.oracle()) is None
