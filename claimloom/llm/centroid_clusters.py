"""Centroid clustering with ns-bounds.

Components are integers, so every distance is an exact squared one and ties are real ties.
The driver keeps the centroids of every round, ``history``: a few kilobytes a round. Centroids
are dealt to groups of GROUP by number. A vector's row stores the distance to its own
centroid and, for each group, the least distance to another centroid of it, both as they were
when last evaluated, with the number of that round.

A round loosens a stored distance by the norm of the total displacement since its round,
||c(now) - c(then)||, read off the history (for a group the largest of its centroids'); the
drifts of the rounds between aren't added up, so a centroid that comes back costs nothing.
Where all groups stay beyond the own centroid nothing is evaluated. Else the own distance is
evaluated, and those groups that may still hold a nearer or equally near centroid are scanned
exactly, all their centroids. Bounds are floating point, with SLACK in favour of a scan; what
decides is the integer distance, then the smaller number.

Sums are integers, and kept up to date from the rows whose cluster changed: partial sums by
batch, then k rows for the driver. Each round's rows are written to the shared folder.

Defined results: vectors of another length than ``dim`` and null vectors or such with a null, NaN
or infinite component are left out; a scaled component beyond +-2^27 stops the job with an
error, as squared distances wouldn't fit their column; with fewer kept vectors than k there
are as many centroids as vectors; equal vectors, repeated rows and null vec_ids each give a row
(a null vec_id hashes as an empty one, and rows of one vec_id start as centroids in the
order of their components); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._shared import written

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256.0
SEED = "2:"
GROUP = 4
SLACK = 1e-6
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, before int, own long, own_round int, low array<long>, low_round array<int>, evaluated long"
NONE = -1  # a group without another centroid


def integers(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """vec_id, x: the kept vectors, scaled, as integers."""
    value = lambda v: v.cast("double")
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(value(v)) | (F.abs(value(v)) == float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~odd)
    too_large = F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g} has no distance that fits a long"))
    whole = lambda v: F.when(F.abs(value(v) * scale) > LARGEST, too_large).otherwise(F.floor(value(v) * scale).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("x", drawn.alias("drawn")).orderBy("drawn", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= 1 << 22:  # sums below 2^53
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Rounds:
    """The centroids of all rounds so far, and what follows from them for stored bounds."""

    def __init__(self, history: list[np.ndarray], group: int = GROUP):
        self.history = history
        self.now = history[-1]
        self.groups = [np.arange(a, min(a + group, len(self.now))) for a in range(0, len(self.now), group)]
        self.group_of = np.arange(len(self.now)) // group
        #: by round and centroid, by round and group
        self.moved = np.array([np.sqrt(((self.now - then).astype(np.float64) ** 2).sum(axis=1)) for then in history])
        self.group_moved = np.array([[row[g].max() for g in self.groups] for row in self.moved])

    def least_others(self, distances: np.ndarray, members: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        others = np.where(members[None, :] == cluster[:, None], np.iinfo(np.int64).max, distances)
        least = others.min(axis=1)
        return np.where(least == np.iinfo(np.int64).max, NONE, least)

    def begin(self, x: np.ndarray) -> dict[str, np.ndarray]:
        distances = squared(x, self.now)
        cluster = distances.argmin(axis=1)
        n = len(x)
        low = np.stack([self.least_others(distances[:, g], g, cluster) for g in self.groups], axis=1)
        return {
            "cluster": cluster, "before": np.full(n, -1), "own": distances[np.arange(n), cluster], "own_round": np.zeros(n, int),
            "low": low, "low_round": np.zeros_like(low), "evaluated": np.full(n, len(self.now)),
        }

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.now[cluster]) ** 2).sum(axis=1)

    def doubtful(self, s: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Rows by groups: may a centroid of the group be as near as the own one?"""
        upper = np.sqrt(s["own"][rows]) + self.moved[s["own_round"][rows], s["cluster"][rows]]
        low, since = s["low"][rows], s["low_round"][rows]
        beyond = np.sqrt(np.maximum(low, 0)) - self.group_moved[since, np.arange(len(self.groups))[None, :]]
        return (low != NONE) & (beyond <= upper[:, None] + SLACK * (1 + np.sqrt(np.maximum(low, 0)) + upper[:, None]))

    def step(self, x: np.ndarray, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The rows' state after this round's assignment; s isn't used afterwards."""
        t = len(self.history) - 1
        s["before"] = s["cluster"].copy()
        rows = np.flatnonzero(self.doubtful(s, np.arange(len(x))).any(axis=1))
        s["own"][rows], s["own_round"][rows] = self.own_distance(x[rows], s["cluster"][rows]), t
        s["evaluated"][rows] += 1
        doubt = self.doubtful(s, rows)
        best, best_at = s["own"][rows].copy(), s["cluster"][rows].copy()
        scanned: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g, members in enumerate(self.groups):
            at = np.flatnonzero(doubt[:, g])
            found = squared(x[rows[at]], self.now[members])
            scanned[g] = at, found
            s["evaluated"][rows[at]] += len(members)
            place = found.argmin(axis=1)
            least, number = found[np.arange(len(at)), place], members[place]
            better = (least < best[at]) | ((least == best[at]) & (number < best_at[at]))
            best[at[better]], best_at[at[better]] = least[better], number[better]
        left = self.group_of[s["cluster"][rows]]
        moved = best_at != s["cluster"][rows]
        s["cluster"][rows], s["own"][rows] = best_at, best
        for g, members in enumerate(self.groups):
            at, found = scanned[g]
            # a group that a vector leaves has one more of the others
            also = np.flatnonzero(moved & (left == g) & ~doubt[:, g])
            s["evaluated"][rows[also]] += len(members)
            for where, distances in ((at, found), (also, squared(x[rows[also]], self.now[members]))):
                s["low"][rows[where], g] = self.least_others(distances, members, best_at[where])
                s["low_round"][rows[where], g] = t
        return s


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, n: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind)


def assigned(rows: DataFrame, rounds: Rounds) -> DataFrame:
    """STATE of every row after the assignment to the newest centroids; rows: vec_id, x, or an earlier STATE."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), n)
            if "own" in batch.schema.names:
                flat = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "own", "own_round", "evaluated")}
                s = rounds.step(x, flat | {c: _matrix(batch.column(c), n) for c in ("low", "low_round")})
            else:
                s = rounds.begin(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("x"), pa.array(s["cluster"], pa.int32()), pa.array(s["before"], pa.int32()), pa.array(s["own"], pa.int64()),
                    pa.array(s["own_round"], pa.int32()), _lists(s["low"], pa.int64()), _lists(s["low_round"], pa.int32()), pa.array(s["evaluated"], pa.int64()),
                ],
                names=["vec_id", "x", "cluster", "before", "own", "own_round", "low", "low_round", "evaluated"],
            )

    return rows.mapInArrow(step, STATE)


def changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """By cluster, what the rows that changed add to the number of vectors and to their sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, sums, counts = _matrix(batch.column("x"), n), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            for column, sign in (("cluster", 1), ("before", -1)):
                number = batch.column(column).to_numpy()
                for j in np.unique(number[number >= 0]).tolist():
                    own = x[number == j]
                    sums[j] += sign * own.sum(axis=0)
                    counts[j] += sign * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), _lists(sums, pa.int64())], names=["cluster", "n", "sums"])

    moved = state.filter("cluster != before").select("x", "cluster", "before").mapInArrow(partial, "cluster int, n long, sums array<long>")
    totals = moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for r in totals.collect():
        counts[r["cluster"]], sums[r["cluster"]] = r["n"], r["sums"]
    return counts, sums


def clustered(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: str = SEED, group: int = GROUP
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, cluster, evaluated (the distances evaluated for it), distance of each vector, and the centroids of all rounds."""
    rows = written(integers(vectors, dim, scale), "clusters-vectors")
    history = [first_centroids(rows, k, seed)]
    if not len(history[0]):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS evaluated", "0L AS distance"), history
    counts, sums = np.zeros(len(history[0]), np.int64), np.zeros(history[0].shape, np.int64)
    state = rows
    for _ in range(rounds):
        state = written(assigned(state, Rounds(history, group)), "clusters-state")
        more, added = changes(state, *history[0].shape)
        counts, sums = counts + more, sums + added
        means = sums // np.maximum(counts, 1)[:, None]
        history = [*history, np.where((counts > 0)[:, None], means, history[-1])]
    last = Rounds(history, group)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = last.own_distance(_matrix(batch.column("x"), batch.num_rows), batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "cluster", "evaluated")], pa.array(own, pa.int64())], names=["vec_id", "cluster", "evaluated", "distance"])

    done = assigned(state, last).mapInArrow(final, "vec_id long, cluster int, evaluated long, distance long")
    return written(done, "clusters-final"), history


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector."""
    found, history = clustered(vectors, **options)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(sums.values())
    told = [
        (j, sums.get(j, 0), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1].tolist())
    ]
    centroids = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(centroids), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: str = SEED) -> str:
    """The plain rounds, every vector against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale!r} * x::DOUBLE)) AS x
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY drawn, x) - 1 AS cluster, x AS c
  FROM (SELECT x, sha256('{seed}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS drawn FROM kept ORDER BY drawn, x LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT row, vec_id, x, cluster, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS place FROM (
      SELECT kept.*, cluster, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS distance FROM kept, c{t}))
  WHERE place = 1)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(mean, c) AS c FROM c{t} LEFT JOIN (
    SELECT cluster, list(component ORDER BY i) AS mean FROM (
      SELECT cluster, i, floor(sum(x[i]) / count(*)) AS component FROM a{t}, range(1, {dim + 1}) AS places(i) GROUP BY cluster, i)
    GROUP BY cluster) USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
