"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors a and b have cosine >= c where their distance is at most
epsilon = sqrt(2 - 2c), and a projection on orthonormal directions brings none
further apart. The join runs within a label (and a length of vectors). Equal vectors of
a label are one from the start, with the number of their copies:

1. the leading DIRECTIONS principal directions come from a bounded sample of about
   FIT_ROWS vectors;
2. vectors are sorted by their cells, epsilon wide, on these directions, in range
   partitions: the epsilon grid order. Runs of BLOCK vectors of a partition are
   blocks, with the box of their projections;
3. intervals of the sequence are joined recursively: first the whole sequence with
   itself, then ever shorter runs of blocks, down to blocks. Pairs of intervals whose
   boxes are further apart than epsilon are skipped with all that is in them;
4. the blocks of the pairs that remain are multiplied as matrices in double
   precision. A pair of blocks yields a count of links for each vector and the
   edges of a spanning forest, not the links themselves, so that a group of
   near copies costs rows in proportion to its size.

No vector is left out of the order or of a join, and boxes are exact, so all links
are found. The largest thing a task holds is its share of pairs of blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, or has a null label or vec_id, has 0 links and is its own component;
rows that repeat vec_id, label and vector count as one vector and each give a row;
a vec_id with several vectors has the links of each, those to its own others included;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._graph import components
from claimloom.llm._shared import written

COSINE = 0.98
DIRECTIONS = 4
FIT_ROWS = 4_096
BLOCK = 256
FAN_BITS = 3
SLACK = 1e-9


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, vector (its components as doubles) of the rows that can link."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, x in enumerate(batch.column("embedding").to_pylist()):
                v = np.array([np.nan if y is None else y for y in x], dtype=np.float64) if x else np.zeros(0)
                if len(v) and np.isfinite(v).all() and v.any():
                    kept.append(i)
                    rows.append(v)
            some = batch.select(["vec_id", "label"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array([len(v) for v in rows], pa.int32()), pa.array([v.tobytes() for v in rows], pa.binary())],
                names=["vec_id", "label", "dim", "vector"],
            )

    read = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    found = read.mapInArrow(checked, "vec_id long, label string, dim int, vector binary")
    return found.dropDuplicates(["vec_id", "label", "dim", "vector"])


def classes_of(clean: DataFrame) -> DataFrame:
    """vec_id (the smallest), label, dim, vector, copies: a row for all equal vectors of a label.

    Copies are summed up where they are read, before anything is shuffled."""
    return clean.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


def unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def directions(clean: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the mean and the leading directions, columns, of a sample."""
    sizes = clean.groupBy("dim").count().collect()
    found = {}
    for row in sizes:
        dim, n = row["dim"], row["count"]
        drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1e6 * fit_rows / n
        sample = [r["vector"] for r in clean.filter((F.col("dim") == dim) & drawn).select("vector").toLocalIterator()]
        rows = unit(np.frombuffer(b"".join(sample)).reshape(-1, dim)) if sample else np.zeros((1, dim))
        mean = rows.mean(axis=0)
        _, _, axes = np.linalg.svd(rows - mean, full_matrices=False)
        found[dim] = mean, axes[:DIRECTIONS].T
    return found


def grid_ordered(clean: DataFrame, cosine: float, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """label, dim, part, seq, ids, copies, matrix, low, high: the blocks of the epsilon grid order."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) or 1e-9
    basis = clean.sparkSession.sparkContext.broadcast(directions(clean, fit_rows))

    def project(dim: int, vectors: list[bytes]) -> np.ndarray:
        mean, axes = basis.value[dim]
        out = np.zeros((len(vectors), DIRECTIONS))
        out[:, : axes.shape[1]] = (unit(np.frombuffer(b"".join(vectors)).reshape(-1, dim)) - mean) @ axes
        return out

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
            cells = np.zeros((len(dims), DIRECTIONS), dtype=np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cells[at] = np.floor(project(dim, [vectors[i] for i in at]) / epsilon)
            columns = [pa.array(cells[:, k]) for k in range(DIRECTIONS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, key = TaskContext.get().partitionId(), 0, [], None

        def made(seq: int) -> pa.RecordBatch:
            at = project(key[1], [v for _, _, v in held])
            values = [[key[0]], [key[1]], [part], [seq], [[i for i, _, _ in held]], [[n for _, n, _ in held]], [b"".join(v for _, _, v in held)]]
            values += [[at.min(axis=0).tolist()], [at.max(axis=0).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape)], schema=shape)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("label", "dim", "vec_id", "copies", "vector"))
            for label, dim, vec_id, copies, vector in zip(*columns):
                if held and (key != (label, dim) or len(held) == block):
                    yield made(seq)
                    held, seq = [], seq + 1
                key = label, dim
                held.append((vec_id, copies, vector))
        if held:
            yield made(seq)

    names = [f"c{k}" for k in range(DIRECTIONS)]
    shape = pa.schema(
        [("label", pa.string()), ("dim", pa.int32()), ("part", pa.int32()), ("seq", pa.int32())]
        + [("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("matrix", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
    )
    clean = clean.select("vec_id", "label", "dim", "vector", "copies")
    fields = "vec_id long, label string, dim int, vector binary, copies long, " + ", ".join(f"{c} int" for c in names)
    order = ["label", "dim", *names, "vec_id"]
    # written first: else the sampling of the ranges would compute it once more
    ordered = written(clean.mapInArrow(celled, fields), "grid-cells").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(cut, "label string, dim int, part int, seq int, ids array<long>, copies array<long>, matrix binary, low array<double>, high array<double>")
    return numbered(written(blocks, "grid-blocks"))


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with run, their number in the sequence; the window is over a row a partition."""
    sizes = blocks.groupBy("part").agg((F.max("seq") + 1).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(sizes.select("part", before.alias("before")), "part").withColumn("run", F.col("before") + F.col("seq")).drop("before")


def near_blocks(blocks: DataFrame, cosine: float) -> DataFrame:
    """label, dim, runa, runb: pairs of blocks, each once, whose boxes are within epsilon."""
    boxes = written(blocks.select("label", "dim", "run", "low", "high"), "grid-boxes")
    deepest = boxes.agg(F.max("run")).first()[0] or 0
    shift = FAN_BITS * (-(-int(deepest).bit_length() // FAN_BITS))
    reach = (2 - 2 * cosine) * (1 + SLACK) + SLACK

    def side(shift: int, s: str) -> DataFrame:
        """The intervals of 2^shift blocks, with their boxes."""
        lows = [F.min(F.col("low")[k]).alias(f"l{k}{s}") for k in range(DIRECTIONS)]
        highs = [F.max(F.col("high")[k]).alias(f"h{k}{s}") for k in range(DIRECTIONS)]
        run = F.shiftright("run", shift).alias(f"run{s}")
        return boxes.groupBy("label", "dim", run).agg(*lows, *highs).withColumn(f"up{s}", F.shiftright(f"run{s}", FAN_BITS))

    gap = " + ".join(f"pow(greatest(0D, l{k}a - h{k}b, l{k}b - h{k}a), 2)" for k in range(DIRECTIONS))
    close = F.expr(f"({gap}) <= {reach!r}D AND runa <= runb")
    keys = ["label", "dim"]
    # the whole sequence of each label with itself
    pairs = boxes.select(*keys, F.lit(0).cast("long").alias("runa"), F.lit(0).cast("long").alias("runb")).distinct()
    while shift > 0:
        shift -= FAN_BITS
        up = pairs.withColumnsRenamed({"runa": "upa", "runb": "upb"})
        met = up.join(side(shift, "a"), [*keys, "upa"]).join(side(shift, "b"), [*keys, "upb"])
        pairs = written(met.filter(close).select(*keys, "runa", "runb"), "grid-pairs")
    return pairs


def block_links(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, root: for the vectors of each pair of blocks that link in it."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ia, ib, ca, cb = (np.array(r[c]) for c in ("idsa", "idsb", "copiesa", "copiesb"))
                a, b = (unit(np.frombuffer(r[f"matrix{s}"]).reshape(-1, r["dim"])) for s in "ab")
                linked = a @ b.T >= cosine
                same = r["same"]
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                # the smallest id of each part that hangs together
                ra, rb = ia.copy(), ib.copy()
                big = np.iinfo(np.int64).max
                while True:
                    na = np.minimum(ra, np.where(linked, rb[None, :], big).min(axis=1))
                    nb = np.minimum(rb, np.where(linked, na[:, None], big).min(axis=0))
                    if same:
                        na = nb = np.minimum(na, nb)
                    if (na == ra).all() and (nb == rb).all():
                        break
                    ra, rb = na, nb
                sides = [(ia, linked @ cb, ra)] + ([] if same else [(ib, ca @ linked, rb)])
                ids, counts, roots = (np.concatenate(x) for x in zip(*sides))
                kept = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[kept].astype(np.int64)) for x in (ids, counts, roots)], names=["vec_id", "n_links", "root"]
                )

    keys = ["label", "dim"]
    own = lambda s: blocks.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in ("run", "ids", "copies", "matrix")])
    both = pairs.join(own("a"), [*keys, "runa"]).join(own("b"), [*keys, "runb"])
    both = both.select("dim", (F.col("runa") == F.col("runb")).alias("same"), "idsa", "copiesa", "matrixa", "idsb", "copiesb", "matrixb")
    return both.mapInArrow(multiplied, "vec_id long, n_links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    clean = written(clean_vectors(vectors), "vectors")
    classes = written(classes_of(clean), "vector-classes")
    blocks = grid_ordered(classes, cosine, block, fit_rows)
    found = written(block_links(near_blocks(blocks, cosine), blocks, cosine), "vector-links")
    # the links of a class to others, then of each vector: to its copies besides
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("others"))
    keys = ["label", "dim", "vector"]
    owned = classes.select(*keys, F.col("vec_id").alias("rep"), "copies").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
    mine = clean.join(owned, keys).select("vec_id", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    mine = written(mine, "vector-counts")
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(mine.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    linked = mine.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).join(components(edges).withColumnRenamed("id", "vec_id"), "vec_id", "left")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN links ON a = root),
found AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id,
  coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN found ON id = vec_id
"""
