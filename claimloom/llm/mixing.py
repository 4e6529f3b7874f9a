"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words. The mix takes floor(target / size of the
source) complete epochs of it; of the rest, a fraction is selected: each document
draws an exponential key -ln(u) / w, w its quality weight and u a uniform number
hashed from its doc_id, so that reruns agree. Within the source documents are
taken in ascending order of the key as long as the middle of the document, in the
running sum of words, lies within the budget.

Keys are kept as their logarithms, which order alike. They cut a source into slices of the order, which are of about
even size whatever the weights are (``slice_of``). The running sum is of slices first,
then of documents within a slice: no task holds a source, however many rows it has.

Weights 1, 2, 3 are dealt in turn to the sources by code point, null last. All
targets together are the words of all documents; a target is cut at MOST times its
source's words and what is cut off is dealt to the others by weight until no
target is above. That is the same as one level common to all sources that aren't
cut: target = min(MOST * words, level * weight).

Defined results: a null or empty text, or one of white space, has size 0 and is
taken 0 times; a null doc_id draws the key of a fixed number; rows that repeat a
doc_id draw the same key and follow each other; a null source is one source; a
table without words has targets of 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._shared import WORD, text_of, written

MOST = 3
SLICES = 4096
SEED = 20240607


def words_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)).cast("long")


def quality_of(text: Column) -> Column:
    """The share of letters and white space among the characters, 0.05 at least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))


def uniform_of(doc_id: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1."""
    drawn = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") / float(1 << 52) + F.lit(0.5 / (1 << 52))


def targets_of(sizes: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target: one row a source.

    sizes: a row a source with source and source_size. This is the only step that
    sees all sources in one task; it holds a few numbers for each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(dealt, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    stepped = weighed.withColumn("step", level).withColumn("at", F.row_number().over(by_ratio))
    fits = F.when(F.col("step") * F.col("weight") <= F.col("cap"), F.struct("at", "step"))
    levelled = stepped.withColumn("level", F.min(fits).over(whole)["step"])
    return levelled.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def key_of(uniform: Column, weight: Column) -> Column:
    """The logarithm of the exponential key -ln(u) / w, which orders documents as the key does.

    It neither underflows nor ties, whatever the weight is; weights below 1e-6 count as 1e-6."""
    return F.log(-F.log(uniform)) - F.log(F.greatest(weight, F.lit(1e-6)))


def slice_of(key: Column, slices: int) -> Column:
    """The slice of a key, larger for smaller keys; at most 15 / slices of a source are expected in one.

    For one weight the logarithm of an exponential variable is spread with a density of 1 / e at
    most: slices of equal width in it, which cover 40 units, are of about even size in the middle,
    and those at the ends hold next to nothing for weights from 1e-6 to 1e6."""
    inside = F.floor((F.lit(20.0) - key) / 40.0 * slices).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(slices - 1), inside))


def mixed(
    docs: DataFrame, quality: Column | None = None, weights=(1, 2, 3), most: int = MOST, seed: int = SEED,
    slices: int = SLICES, carry: str | None = None,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies for every row of docs.

    quality: a positive column of docs that scales a document's chance.
    carry: the name of one more column, a struct of the row as it came in; it is
    joined to the decision by doc_id, source and a hash of the text, and rows alike in these take the least of theirs."""
    weight = quality_of(text_of()) if quality is None else quality
    read = docs.select(
        *([F.struct("*").alias(carry), F.xxhash64(text_of()).alias("mark")] if carry else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words_of(text_of()).alias("size"),
        key_of(uniform_of(F.col("doc_id"), seed), weight).alias("key"),
    ).withColumn("slice", slice_of(F.col("key"), slices))
    plain = written(read.drop(carry) if carry else read, "mixing-sizes")

    held = plain.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    held = written(held, "mixing-slices")
    goals = targets_of(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        held.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .alias("h")
        .join(goals.alias("g"), F.expr("h.source <=> g.source"))
        .select("h.source", "h.slice", "start", "source_size", "target")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    placed = plain.alias("p").join(starts.alias("s"), F.expr("p.slice = s.slice AND p.source <=> s.source"))
    placed = placed.select("p.*", "start", "source_size", "target", "epochs", "budget")
    running = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(running) - F.col("size") / 2
    taken = placed.withColumn(
        "copies", F.when(F.col("size") > 0, F.col("epochs") + F.when(middle <= F.col("budget"), 1).otherwise(0)).otherwise(0).cast("long")
    ).withColumn("taken", F.col("copies") * F.col("size"))
    columns = ("doc_id", "source", "size", "source_size", "target", "taken", "copies")
    if not carry:
        return taken.select(*columns)
    keys = ("doc_id", "source", "mark")
    rest = [F.min(c).alias(c) for c in columns if c not in keys]
    decided = taken.groupBy(*keys).agg(*rest)
    same = " AND ".join(f"l.{k} <=> r.{k}" for k in keys)
    # of the rows as they came in nothing is computed again but the hash
    return read.select(carry, *keys).alias("l").join(decided.alias("r"), F.expr(same)).select(f"l.{carry}", *[f"r.{c}" for c in columns])


def oracle(weights=(1, 2, 3), most: int = MOST, seed: int = SEED) -> str:
    dealt = ", ".join(f"{w}.0" for w in weights)
    return rf"""
WITH RECURSIVE read AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
plain AS (
  SELECT doc_id, source, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS size,
    ln(-ln(('0x' || substr(md5('{seed}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / {float(1 << 52)!r} + {0.5 / (1 << 52)!r}))
      - ln(greatest(0.05, length(regexp_replace(body, '[^\p{{L}}\x20\x09-\x0D]+', '', 'g')) / greatest(length(body), 1)::DOUBLE)) AS key
  FROM read),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([{dealt}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight
  FROM plain GROUP BY source),
shared(round, source, source_size, weight, target, capped) AS (
  SELECT 0, source, source_size, weight,
    (sum(source_size) OVER ()) * weight / sum(weight) OVER (), false FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    CASE WHEN target >= {most} * source_size THEN {most} * source_size ELSE
      ((sum(source_size) OVER ()) - sum(CASE WHEN target >= {most} * source_size THEN {most} * source_size ELSE 0 END) OVER ())
      * weight / sum(CASE WHEN target >= {most} * source_size THEN 0 ELSE weight END) OVER () END, false
  FROM shared WHERE round < 64),
goals AS (SELECT source, source_size, target FROM shared WHERE round = 64),
placed AS (
  SELECT p.*, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY p.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM plain p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source, source_size, target,
  CAST(size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
FROM placed
"""
