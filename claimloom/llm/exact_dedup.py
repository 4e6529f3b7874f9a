"""Exact deduplication by an extendible-hash index on shared files.

A text's normal form is the text without ASCII white space; the pseudo-key of a
normal form is the leading KEY_BITS bits of its SHA-256.

1. Fold. The tasks that read documents give each normal form that they meet a number,
   and write a row a document with that number; the normal form itself goes into the
   first of these rows alone. They compare bytes, and hold FOLD_BYTES of them at most,
   so a text that a third of all rows hold goes on as a few rows a task.
2. Directory. From a histogram of the distinct pseudo-keys' leading bits the directory
   is doubled, bit by bit, and each bucket that holds more than its capacity is split,
   until none is overfull. A bucket is a range of pseudo-keys. What is broadcast are the
   directory's pointers, one for each value of as many leading bits as the deepest bucket
   has: at most 2^SLOT_BITS. Buckets that would need more bits stay overfull, and work as
   well.
3. Owners. Each normal form is sent to the owner task of its bucket, where those of one
   pseudo-key, in the order of keys, form a chain: it is compared, byte by byte, with the
   chain's members and either is one of them or becomes the next. The owners write the
   index to the shared folder: the number of each folded text, with bucket, depth,
   pseudo-key and place in the chain. A task holds the chain of one pseudo-key.
4. Decisions. The rows of a number are summed up first, then those of a place in a
   chain, and every document gets the result by its number.

Defined results: a null text counts as empty; empty texts are equal to
each other and to texts of white space alone; ties on length go to the smaller
doc_id, and a null doc_id loses to any other; rows that repeat a doc_id each
give a row; an empty table gives no rows; other columns aren't read, but by ``kept_rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._shared import text_of, written
from claimloom.llm.byte_bpe import small

KEY_BITS = 60
SLOT_BITS = 18  # the histogram's grain, and the deepest the directory gets
CAPACITY = 4096
FOLD_BYTES = 32 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def folded(docs: DataFrame, key_bits: int = KEY_BITS, carry: str | None = None) -> DataFrame:
    """A row a document: number, fold (the number of its normal form), doc_id, n_chars, and in
    the fold's first row body (the normal form), key and text_sha256, else null.

    carry: the name of one more column, a struct of the row as it came in, instead of body."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        known: dict[bytes, int] = {}
        at = held = row = 0
        for batch in small(batches):
            folds, bodies = [], []
            for text in batch.column("text").to_pylist():
                body = text.translate(None, SPACES)
                number = known.get(body)
                if number is None:
                    if held > FOLD_BYTES:
                        known.clear()
                        held = 0
                    number = known[body] = first + at
                    at += 1
                    held += len(body) + 100
                    bodies.append(body)
                else:
                    bodies.append(None)
                folds.append(number)
            numbers = np.arange(first + row, first + row + len(folds))
            row += len(folds)
            digests = [None if b is None else hashlib.sha256(b).digest() for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    pa.array(numbers),
                    pa.array(folds, pa.int64()),
                    pa.array([None if d is None else int.from_bytes(d[:8], "big") >> (64 - key_bits) << (KEY_BITS - key_bits) for d in digests], pa.int64()),
                    pa.array([None if d is None else d.hex() for d in digests], pa.string()),
                    *([] if carry else [pa.array(bodies, pa.binary())]),
                ],
                names=[*kept, "number", "fold", "key", "text_sha256", *([] if carry else ["body"])],
            )

    row = [F.struct("*").alias(carry)] if carry else []
    read = docs.select(
        *row, F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).alias("n_chars"), text_of().cast("binary").alias("text")
    )
    kept = [c for c in read.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*kept).schema)
    return read.mapInArrow(fold, f"{fields}, number long, fold long, key long, text_sha256 string" + ("" if carry else ", body binary"))


def _slot(bits: int = SLOT_BITS):
    return F.shiftrightunsigned("key", KEY_BITS - bits).alias("slot")


def directory_of(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory after all splits, of rows (key): slot, bucket, depth.

    A slot is one value of a key's leading SLOT_BITS bits."""
    slots = written(keys.select("key").distinct().groupBy(_slot()).agg(F.count("*").alias("n")), "directory-histogram")
    total = slots.agg(F.sum("n")).first()[0] or 0
    # the first directory is as deep as even buckets would need
    depth = min(SLOT_BITS, max(0, (total // capacity).bit_length() - 1))
    overfull, settled = slots, []
    while True:
        prefix = F.shiftrightunsigned("slot", SLOT_BITS - depth)
        full = overfull.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("held"))
        level = overfull.join(full, prefix == F.col("prefix")).select("slot", "n", "prefix", "held")
        level = written(level, "directory-level")  # keeps the plan short, however often it doubles
        more = depth < SLOT_BITS and not level.filter(F.col("held") > capacity).isEmpty()
        done = level.filter(F.col("held") <= capacity) if more else level
        bucket = F.shiftleft("prefix", SLOT_BITS - depth)
        settled.append(done.select("slot", bucket.alias("bucket"), F.lit(depth).alias("depth")))
        if not more:
            return reduce(DataFrame.unionByName, settled)
        overfull = level.filter(F.col("held") > capacity).select("slot", "n")
        depth += 1


def chains(routed: DataFrame) -> DataFrame:
    """bucket, depth, key, chain, fold, text_sha256 of rows with body besides, by the owners of the buckets."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            places = []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if key != now:
                    now, chain = key, []
                for place, member in enumerate(chain):
                    if member == body:
                        break
                else:
                    place = len(chain)
                    chain.append(body)
                places.append(place + 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("bucket", "depth", "key")], pa.array(places, pa.int32()), *[batch.column(c) for c in ("fold", "text_sha256")]],
                names=["bucket", "depth", "key", "chain", "fold", "text_sha256"],
            )

    owned = routed.select("bucket", "depth", "key", "fold", "text_sha256", "body").repartition("bucket")
    # by digest within a key: a place in a chain doesn't depend on the order of arrival
    owned = owned.sortWithinPartitions("bucket", "key", "text_sha256")
    return owned.mapInArrow(chained, "bucket long, depth int, key long, chain int, fold long, text_sha256 string")


def index_of(texts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index over the folds' first rows, as files in the shared folder: the columns of chains()."""
    directory = written(directory_of(texts, capacity), "dedup-directory")
    deepest = directory.agg(F.max("depth")).first()[0] or 0
    pointers = directory.select(F.shiftrightunsigned("slot", SLOT_BITS - deepest).alias("slot"), "bucket", "depth").distinct()
    routed = texts.withColumn("slot", _slot(deepest)).join(F.broadcast(pointers), "slot")
    return written(chains(routed), "dedup-index")


def decisions(rows: DataFrame, index: DataFrame) -> DataFrame:
    """number, doc_id, keep_id, group_size, kept, text_sha256, chain of every folded row."""
    # ~doc_id turns the order of ids around, without the overflow of -doc_id
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("flipped")))
    by_fold = rows.groupBy("fold").agg(F.count("*").alias("size"), best.alias("best"))
    placed = by_fold.join(index, "fold")
    entries = placed.groupBy("bucket", "key", "chain").agg(F.sum("size").alias("group_size"), F.max("best").alias("top"))
    decided = placed.join(entries, ["bucket", "key", "chain"]).select("fold", "group_size", "top", "text_sha256", "chain")
    keep_id = F.bitwise_not("top.flipped")
    kept = F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("top.n_chars"))
    return rows.select("number", "fold", "doc_id", "n_chars").join(decided, "fold").select(
        "number", "doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "chain"
    )


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, chain for every row of docs."""
    rows = written(folded(docs, key_bits), "dedup-folded")
    return decisions(rows, index_of(rows.filter("key IS NOT NULL"), capacity)).drop("number")


def kept_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, as they came in; of rows alike in id and text one stays."""
    rows = written(folded(docs, carry="row"), "dedup-folded")
    body = F.translate(text_of("row.text"), SPACES.decode(), "").cast("binary")
    index = index_of(rows.filter("key IS NOT NULL").withColumn("body", body), capacity)
    stay = decisions(rows, index).filter("kept").groupBy("doc_id", "text_sha256").agg(F.min("number").alias("number"))
    return rows.select("number", "row").join(stay.select("number"), "number", "left_semi").select("row.*")


ORACLE = r"""
WITH read AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM read WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, CAST(1 AS INTEGER) AS chain FROM best
"""
