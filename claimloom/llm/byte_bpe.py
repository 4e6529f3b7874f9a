"""Byte-level BPE encoding and decoding, of long texts by overlapping chunks.

Texts of up to ``CHUNK`` characters are encoded where they are read. A longer
text is cut into chunks that overlap by ``OVERLAP`` characters, which are then
spread over the cluster:

1. each chunk is pre-tokenised by itself, from an arbitrary start, so its first
   boundaries may be wrong;
2. neighbours are stitched at the first boundary that both found in their overlap.
   A match of the pattern depends on what follows it only, so from a common
   boundary on the later chunk's matches are those of the whole text. Boundaries
   within MARGIN of a chunk's end, which the cut may have moved, aren't used, nor
   any after white space, where a piece would end otherwise than the text goes on;
3. the pieces between stitches are encoded, wherever there is room, and their ids put
   together in order. Only places, not texts, are gathered to find the stitches.

Chunks that have no boundary in common with the next (one run of letters longer than
the overlap) are put together with it and encoded as one. Equal long texts are encoded
once.
Decoding puts the tokens' raw bytes after each other.

Defined results: a null text counts as empty and has no ids; repeated rows each
give a row; an empty table gives no rows; other columns aren't read, unless asked
for by ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._shared import text_of, written

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32_768
OVERLAP = 1_024
MARGIN = 16
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


@lru_cache(maxsize=2)
def codec(ranks_path: str | None):
    """The library's encoding and the list of tokens' bytes; made once a worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return encoding, tokens


def decode_bytes(ids, ranks_path: str | None = None) -> bytes:
    return b"".join(map(codec(ranks_path)[1].__getitem__, ids))


def packed(ids) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def _results(all_ids: list, ranks_path: str | None, with_ids: bool) -> list[pa.Array]:
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return [
        pa.array([len(x) for x in all_ids], pa.int64()),
        pa.array([sha(packed(x)) for x in all_ids], pa.string()),
        pa.array([sha(decode_bytes(x, ranks_path)) for x in all_ids], pa.string()),
        pa.array(all_ids if with_ids else [None] * len(all_ids), pa.list_(pa.int32())),
    ]


def _with_results(schema: pa.Schema, columns: list, results: list) -> pa.RecordBatch:
    names = [*schema.names, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    return pa.RecordBatch.from_arrays([*columns, *results], names=names)


def small(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts get long: bounds a worker's memory."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if sizes:
            yield batch.slice(start)


def encode_whole(texts: DataFrame, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """texts, its column text replaced by RESULT; each text encoded in one go."""
    kept = [c for c in texts.columns if c != "text"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks_path)[0]
        for batch in small(batches):
            all_ids = [encoding.encode_ordinary(x or "") for x in batch.column("text").to_pylist()]
            rest = batch.select(kept)
            yield _with_results(rest.schema, rest.columns, _results(all_ids, ranks_path, with_ids))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(kept).schema)
    return texts.mapInArrow(encoded, f"{fields}, {RESULT}")


def chunks_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, k, start, last, piece: chunks of every text, each with the overlap that follows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                n = max(1, -(-len(text) // chunk))
                for first in range(0, n, 64):
                    at = range(first, min(n, first + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(at)),
                            pa.array(list(at), pa.int32()),
                            pa.array([k * chunk for k in at], pa.int64()),
                            pa.array([k == n - 1 for k in at]),
                            pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in at]),
                        ],
                        names=["key", "k", "start", "last", "piece"],
                    )

    return texts.select("key", "text").mapInArrow(cut, "key string, k int, start long, last boolean, piece string")


def boundaries_of(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, k, start, last, finish, head, tail: where each chunk ends, and the usable boundaries in its first and its last overlap."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        pattern = regex.compile(public_tokenizers.PATTERN)

        def usable(piece: str) -> list[int]:
            ends = (m.end() for m in pattern.finditer(piece))
            return [p for p in ends if p < len(piece) - MARGIN and not piece[p - 1].isspace()]

        for batch in batches:
            pieces, starts = batch.column("piece").to_pylist(), batch.column("start").to_pylist()
            heads, tails = [], []
            for piece, start in zip(pieces, starts):
                ends = usable(piece)
                heads.append([start + p for p in ends if p < overlap])
                tails.append([start + p for p in ends if p >= chunk])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            finish = pa.array([start + len(piece) for piece, start in zip(pieces, starts)], pa.int64())
            rest = batch.select(["key", "k", "start", "last"])
            yield pa.RecordBatch.from_arrays([*rest.columns, finish, *lists], names=[*rest.schema.names, "finish", "head", "tail"])

    schema = "key string, k int, start long, last boolean, finish long, head array<long>, tail array<long>"
    return chunks.mapInArrow(found, schema)


def stitched(places: DataFrame) -> DataFrame:
    """key, k, run, begin, end: the part of the text to encode, by runs of chunks.

    A chunk that has no boundary in common with the next is in one run with it."""
    order = Window.partitionBy("key").orderBy("k")
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    met = places.withColumn("end", F.when(F.col("last"), F.col("finish")).otherwise(common))
    before = F.lag("end").over(order)
    met = met.select("key", "k", "end", F.when(F.col("k") == 0, 0).otherwise(before).alias("begin"))
    return met.withColumn("run", F.count("begin").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def encode_chunked(
    texts: DataFrame, ranks_path: str | None = None, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """key and RESULT for each row of texts (key, text); keys are distinct."""
    spread = written(chunks_of(texts, chunk, overlap).repartition("key", "k"), "bpe-chunks")
    places = stitched(boundaries_of(spread, chunk, overlap))
    held = spread.select("key", "k", "start", "piece").join(places, ["key", "k"])
    runs = held.groupBy("key", "run").agg(
        F.sort_array(F.collect_list(F.struct("k", "start", "piece"))).alias("chunks"), F.max("begin").alias("begin"), F.max("end").alias("end")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks_path)[0]
        for batch in batches:
            ids = []
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                *most, last = [c["piece"] for c in r["chunks"]]
                text = "".join([x[:chunk] for x in most] + [last])
                start = r["chunks"][0]["start"]
                ids.append(packed(encoding.encode_ordinary(text[r["begin"] - start : r["end"] - start])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("run"), pa.array(ids, pa.binary())], names=["key", "run", "part"]
            )

    pieces = runs.mapInArrow(encoded, "key string, run long, part binary")
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", "part"))).alias("parts"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keys = batch.select(["key"])
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].as_py()
                ids = np.frombuffer(b"".join(p["part"] for p in parts), "<u4").tolist()
                yield _with_results(keys.schema, keys.slice(i, 1).columns, _results([ids], ranks_path, with_ids))

    return whole.mapInArrow(together, f"key string, {RESULT}")


def encode(
    docs: DataFrame, ranks_path: str | None = None, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the columns named in carry, and RESULT for every row of docs."""
    read = docs.select("doc_id", *carry, text_of().alias("text"))
    short = encode_whole(read.filter(F.length("text") <= chunk), ranks_path, with_ids)
    long = read.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    long = written(long, "bpe-long")
    once = written(long.select("key", "text").dropDuplicates(["key"]), "bpe-once")
    joined = long.drop("text").join(encode_chunked(once, ranks_path, with_ids, chunk, overlap), "key").drop("key")
    return short.unionByName(joined)
