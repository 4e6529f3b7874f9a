"""Token ids in ORC files: stripes, run-length encoding, row indexes, Bloom filters.

Documents are dealt out by ranges of doc_id and sorted within, so that files, and
the stripes and row groups in them, hold narrow ranges of ids. The columns of the
files are doc_id, part (the file's place in the order), row (the place in the
file) and ids. The writer is told to use run-length encoded integers, a row index
every ROWS_PER_INDEX rows and a Bloom filter on doc_id; a search for some ids then
reads the stripes and row groups that may hold them, and a whole read is split by
stripes over the tasks.

The tokeniser sees each distinct word of a batch once: a tokeniser that never joins
characters across ASCII white space gives a text the ids of its words one after the
other. Whether the given one is of that kind is read from its file (``by_words``); any
other encodes whole texts. Words of up to 16 bytes are compared as two integers, in
arrays, so that nothing is done word by word but for new ones; a worker remembers
WORDS_KEPT of these at most, and starts afresh beyond that.

Defined results: a null text counts as empty and has the end id alone; null
doc_ids come first; rows that repeat a doc_id each have a row, in the order of
their texts; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm._shared import new_path, text_of
from claimloom.llm.byte_bpe import small

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: words that a worker remembers, about 60 bytes each
WORDS_KEPT = 1_000_000
#: new words in a text that the tokeniser gets at once, SEPARATOR between them
AT_ONCE = 1_000
SEPARATOR = "|"
#: fixed value: the splitting pattern that is known never to match white space
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ROWS_PER_INDEX = 1_000
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id long, part int, row long, ids array<int>"
U = np.uint64
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: the leading bytes of eight, 0 to 8 of them
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def by_words(description: dict) -> bool:
    """Whether a tokeniser, as its file describes it, gives a text the ids of its words in order."""
    normal = description.get("normalizer") or {"type": "Sequence", "normalizers": []}
    split = description.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers", [])
    return (
        normal.get("type") == "Sequence"
        and all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in normal["normalizers"])
        and len(parts) == 2
        and parts[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and (parts[1]["type"], parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == ("ByteLevel", False, False)
        and description["model"]["type"] == "BPE"
        and not description["model"].get("dropout")
        and not description.get("truncation")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in description.get("added_tokens", []))
    )


class Words:
    """Words of up to 16 bytes and their ids, in arrays sorted by a hash of the word."""

    def __init__(self) -> None:
        self.hashed = self.low = self.high = np.zeros(0, U)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for those that aren't here."""
        at = np.searchsorted(self.hashed, hashed)
        at[at == len(self.hashed)] = 0
        if not len(self.hashed):
            return at - 1
        return np.where((self.hashed[at] == hashed) & (self.low[at] == low) & (self.high[at] == high), at, -1)

    def add(self, hashed: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.hashed) + len(hashed) > WORDS_KEPT:
            self.__init__()
        start = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(np.concatenate([self.hashed, hashed]), kind="stable")
        self.hashed, self.low, self.high, self.start, self.size = (
            np.concatenate(pair)[order]
            for pair in ((self.hashed, hashed), (self.low, low), (self.high, high), (self.start, start), (self.size, size))
        )
        self.ids = np.concatenate([self.ids, ids])


def joined(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at start and are of the given sizes, one after the other."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def word_encoder(path: str | None = None):
    """A function from texts to the ids of all and where each text's begin and end; made once a worker."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encoded_whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [ids_of(x) for x in texts]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, each)])

    with open(path, encoding="utf-8") as file:
        separate = by_words(json.load(file))
    mark = ids_of(SEPARATOR)
    if not separate or len(mark) != 1:
        return encoded_whole
    known = Words()

    def fresh(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        ids = ids_of(f" {SEPARATOR} ".join(words))
        cuts = np.flatnonzero(ids == mark[0])
        if len(cuts) == len(words) - 1:
            sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            return ids[ids != mark[0]], sizes
        if len(words) == 1:
            return ids, np.array([len(ids)])
        half = len(words) // 2  # a word that has the separator in it is among them
        (a, m), (b, n) = fresh(words[:half]), fresh(words[half:])
        return np.concatenate([a, b]), np.concatenate([m, n])

    def learned(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = [fresh(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)]
        return np.concatenate([a for a, _ in some]), np.concatenate([n for _, n in some])

    def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [x.encode() for x in texts]
        edges = np.cumsum([0, *(len(x) + 1 for x in pieces)])
        data = b" ".join(pieces) + bytes([32] * 17)
        chars = np.frombuffer(data, np.uint8)
        turns = np.flatnonzero(np.diff(~SPACES[chars], prepend=False, append=False))
        begin, end = turns[::2], turns[1::2]
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        size = end - begin
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = eights[begin] & MASKS[np.minimum(size, 8)]
        high = eights[np.minimum(begin + 8, len(eights) - 1)] & MASKS[np.clip(size - 8, 0, 8)]
        hashed = mixed(low + mixed(high + U(1)))
        short = size <= 16
        nul = np.flatnonzero(chars == 0)
        short[np.searchsorted(begin, nul, "right") - 1] = False  # a zero byte looks like the filling
        place = np.flatnonzero(short)
        _, first, inverse = np.unique(hashed[place], return_index=True, return_inverse=True)
        first = place[first]
        if (low[first][inverse] != low[place]).any() or (high[first][inverse] != high[place]).any():
            return encoded_whole(texts)  # two words of one hash
        spelled = lambda at: [data[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())]
        # the other words, one by one
        rest = np.flatnonzero(~short)
        odd: dict[str, int] = {}
        code = np.zeros(len(begin), np.int64)
        code[place] = inverse
        code[rest] = [len(first) + odd.setdefault(w, len(odd)) for w in spelled(rest)]
        at = known.find(hashed[first], low[first], high[first])
        new = np.flatnonzero(at < 0)
        ids, sizes = learned([*spelled(first[new]), *odd]) if len(new) + len(odd) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        starts = len(known.ids) + np.cumsum(sizes) - sizes
        from_known, values = at.clip(0), np.concatenate([known.ids, ids])
        start, length = (np.concatenate([old[from_known] if len(old) else np.zeros(len(at), np.int64), add[len(new) :]]) for old, add in ((known.start, starts), (known.size, sizes)))
        start[new], length[new] = starts[: len(new)], sizes[: len(new)]
        out = joined(start[code], length[code], values)
        n = len(new)
        known.add(hashed[first[new]], low[first[new]], high[first[new]], sizes[:n], ids[: int(sizes[:n].sum())])
        before = np.concatenate([[0], np.cumsum(length[code])])
        return out, before[np.searchsorted(begin, edges)]

    return encoded


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes doc_id, part, row and ids of every row of docs to ORC files at path."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in small(batches, 10_000_000):  # the more text at once, the fewer words twice
            ids, ends = encode(batch.column("text").to_pylist())
            n = batch.num_rows
            ids = np.insert(ids, ends[1:], end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, "i4")),
                    pa.array(np.arange(row, row + n)),
                    pa.ListArray.from_arrays(pa.array(ends + np.arange(n + 1), pa.int32()), pa.array(ids.view(np.int32))),
                ],
                names=["doc_id", "part", "row", "ids"],
            )
            row += n

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encoded, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids=None) -> DataFrame:
    """The files' rows; with doc_ids those alone, by way of the files' indexes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of the files."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).view("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(["doc_id", "part", "row"]).columns,
                    pa.array(np.diff(offsets).astype("i8")),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    each = rows.mapInArrow(summed, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    # the running sum: over the files first, a row each, then within each file
    held = rows.select("part", F.size("ids").alias("n")).groupBy("part").agg(F.sum("n").alias("held"))
    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", F.coalesce(F.sum("held").over(files), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(before, "part").select(
        "doc_id",
        (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and returns digests() of what is read back from them."""
    path = path or new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return digests(read_ids(docs.sparkSession, path))
