"""Fill-in-the-middle transformation, assembled by a secondary sort.

A document is cut into units (lines), and by two hashed places into prefix, middle and suffix.
The task that reads it emits pieces: chunks of whole units, of PIECE bytes at most (a longer
unit is cut between characters), keyed by the document's row and the piece's position in the
output; the first piece of a section begins with the section's sign. The pieces are repartitioned
by the key and sorted within the partitions, so that a task streams the output of one document
after the other into an incremental digest, holding a piece at a time.

Restoration reads that stream: it finds the signs in the output, which says to which section a
piece belongs, and leaves the pieces keyed by document, section and place. They are sorted
again within the same partitions, without another shuffle, and stream into the second digest.

The shuffle is the DataFrame's: repartition, then sortWithinPartitions, Spark's external sort.
``transformed`` puts the output of each document into a column besides; it holds one output at
a time.

Defined results: a null text counts as empty and is plain; a null doc_id hashes as an empty
string; rows that repeat a doc_id are documents of their own, cut alike; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm._shared import text_of
from claimloom.llm.byte_bpe import small

SEED = "7:"
RATE, SPM_RATE = 100, 50
PIECE = 1 << 15
#: the signs of prefix, suffix and middle
SIGNS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
#: the order of the sections in the output, by form
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: the places of the sections in the text
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
ABOUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"key long, at int, data binary, {ABOUT}"


def draws_of(doc_id: Column, seed: str = SEED) -> Column:
    """h1 to h4: the leading groups of eight digits of a digest of the id, as numbers."""
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def chunks(data: bytes, ends: np.ndarray, size: int = PIECE) -> Iterator[bytes]:
    """data in chunks of at most size bytes, cut at the last of ends that fits, else between characters.

    ends: where units of data end, ascending, the last being its length."""
    start = 0
    while start < len(data):
        stop = min(start + size, len(data))
        unit = int(np.searchsorted(ends, stop, side="right")) - 1
        if unit >= 0 and ends[unit] > start:
            stop = int(ends[unit])
        while stop < len(data) and stop > start + 1 and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[start:stop]
        start = stop


def cut(text: bytes, draws: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, dict[int, tuple[bytes, np.ndarray]]]:
    """How many units text has, the form, and by section its bytes and the ends of its units."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    n = len(ends)
    if not text or any(sign in text for sign in SIGNS) or draws[2] % 100 >= rate:
        return n, "plain", {PREFIX: (text, ends)}
    places = np.concatenate([[0], ends])
    low, high = sorted(int(h % (n + 1)) for h in draws[:2])
    bounds = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
    parts = {s: (text[places[a] : places[b]], places[a + 1 : b + 1] - places[a]) for s, (a, b) in bounds.items()}
    return n, "spm" if draws[3] % 100 < spm_rate else "psm", parts


def pieces(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED, size: int = PIECE) -> DataFrame:
    """PIECES: the outputs of all rows of docs, cut; what is about a document is in its first piece.

    key is the row's number, by the partition that reads it, so docs must be read alike each
    time, as tables are."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        columns: list[list] = [[] for _ in range(8)]
        held = 0

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["key", "at", "data", "doc_id", "n", "form", "prefix_chars", "middle_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in small(batches):
            for doc_id, text, draws in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "draws")]):
                n, form, parts = cut(text, draws, rate, spm_rate)
                chars = [None, None] if form == "plain" else [characters(parts[s][0]) for s in (PREFIX, MIDDLE)]
                at = 0
                for section in ORDERS.get(form, (PREFIX,)):
                    sign = b"" if form == "plain" else SIGNS[section]
                    body, ends = parts[section]
                    for i, chunk in enumerate(chunks(body, ends, size) if body else [b""]):
                        about = [doc_id, n, form, *chars] if at == 0 else [None] * 5
                        for column, value in zip(columns, [key, at, (sign if i == 0 else b"") + chunk, *about]):
                            column.append(value)
                        at += 1
                        held += len(chunk)
                        if held > 1 << 22:
                            yield batch_of()
                            columns, held = [[] for _ in range(8)], 0
                key += 1
        if columns[0]:
            yield batch_of()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), draws_of(F.col("doc_id"), seed).alias("draws"))
    return read.mapInArrow(emitted, PIECES)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """The rows one by one, with whether a document begins."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            yield row["key"] != now, row
            now = row["key"]


def assembled(cut_up: DataFrame, with_text: bool = False) -> DataFrame:
    """The output streamed: key, place (the section's in the text), at, data (without signs), and in
    a document's last row its PIECES' columns, output_sha256 and, with_text, output.

    The sections are those that the signs in the output tell."""
    names = ["key", "place", "at", "data", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", *(["output"] if with_text else [])]
    schema = f"key long, place int, at int, data binary, {ABOUT}, output_sha256 string" + (", output binary" if with_text else "")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = 0
        about: list = []
        digest = hashlib.sha256()
        place, signs, whole = 0, [], []

        def last() -> list:
            text = [b"".join(whole)] if with_text else []
            return [key, len(PLACES), 0, b"", *about, digest.hexdigest(), *text]

        key = None
        for begins, row in _documents(batches):
            if begins:
                if key is not None:
                    rows.append(last())
                key, about = row["key"], [row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
                digest, place, whole = hashlib.sha256(), 0, []
                signs = list(ORDERS.get(about[2], ()))
            data = row["data"]
            digest.update(data)
            if with_text:
                whole.append(data)
            # the next sign begins another section; a piece never cuts a sign
            while signs and (found := data.find(SIGNS[signs[0]])) >= 0:
                if found:
                    rows.append([key, place, row["at"], data[:found], *[None] * (len(names) - 4)])
                place, data = PLACES[signs[0]], data[found + len(SIGNS[signs[0]]) :]
                signs.pop(0)
            rows.append([key, place, row["at"], data, *[None] * (len(names) - 4)])
            held += len(data)
            if held > 1 << 22 or len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if key is not None:
            rows.append(last())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return cut_up.repartition("key").sortWithinPartitions("key", "at").mapInArrow(streamed, schema)


def restored(stream: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (and output, where it is there) of each document.

    The stream's partitions hold whole documents, so it is sorted where it is."""
    told = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    rest = [c for c in ("output",) if c in stream.columns]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary() for _ in rest]]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, rows = hashlib.sha256(), []
        for begins, row in _documents(batches):
            if begins:
                digest = hashlib.sha256()
            digest.update(row["data"])
            if row["output_sha256"] is not None:
                rows.append([*[row[c] for c in told], digest.hexdigest(), *[row[c] for c in rest]])
                if len(rows) >= (16 if rest else 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*told, "restored_sha256", *rest])
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*told, "restored_sha256", *rest])

    schema = f"{ABOUT}, output_sha256 string, restored_sha256 string" + "".join(f", {c} binary" for c in rest)
    return stream.sortWithinPartitions("key", "place", "at").mapInArrow(joined, schema)


def transformed(docs: DataFrame, with_text: bool = True, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with_text, output for every row of docs."""
    found = restored(assembled(pieces(docs, **options), with_text))
    return found.withColumn("output", F.col("output").cast("string")) if with_text else found


def oracle(rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> str:
    drawn = ", ".join(f"('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return rf"""
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
units AS (
  SELECT doc_id, body, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS u, {drawn} FROM read),
placed AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= {rate} THEN 'plain'
      WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM units),
parted AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parted
"""
