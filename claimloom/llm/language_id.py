"""Language identification by n-gram filters that answer for all languages at once.

Learning. Of the labelled documents outside the held-out fold a bounded sample is
read, about FIT_ROWS a language, chosen by a hash of doc_id. For each language the
n-grams are counted by the documents that hold them; kept are those of at least
MIN_DOCS documents (fewer for a language of few) whose share is no less than RATIO of the share in any other
language, the most frequent TOP for each language. They go into a bit-sliced Bloom
filter: a table of SLOTS words with a bit a language, HASHES slots an n-gram.

Prediction. The AND of an n-gram's slots is the set of languages that hold it. For
each language the n-grams of the whole text are counted; from n n-grams, n*p would
be counted falsely, p the language's false-positive rate from the share of its bits
set, so (hits - n*p) / (1 - p) decides. The score is the winner's part of the sum
of its own and the runner-up's corrected counts, 0 where nothing was found.

The filter's size doesn't depend on the corpus: SLOTS times a byte for every eight
languages. The pass over the corpus reads doc_id and text and shuffles nothing.

Defined results: ``und``, score 0 and rejected for a null text and one without a
letter; ``und`` and score 0, not rejected, for all if no language could be learned; text with letters but no known n-gram gets
the first language and score 0, and of languages with equal counts the first by code
point wins, with score 0.5; a null doc_id isn't learned from and isn't held
out; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._shared import written
from claimloom.llm.byte_bpe import small

N = 4
FIT_ROWS = 2_000
MIN_DOCS = 3
RATIO = 0.3
TOP = 30_000
SLOTS = 1 << 20
HASHES = 3
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=bool)


def ngrams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams; where each text's begin and the end of the last; letters in each text.

    An n-gram is N characters of the lower-cased text, others than letters being
    spaces, whose inner characters are letters."""
    parts = [np.frombuffer(f" {(x or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in texts]
    edges = np.cumsum([0, *map(len, parts)])
    chars = np.concatenate([*parts, np.full(N, 32, "<u4")])
    letter = _letters()[chars]
    codes = np.where(letter, chars, 32).astype(np.uint64)
    n = len(codes) - N + 1
    hashed = np.zeros(n, dtype=np.uint64)
    for i in range(N):
        hashed += codes[i : n + i] * _MULTIPLIERS[i]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    valid = np.logical_and.reduce([letter[i : n + i] for i in range(1, N - 1)])
    counts = np.concatenate([[0], np.cumsum(letter[:n])])
    return hashed[valid], np.concatenate([[0], np.cumsum(valid)])[edges], np.diff(counts[edges])


@dataclass(frozen=True)
class Filters:
    """The bit-sliced filter: languages, a row of bit words a slot, false-positive rates."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def hits(self, hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Texts by languages: how many of a text's n-grams the language holds."""
        out = np.zeros((len(edges) - 1, len(self.languages)))
        width = 8 * self.table.itemsize
        for w in range(self.table.shape[1]):
            words = self.table[:, w]
            found = words[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
            for k in range(1, HASHES):
                found = found & words[((hashes >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)]
            for bit in range(min(width, len(self.languages) - w * width)):
                run = np.concatenate([[0], np.cumsum((found >> self.table.dtype.type(bit)) & self.table.dtype.type(1), dtype=np.int64)])
                out[:, w * width + bit] = np.diff(run[edges])
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """For each text its language, the score, and whether it is rejected for having no letter."""
        hashes, edges, letters = ngrams_of(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), (letters == 0).tolist()
        n = np.diff(edges)[:, None]
        true = np.maximum(0.0, (self.hits(hashes, edges) - n * self.false_rate) / (1 - self.false_rate))
        best = true.argmax(axis=1)
        top = true[np.arange(len(texts)), best]
        true[np.arange(len(texts)), best] = 0.0
        rival = true.max(axis=1)
        score = np.divide(top, top + rival, out=np.zeros_like(top), where=top > 0)
        known = letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0).tolist(), (~known).tolist()


def build(languages: list[str], rows: list[tuple[int, int]]) -> Filters:
    """rows: (n-gram's hash as a signed integer, index of the language)."""
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    width = 8 * np.dtype(kind).itemsize
    table = np.zeros((SLOTS, max(1, -(-len(languages) // width))), dtype=kind)
    grams = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    owner = np.array([r[1] for r in rows], dtype=np.int64)
    rate = np.zeros(len(languages))
    for i in range(len(languages)):
        own, w, bit = grams[owner == i], i // width, kind(1 << (i % width))
        for k in range(HASHES):
            table[((own >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64), w] |= bit
        rate[i] = ((table[:, w] & bit) != 0).mean() ** HASHES
    return Filters(languages, table, np.minimum(rate, 0.99))


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, top: int = TOP) -> Filters:
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # a share of each language, by a hash of the id: about fit_rows of them
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(9)), F.lit(1_000_000)) < F.lit(1e6 * fit_rows) / F.col("n")
    sample = labelled.join(F.broadcast(sizes), "lang").filter(drawn & F.col("text").isNotNull()).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2_000_000):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            hashes, edges, _ = ngrams_of(texts)
            for lang in dict.fromkeys(langs):
                own = [np.unique(hashes[edges[i] : edges[i + 1]]) for i, x in enumerate(langs) if x == lang]
                grams, docs_with = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(docs_with)],
                    names=["lang", "gram", "docs"],
                )

    counts = (
        sample.mapInArrow(counted, "lang string, gram long, docs long")
        .groupBy("gram", "lang")
        .agg(F.sum("docs").alias("docs"))
        .join(F.broadcast(sizes), "lang")
        .filter(F.col("docs") >= F.least(F.lit(MIN_DOCS), F.greatest(F.lit(1), F.col("n") / 100)))
    )
    shares = counts.withColumn("share", F.col("docs") / F.least("n", F.lit(fit_rows)))
    most = F.max("share").over(Window.partitionBy("gram"))
    telling = shares.withColumn("most", most).filter(F.col("share") >= RATIO * F.col("most")).select("lang", "gram", "docs")
    telling = written(telling, "language-grams")
    # the least count that leaves a language no more than top n-grams, from a histogram of the counts
    run = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("docs")))
    by_count = telling.groupBy("lang", "docs").agg(F.count("*").alias("grams")).withColumn("run", run)
    least = by_count.filter(F.col("run") <= top).groupBy("lang").agg(F.min("docs").alias("least"))
    # a language whose first level alone is larger has the first top n-grams of it, by their hashes
    over = by_count.filter((F.col("run") > top) & (F.col("run") == F.col("grams"))).select("lang", "docs")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("gram"))
    first = telling.join(F.broadcast(over), ["lang", "docs"]).withColumn("place", place).filter(F.col("place") <= top).select("gram", "lang")
    kept = telling.join(F.broadcast(least), "lang").filter(F.col("docs") >= F.col("least")).select("gram", "lang").unionByName(first).collect()
    languages = sorted({r["lang"] for r in kept})
    index = {lang: i for i, lang in enumerate(languages)}
    return build(languages, [(r["gram"], index[r["lang"]]) for r in kept])


def identify(docs: DataFrame, filters: Filters, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in carry, held_out, lang_pred, score and rejected for every row of docs."""
    names = dict.fromkeys(("doc_id", *carry))
    read = docs.select(*names, *([] if "text" in names else ["text"]), held_out(F.col("doc_id")).alias("held_out"))
    kept = [*names, "held_out"]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1_000_000):
            langs, scores, rejected = shared.value.decide(batch.column("text").to_pylist())
            rest = batch.select(kept)
            columns = [*rest.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(kept).schema)
    return read.mapInArrow(predicted, f"{fields}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learns from docs and predicts for docs."""
    return identify(docs, learn(docs, fit_rows))
