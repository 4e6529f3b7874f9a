import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import byte_bpe
from claimloom.llm._shared import table

EDGES = [
    None, "", " ", "a", "it's we'll  \n\n x", "é😀 漢字 ", "<|endoftext|> <s>", "ab cd  ef\n" * 400, "x" * 900, " " * 700 + "y",
    "don't " * 200, "a\n\n\nb \t c" * 150, "漢字" * 300, "'re" * 400, "1234567 " * 200, "word" * 20 + " tail" * 90,
]


def brute(text):
    ids = byte_bpe.codec(None)[0].encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(byte_bpe.packed(ids)), sha((text or "").encode()), ids


def check(df, **kw):
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in byte_bpe.encode(df, with_ids=True, **kw).collect()}
    assert got == {k: brute(v) for k, v in texts.items()}


@pytest.mark.parametrize("chunk, overlap", [(64, 24), (100, 50)])
def test_edges_in_small_chunks(spark, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)]
    check(spark.createDataFrame(rows, "doc_id long, text string, ids string"), chunk=chunk, overlap=overlap)


def test_whole_table_in_chunks(spark, sf):
    check(table(spark, sf, "documents").select("doc_id", "text"), chunk=1000, overlap=200)


def test_long_texts_in_chunks_of_the_default_size(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(1, 12))) for _ in range(900)]
    prose = " ".join(rng.choices(words, k=40_000)) + ".\n\n" + ", ".join(rng.choices(words, k=8_000))
    run = "x" * (3 * byte_bpe.CHUNK)
    rows = [(1, prose), (2, prose[: byte_bpe.CHUNK]), (3, prose[: byte_bpe.CHUNK + 1]), (4, prose[:90_000] + " " + run + " " + prose[:90_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    chunks = byte_bpe.chunks_of(df.selectExpr("CAST(doc_id AS STRING) AS key", "text"), byte_bpe.CHUNK, byte_bpe.OVERLAP)
    places = byte_bpe.stitched(byte_bpe.boundaries_of(chunks, byte_bpe.CHUNK, byte_bpe.OVERLAP))
    runs = {r["key"]: (r["n"], r["longest"]) for r in places.groupBy("key", "run").count().groupBy("key").agg(F.count("*").alias("n"), F.max("count").alias("longest")).collect()}
    assert runs["1"][0] >= 8 and runs["1"][1] == 1  # each chunk by itself
    assert runs["4"][0] >= 5 and 3 <= runs["4"][1] <= 5  # those about the long run alone are put together


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b " * 100)] * 2 + [(None, "a b " * 100)], "doc_id long, text string")
    assert byte_bpe.encode(df, chunk=64, overlap=24).count() == 3
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_decoding_is_the_inverse():
    text = "Zwölf Boxkämpfer 😀\n\tjagen"
    ids = byte_bpe.codec(None)[0].encode_ordinary(text)
    assert byte_bpe.decode_bytes(ids).decode() == text
