import json
import zlib
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs, orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import token_files
from claimloom.llm._shared import new_path, table

EDGES = [
    None, "", " \n", "Hello, WORLD it's 42", "é é ́x", "<|endoftext|>a <|startoftext|>", "a\x1cb\x85c d e",
    "ΑΣ Σ. İstanbul ǅ", "x" * 500, "don't we'll" * 20, "漢字 😀", "a\x0bb\x0cc\rd", "12 345",
]


def brute(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(df):
    got = sorted((tuple(r) for r in token_files.token_files(df).collect()), key=lambda r: r[1])
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_edges(spark):
    rows = [(100 - i, t, 1) for i, t in enumerate(EDGES)] + [(7, "b", 1), (7, "a a", 1), (None, "n", 1)]
    check(spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3))


def test_whole_table(spark, sf):
    check(table(spark, sf, "documents").select("doc_id", "text"))


def test_empty_table(spark):
    assert token_files.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_search_is_pushed_to_the_files(spark, sf):
    path = new_path(spark, "ids")
    token_files.write_ids(table(spark, sf, "documents"), path)
    found = token_files.read_ids(spark, path, [3, 5])
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 5]
    assert "PushedFilters: [In(doc_id, [3,5])]" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("kept", [3, 10, 1000])
def test_a_small_memory_of_words_changes_nothing(monkeypatch, kept):
    monkeypatch.setattr(token_files, "WORDS_KEPT", kept)
    texts = ["a b, C!?", "d E;; f g a (b) <|endoftext|>", "", "b " + "z" * 99 + ". J\u030c. B A, a", "| a|b |, | a", "z 5z z, a", "a\0 \0a a", "\0", " ", "x" * 16 + " " + "x" * 17]
    token_files.word_encoder.cache_clear()
    encode = token_files.word_encoder()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for some in (texts, texts[::-1], [], ["", " "], texts * 3):
        ids, ends = encode(some)
        own = want if some in (texts, texts * 3) else want[::-1] if some else []
        got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert got == (own * (len(some) // max(1, len(own))) if own and len(some) >= len(own) else [[]] * len(some))


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(token_files, "mixed", lambda x: x % np.uint64(7))
    token_files.word_encoder.cache_clear()
    ids, ends = token_files.word_encoder()(["one two three four five six seven eight nine ten"])
    token_files.word_encoder.cache_clear()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.tolist() == tok.encode("one two three four five six seven eight nine ten", add_special_tokens=False).ids


def test_a_tokeniser_of_another_kind_sees_whole_texts(tmp_path):
    description = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    assert token_files.by_words(description)
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "NFKC"}}, {"added_tokens": [{**description["added_tokens"][0], "content": "a b"}]}):
        assert not token_files.by_words(description | change)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(description | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}))
    ids, ends = token_files.word_encoder(str(other))(["Hello there, world", "", "a b"])
    tok = Tokenizer.from_file(str(other))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in ("Hello there, world", "", "a b")]


def test_a_very_long_text(spark):
    check(spark.createDataFrame([(2, "Word, 1234 other's " * 40_000), (1, "q" * 300_000), (3, "a1" * 50_000)], "doc_id long, text string"))


def test_stripes_are_skipped_and_read_by_several_tasks(spark, monkeypatch):
    """One file of many stripes: a search reads few rows of it, a whole read takes several tasks."""
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 20)
    text = F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(16)])
    docs = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    path = new_path(spark, "ids")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        token_files.write_ids(docs, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    file = list(spark.read.orc(path).inputFiles())
    assert len(file) == 1
    with fs.LocalFileSystem().open_input_file(urlparse(file[0]).path) as opened:
        tail = orc.ORCFile(opened)
        assert tail.nstripes > 2 and tail.row_index_stride == token_files.ROWS_PER_INDEX and tail.compression == "ZSTD"
    stream = spark._jvm.org.apache.orc.OrcFile.createReader(
        spark._jvm.org.apache.hadoop.fs.Path(file[0]), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    )
    footer = stream.rows().readStripeFooter(stream.getStripes()[0])
    kinds = {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    rows = token_files.read_ids(spark, path, [14_001])
    assert [r["doc_id"] for r in rows.collect()] == [14_001]
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 1 <= scan.metrics().apply("numOutputRows").value() <= 4 * token_files.ROWS_PER_INDEX  # of 20,000
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        tasks = token_files.read_ids(spark, path).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] > 0 for r in tasks) > 1 and sum(r["count"] for r in tasks) == 20_000
