"""A corpus from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
as Parquet in the shared folder and gives what it reads back to the next. All but
the last return the columns of documents.

Rows with a null doc_id pass the near-duplicate stage, which can't name them; rows
that repeat a doc_id and a text count as one from the exact stage on. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from claimloom.llm._shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    judged = language_id.identify(docs, language_id.learn(docs), carry=COLUMNS)
    return judged.filter(~F.col("rejected")).select(*COLUMNS)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the longest, then the one of the smallest doc_id."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one of the smallest doc_id."""
    groups = ngram_join.ngram_groups(docs)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to MOST times."""
    mix = mixing.mixed(docs.select(*COLUMNS), carry="row").filter("copies > 0")
    return mix.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "row").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document of the mix."""
    return byte_bpe.encode(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("ngram_join", one_of_near_copies),
    ("source_mixing", mixed_sources),
    ("byte_bpe", token_ids),
]
#: No SQL: language identification and byte-pair encoding aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
