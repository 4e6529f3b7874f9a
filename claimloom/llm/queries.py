"""The queries over the given tables, one an operator, and their SQL."""

from __future__ import annotations

from claimloom.llm import (
    byte_bpe, centroid_clusters, embedding_join, exact_dedup, fill_in_middle, language_id, mixing, ngram_join, quality_rules, secrets, token_files, url_filter, warc_fixity,
)
from claimloom.llm._shared import table


def op1_byte_bpe(spark, sf_dir):
    return byte_bpe.encode(table(spark, sf_dir, "documents")).drop("ids")


def op2_url_filter(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_embedding_join(spark, sf_dir):
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.transformed(table(spark, sf_dir, "documents"), with_text=False)


def op13_centroid_clusters(spark, sf_dir):
    return centroid_clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_warc_fixity": warc_fixity.query,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_embedding_join": op8_embedding_join,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_quality_rules": op11_quality_rules,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.oracle(),
    "op3_warc_fixity": warc_fixity.ORACLE,
    "op5_source_mixing": mixing.oracle(),
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_embedding_join": embedding_join.ORACLE,
    "op12_fill_in_middle": fill_in_middle.oracle(),
    "op13_centroid_clusters": centroid_clusters.oracle(),
}
