"""Scopes: which documents a draft may use, and which links are valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revalidated(links: DataFrame, claims: DataFrame, segments: DataFrame, bundles: DataFrame) -> DataFrame:
    """The first reason for which a link is invalid, null if it is valid."""
    c = claims.select("claim_id", F.col("matter").alias("claim_matter"), "bundle", F.lit(True).alias("has_claim"))
    s = segments.select("segment_id", "doc_id", F.col("matter").alias("segment_matter"), F.lit(True).alias("has_segment"))
    held = bundles.select("bundle", "doc_id").distinct().withColumn("in_bundle", F.lit(True))
    joined = links.join(c, "claim_id", "left").join(s, "segment_id", "left").join(held, ["bundle", "doc_id"], "left")
    code = (
        F.when(F.col("has_claim").isNull(), "missing_claim_support_link")
        .when(F.col("has_segment").isNull(), "missing_segment_support_link")
        .when(~F.col("claim_matter").eqNullSafe(F.col("segment_matter")), "cross_matter_support_link")
        .when(F.col("bundle").isNotNull() & F.col("in_bundle").isNull(), "out_of_scope_support_link")
    )
    return joined.select(*links.columns, code.alias("code"))


def allowed_documents(drafts: DataFrame, bundles: DataFrame, documents: DataFrame, fallback: bool = True) -> DataFrame:
    """draft_id, doc_id: of the draft's bundle, else (if fallback) of its matter."""
    bundled = drafts.filter("bundle IS NOT NULL").join(bundles, "bundle").select("draft_id", "doc_id")
    if not fallback:
        return bundled.distinct()
    rest = drafts.filter("bundle IS NULL").join(documents, "matter").select("draft_id", "doc_id")
    return bundled.unionByName(rest).distinct()


#: parts of a scope's drafts, in each of which they are numbered; twice as many tasks make the rows of drafts and documents
SPREAD = 64
#: drafts of a part that share a copy of the scope's documents: a multiple of eight, so that bit-packed files of the rows repeat themselves
STRETCH = 512


def ordered_documents(drafts: DataFrame, bundles: DataFrame, documents: DataFrame, fallback: bool = True) -> DataFrame:
    """allowed_documents() with place, the order in the draft: by created_at, name and id.

    documents: doc_id, matter, created_at, name. A draft of one bundle, or one matter, has the places that the
    documents have there: these are found once for all its drafts, and rows of drafts and documents are made by the
    last join and go into no shuffle. They come document by document, each with a stretch of drafts, always the same
    ones in the same order: written, that takes a fraction of the bytes that draft by draft would. Only drafts with several
    scopes are put in order one by one."""
    scopes = drafts.select("draft_id", "bundle", F.when(F.col("bundle").isNull(), F.col("matter")).alias("matter")).distinct()
    count = scopes.groupBy("draft_id").agg(F.count("*").alias("scopes"))
    counted = scopes.alias("s").join(count.alias("n"), F.expr("s.draft_id <=> n.draft_id")).select("s.*", "scopes")
    files = documents.select("doc_id", "created_at", "name")

    def placed(key: str, held: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy("created_at", "name", "doc_id")
        places = held.select(key, "doc_id").distinct().join(files, "doc_id").select(key, "doc_id", F.row_number().over(order).alias("place"))
        own = counted.filter(F.col(key).isNotNull() & (F.col("scopes") == 1)).select("draft_id", key, F.pmod(F.xxhash64("draft_id"), F.lit(SPREAD)).alias("part"))
        number = F.row_number().over(Window.partitionBy(key, "part").orderBy("draft_id"))
        own = own.withColumn("stretch", F.floor((number - 1) / STRETCH))
        stretches = own.select(key, "part", "stretch").distinct()  # few rows: one for STRETCH drafts
        # numbers of their own, or Spark takes few tasks for these few bytes, and each of them makes very many rows
        copies = places.repartition(2 * SPREAD, "doc_id").join(F.broadcast(stretches), key)
        dealt = lambda t: t.repartition(2 * SPREAD, key, "part", "stretch")
        # merged: that join alone keeps a stretch's rows together, and holds the stretch's drafts only
        return dealt(copies).hint("merge").join(dealt(own), [key, "part", "stretch"]).select("draft_id", "doc_id", "place")

    several = allowed_documents(counted.filter("scopes > 1"), bundles, documents, fallback).join(files, "doc_id")
    order = Window.partitionBy("draft_id").orderBy("created_at", "name", "doc_id")
    rows = placed("bundle", bundles).unionByName(several.select("draft_id", "doc_id", F.row_number().over(order).alias("place")))
    return rows.unionByName(placed("matter", documents)) if fallback else rows


def new_links(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested pairs that aren't there yet, once each, numbered after the claim's last.

    requests: claim_id, segment_id, order; existing: claim_id, segment_id, seq."""
    once = requests.groupBy("claim_id", "segment_id").agg(F.min("order").alias("order"))
    new = once.join(existing, ["claim_id", "segment_id"], "left_anti")
    last = existing.groupBy("claim_id").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("order", "segment_id"))
    numbered = new.join(last, "claim_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + place)
    return numbered.select("claim_id", "segment_id", F.col("seq").cast("long").alias("seq"))


def excluded_summary(links: DataFrame) -> DataFrame:
    """For each claim the codes of its excluded links with their counts, as one sentence."""
    counts = links.filter("code IS NOT NULL").groupBy("claim_id", "code").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "code", "n")))
    return counts.groupBy("claim_id").agg(F.sum("n").alias("excluded"), F.concat(F.lit("Excluded links: "), F.array_join(parts, ", "), F.lit(".")).alias("sentence"))


def context_windows(segments: DataFrame, radius: int = 1) -> DataFrame:
    """For each segment the ids of those within radius places of it in its document."""
    order = Window.partitionBy("doc_id").orderBy((~F.col("anchored")).cast("int"), "line_no", "segment_id")
    near = F.collect_list("segment_id").over(order.rowsBetween(-radius, radius))
    return segments.select("doc_id", "segment_id", near.alias("near"))
