"""A5: scoring of support items: effective score, primary item, roles, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import rules, text


def scored_items(claims: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """A row a link: overlap, score, whether it is the claim's primary item, role."""
    role = text.evidence_role(F.col("segment_type"), F.col("speaker"), F.col("raw_text"))
    items = segments.select("segment_id", role.alias("evidence"), text.weak_text(F.col("raw_text")).alias("w"), text.tokens(text.matchable(F.col("raw_text")), rules.VERIFY_STOP).alias("tokens"))
    mine = claims.select("claim_id", text.tokens(text.matchable(F.col("text")), rules.VERIFY_STOP).alias("mine"))
    rows = links.join(items, "segment_id").join(mine, "claim_id").withColumn("raw", text.overlap(F.col("mine"), F.col("tokens")))
    substantive = F.col("evidence") == "substantive"
    rows = rows.withColumn("substantive", substantive).withColumn("weak", substantive & F.col("w"))
    rows = rows.withColumn("overlap", F.when(F.col("weak"), F.least("raw", F.lit(rules.WEAK_OVERLAP))).otherwise(F.col("raw")))
    bonus = F.when(F.col("weak"), -0.25).when(substantive, 0.15).when(F.col("evidence") == "contextual", -0.15).otherwise(0.0)
    rows = rows.withColumn("score", F.round(F.col("overlap") + bonus, 9))
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), F.desc("overlap"), "link_order", "segment_id")
    rows = rows.withColumn("primary", F.row_number().over(order) == 1)
    named = F.when(F.col("weak") | ~substantive, "contextual").when(F.col("primary") & (F.col("overlap") >= 0.25), "primary").when(F.col("overlap") >= 0.3, "secondary")
    return rows.withColumn("role", named.otherwise("contextual"))


def scored_claims(items: DataFrame) -> DataFrame:
    """The claim's verdict and confidence from its scored items."""
    c = F.col
    s, x, p, o = c("s"), c("x"), c("p"), c("o")
    sums = items.groupBy("claim_id").agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.when(c("substantive"), c("overlap"))), F.lit(0.0)).alias("s"), F.coalesce(F.max(F.when(~c("substantive"), c("overlap"))), F.lit(0.0)).alias("x"),
        F.max(F.when(c("primary"), c("overlap"))).alias("p"), (F.bool_or("substantive") & F.bool_and(~c("substantive") | c("weak"))).alias("all_weak"),
        (F.bool_or(c("substantive") & ~c("weak") & (c("overlap") >= 0.55)) & F.bool_or(c("weak") & (c("raw") >= 0.35))).alias("tension"),
        F.first("mine").alias("mine"), F.array_distinct(F.flatten(F.collect_set(F.array_intersect("tokens", "mine")))).alias("tokens"),
    )
    sums = sums.withColumn("o", text.overlap(c("mine"), c("tokens"))).withColumn("narrow", (c("n") >= 2) & (o >= 0.55) & (p < 0.7) & (F.round(o - p, 9) >= 0.2))
    either = F.when(o > 0, "AMBIGUOUS").otherwise("UNSUPPORTED")
    verdict = (
        F.when(((x > 0) & (s < 0.2)) | c("all_weak") | ((x >= 0.45) & (s < 0.15)), either).when(c("tension") & (p >= 0.45), "PARTIALLY_SUPPORTED").when((p >= 0.7) & (s >= 0.55) & ~c("narrow"), "SUPPORTED")
        .when((s >= 0.35) | (p >= 0.45) | (o >= 0.55), "PARTIALLY_SUPPORTED").otherwise(either)
    )
    rows = sums.withColumn("verdict", verdict)
    confidence = F.when(c("verdict") == "SUPPORTED", 0.75).when(c("verdict") == "PARTIALLY_SUPPORTED", 0.6).when(c("verdict") == "AMBIGUOUS", 0.4).otherwise(0.25)
    return rows.select("claim_id", "verdict", confidence.alias("confidence"), F.round("p", 6).alias("primary_overlap"), F.round("o", 6).alias("combined"), "tension", "narrow")
