"""Draft rollups: verdict counts, flag buckets, risk ranking, queues, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: verdicts, which are flagged, their severity; reasoning categories by flag ---
COUNTED = ("SUPPORTED", "PARTIALLY_SUPPORTED", "OVERSTATED", "AMBIGUOUS", "UNSUPPORTED", "UNVERIFIED")
SEVERITY = ("UNSUPPORTED", "OVERSTATED", "AMBIGUOUS", "UNVERIFIED")
CATEGORIES = (
    ("fabricated_authority", ("quote_mismatch_placeholder",)),
    ("missing_authority", ("missing_citation",)),
    ("temporal_mismatch", ("temporal_scope_mismatch",)),
    ("scope_mismatch", ("subject_mismatch", "absolute_qualifier_mismatch", "out_of_scope_support_link", "cross_matter_support_link")),
    ("weak_support", ("contextual_support_only", "narrow_support", "knowledge_escalation", "causation_escalation", "needs_human_review", "invalid_anchor")),
)


def severity(verdict: Column) -> Column:
    rank = F.lit(99)
    for i, name in enumerate(SEVERITY):
        rank = F.when(verdict == name, i).otherwise(rank)
    return rank


def categories_of(flags: Column, verdict: Column) -> Column:
    """Reasoning categories in their fixed order."""
    tests = [F.when(F.arrays_overlap(flags, F.array(*map(F.lit, own))), F.lit(name)) for name, own in CATEGORIES]
    contradiction = (verdict == "CONTRADICTED") | F.exists(flags, lambda f: f.contains("contradict"))
    return F.filter(F.array(*tests, F.when(contradiction, F.lit("contradiction"))), lambda c: c.isNotNull())


def verdict_counts(claims: DataFrame) -> DataFrame:
    """A1: a row a draft with the count of each counted verdict; CONTRADICTED is in the total alone."""
    each = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in COUNTED]
    return claims.groupBy("draft_id").agg(F.count("*").alias("total_claims"), *each)


def flagged(claims: DataFrame) -> DataFrame:
    """D5."""
    return claims.filter(F.col("verdict").isin(*SEVERITY))


def flagged_counts(claims: DataFrame) -> DataFrame:
    """A2: counts by verdict over the flagged, their total and the highest severity."""
    each = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in SEVERITY]
    rank = F.min(severity(F.col("verdict")))
    top = F.element_at(F.array(*map(F.lit, SEVERITY)), (rank + 1).cast("int"))
    return flagged(claims).groupBy("draft_id").agg(F.count("*").alias("total_flagged"), *each, top.alias("highest"))


def flag_buckets(claims: DataFrame) -> DataFrame:
    """A3: claims by draft and flag, ranked by count, then name."""
    counts = flagged(claims).select("draft_id", F.explode("flags").alias("flag")).groupBy("draft_id", "flag").agg(F.count("*").alias("claim_count"))
    order = Window.partitionBy("draft_id").orderBy(F.desc("claim_count"), "flag")
    return counts.withColumn("rank", F.row_number().over(order))


def top_risky(claims: DataFrame, limit: int = 5) -> DataFrame:
    """By severity, more flags, lower confidence (null first), then the draft's order."""
    confidence = F.coalesce("confidence", F.lit(-1.0))
    order = Window.partitionBy("draft_id").orderBy(severity(F.col("verdict")), F.desc(F.size("flags")), confidence, "claim_id")
    return flagged(claims).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def queue(claims: DataFrame, decided: DataFrame, after: Column | None = None) -> DataFrame:
    """Counts of a draft's flagged claims, and the next active one after the given place, wrapping."""
    marked = flagged(claims).join(decided.select("claim_id").distinct().withColumn("done", F.lit(True)), "claim_id", "left")
    active = F.col("done").isNull()
    later = F.min(F.when(active & (F.col("claim_id") > (F.lit(-1) if after is None else after)), F.col("claim_id")))
    return marked.groupBy("draft_id").agg(
        F.count("*").alias("total"), F.count_if(~active).alias("resolved"), F.count_if(active).alias("remaining"),
        F.coalesce(later, F.min(F.when(active, F.col("claim_id")))).alias("next_claim_id"),
    )


def queue_rows(claims: DataFrame, decided: DataFrame) -> DataFrame:
    """A draft's flagged claims, active or resolved by a decision, in the draft's order."""
    marked = flagged(claims).join(decided.select("claim_id").distinct().withColumn("done", F.lit(True)), "claim_id", "left")
    rows = marked.select("draft_id", "claim_id", "verdict", F.when(F.col("done").isNull(), "active").otherwise("resolved").alias("state"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("draft_id", "state").orderBy("claim_id")))


def validated(decisions: DataFrame) -> DataFrame:
    """Note and replacement with blanks as null, and the reason for rejection, null if accepted."""
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    rows = decisions.select("decision_id", "claim_id", "action", clean("note"), clean("replacement"))
    acknowledge, revise, resolve = (F.col("action") == a for a in ("ACKNOWLEDGE_RISK", "MARK_FOR_REVISION", "RESOLVE_WITH_EDIT"))
    no_note, has_text = F.col("note").isNull(), F.col("replacement").isNotNull()
    reason = (
        F.when(acknowledge & has_text, "replacement_not_allowed").when(revise & no_note, "note_required")
        .when(revise & has_text, "replacement_not_allowed").when(resolve & ~has_text, "replacement_required")
    )
    return rows.withColumn("rejected", reason)


def freshness(drafts: DataFrame, reviews: DataFrame, decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest times of a draft, and whether anything is newer than its latest review."""
    last = lambda df, name: df.groupBy("draft_id").agg(F.max("created_at").alias(name))
    joined = drafts.join(last(reviews, "review_at"), "draft_id", "left").join(last(decisions, "decision_at"), "draft_id", "left").join(last(runs, "run_at"), "draft_id", "left")
    newer = lambda c: F.coalesce(F.col(c) > F.col("review_at"), F.lit(False))
    return joined.select(
        "draft_id", "review_at", "decision_at", "run_at", newer("decision_at").alias("decided_after"), newer("run_at").alias("verified_after"),
        (F.col("review_at").isNull() | newer("decision_at") | newer("run_at")).alias("stale"),
    )
