"""What a review run keeps of a draft, and what is shown of a claim's history.

Parts that may be many (a draft's claims, a claim's runs, decisions and relationships) are rows in order
of their place, not arrays: a sort that spills holds a claim with a third of all runs, an array doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import history, review

TOP = 3


def claim_snapshots(claims: DataFrame, latest: DataFrame) -> DataFrame:
    """Each claim of a draft (draft_id, claim_id, support_status) with what its latest run says; its own status and nothing else without one."""
    none = F.array().cast("array<string>")
    run = latest.select("claim_id", F.col("run_id").alias("latest_run_id"), "verdict", "confidence", "flags", "categories", "anchor", "n_support", "n_excluded")
    rows = claims.select("draft_id", "claim_id", "support_status").join(run, "claim_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return rows.select(
        "draft_id", "claim_id", F.coalesce("verdict", "support_status").alias("verdict"), "confidence", F.coalesce("flags", none).alias("flags"),
        F.coalesce("categories", none).alias("categories"), F.col("anchor").alias("primary_anchor"), zero("n_support", "support_assessment_count"),
        zero("n_excluded", "excluded_link_count"), "latest_run_id",
    )


def review_summaries(snapshots: DataFrame, decided: DataFrame) -> DataFrame:
    """A row a draft: its claims, the flagged ones by verdict, the highest severity (null where none is flagged), the commonest
    flags (TOP of them), and how many flagged claims a decision has resolved.

    snapshots: ``claim_snapshots``; decided: claim_id of claims with a decision."""
    all_of = snapshots.groupBy("draft_id").agg(F.count("*").alias("total_claims"))
    counts = review.flagged_counts(snapshots)
    top = review.flag_buckets(snapshots).filter(F.col("rank") <= TOP).groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "flag"))), lambda x: x["flag"]).alias("top_issue_categories"))
    state = review.queue(snapshots, decided).select("draft_id", "resolved", "remaining")
    rows = all_of.join(counts, "draft_id", "left").join(top, "draft_id", "left").join(state, "draft_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_flagged", *[v.lower() for v in review.SEVERITY], "resolved", "remaining")]
    return rows.select("draft_id", "total_claims", *zero, F.col("highest").alias("highest_severity"), F.coalesce("top_issue_categories", F.array().cast("array<string>")).alias("top_issue_categories"))


def claim_records(claims: DataFrame, runs: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a claim (claim_id, support_status): disposition, latest decision, what changed since the run before, relationships and contradictions.

    runs with categories, decisions: as the views have them; edges: source_id, relation. Each side is one row a claim before it is joined."""
    change = history.change_summary(runs).select(
        "claim_id", F.col("run_id").alias("latest_run_id"), F.col("prev_run_id").alias("previous_run_id"), F.col("verdict").alias("latest_verdict"), F.col("prev_verdict").alias("previous_verdict"),
        *[f"{c}_changed" for c in ("verdict", "confidence", "anchor", "flags", "categories", "support")], F.col("changed").alias("changed_since_last_run"),
    )
    verdicts = runs.groupBy("claim_id").agg(F.count("*").alias("runs"), (F.count_distinct("verdict") > 1).alias("unstable"))
    decided = history.latest(decisions, "claim_id", "decision_id").select("claim_id", F.col("created_at").alias("latest_decision_at"), F.col("action").alias("latest_action"))
    n_decisions = decisions.groupBy("claim_id").agg(F.count("*").alias("decisions"))
    related = edges.groupBy(F.col("source_id").alias("claim_id")).agg(F.count("*").alias("relationships"), F.bool_or(F.col("relation") == "contradicts").alias("contradicted"))
    rows = claims.select("claim_id", "support_status")
    for side in (change, verdicts, decided, n_decisions, related):
        rows = rows.join(side, "claim_id", "left")
    filled = {**dict.fromkeys(("runs", "decisions", "relationships"), 0), **dict.fromkeys([c for c in rows.columns if c.endswith("_changed") or c in ("changed_since_last_run", "unstable", "contradicted")], False)}
    disposition = F.when(F.col("latest_action").isNotNull(), "resolved").otherwise("active").alias("disposition")
    latest = F.coalesce("latest_verdict", "support_status").alias("latest_verdict")
    return rows.select("claim_id", disposition, latest, *[F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in rows.columns if c not in ("claim_id", "support_status", "latest_verdict")])


def claim_timeline(runs: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, part (run, decision or relationship), place, ref_id, told: what ``claim_records`` counts, the newest first, relationships by kind and claim."""
    recent = lambda ref: Window.partitionBy("claim_id").orderBy(F.desc("created_at"), F.desc(F.col(ref).cast("string")))
    line = lambda rows, part, ref, order, told: rows.select("claim_id", F.lit(part).alias("part"), F.row_number().over(order).alias("place"), F.col(ref).alias("ref_id"), told.alias("told"))
    related = edges.withColumnRenamed("source_id", "claim_id")
    return (
        line(runs, "run", "run_id", recent("run_id"), F.col("verdict"))
        .unionByName(line(decisions, "decision", "decision_id", recent("decision_id"), F.col("action")))
        .unionByName(line(related, "relationship", "target_id", Window.partitionBy("claim_id").orderBy("relation", "target_id"), F.col("relation")))
    )
