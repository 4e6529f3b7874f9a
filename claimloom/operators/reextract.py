"""Re-extraction: what a new split of assertions into claims would change, and its application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.sources import store

# --- fixed values: version of the extraction, what keeps claims from being replaced ---
VERSION = 1
LINKS_ATTACHED = "Re-extraction cannot replace persisted claim units while support links are attached."
RUNS_ATTACHED = "Re-extraction cannot replace persisted claim units while verification runs are attached."

def _tuples(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("draft_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias(name))


def preview(persisted: DataFrame, proposed: DataFrame, linked: DataFrame, current: DataFrame) -> DataFrame:
    """draft_id, claim_id, old, new, changed, status (ready, unchanged, blocked).

    persisted, proposed: draft_id, claim_id, seq, piece; linked: claim_id of those with
    links or runs; current: claim_id of those extracted by the present version."""
    mark = lambda ids, name: ids.select("claim_id").distinct().withColumn(name, F.lit(True))
    rows = _tuples(persisted, "old").join(_tuples(proposed, "new"), ["draft_id", "claim_id"])
    rows = rows.join(mark(linked, "linked"), "claim_id", "left").join(mark(current, "current"), "claim_id", "left")
    changed = F.col("old") != F.col("new")
    status = F.when(~changed & F.col("current").isNotNull(), "unchanged").when(changed & F.col("linked").isNotNull(), "blocked").otherwise("ready")
    return rows.select("draft_id", "claim_id", "old", "new", changed.alias("changed"), status.alias("status"))


def outcomes(previewed: DataFrame) -> DataFrame:
    """With outcome: replaced, metadata_only, skipped or blocked."""
    ready = F.when(F.col("changed"), "replaced").otherwise("metadata_only")
    return previewed.withColumn("outcome", F.when(F.col("status") == "ready", ready).when(F.col("status") == "unchanged", "skipped").otherwise("blocked"))


def resulting_claims(applied: DataFrame) -> DataFrame:
    """The pieces after application: new ones where replaced, else those there were."""
    kept = F.when(F.col("outcome") == "replaced", F.col("new")).otherwise(F.col("old"))
    return applied.select("draft_id", "claim_id", F.explode(kept).alias("c")).select("draft_id", "claim_id", "c.seq", "c.piece")


def counters(applied: DataFrame) -> DataFrame:
    """A row a draft with the count of each status and outcome."""
    names = ("replaced", "metadata_only", "skipped", "blocked")
    return applied.groupBy("draft_id").agg(F.count("*").alias("assertions"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


ENTRY = "array<struct<seq: int, claim: string, claim_type: string>>"


def _entries(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    entry = F.struct(F.col("seq").cast("int").alias("seq"), "claim", "claim_type")
    return rows.groupBy("assertion_id").agg(F.array_sort(F.collect_list(entry)).alias(name), *more)


def compared(assertions: DataFrame, persisted: DataFrame, proposed: DataFrame, links: DataFrame, runs: DataFrame) -> DataFrame:
    """What a new extraction would change in each assertion.

    assertions: draft_id, assertion_id, strategy, version, has_snapshot (of the extraction on record, or nulls);
    persisted: assertion_id, claim_id, seq, claim, claim_type; proposed: as claims.narrow_claims gives it;
    links, runs: claim_id of claims with links, with runs.
    Gives draft_id, assertion_id, existing (legacy_unversioned or versioned), old, new (ordered entries, empty without claims),
    strategy (proposed; null where nothing is), changed, blocked_by (what is attached to claims that would go),
    status (ready, unchanged, blocked).

    Links and runs are reduced to a flag a claim, then an assertion, before they are joined; an assertion's entries are
    as many as its own claims."""
    flag = lambda ids, name: ids.select("claim_id").distinct().withColumn(name, F.lit(True))
    marked = persisted.join(flag(links, "linked"), "claim_id", "left").join(flag(runs, "run"), "claim_id", "left")
    old = _entries(marked, "old", F.count("linked").alias("linked"), F.count("run").alias("run"))
    new = _entries(proposed, "new", F.min("strategy").alias("proposed_strategy"))
    noted = assertions.select("draft_id", "assertion_id", "strategy", "version", "has_snapshot")
    rows = noted.join(old, "assertion_id", "left").join(new, "assertion_id", "left")
    for name in ("old", "new"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(ENTRY)))
    has_snapshot = F.coalesce("has_snapshot", F.lit(False))
    unversioned = F.col("strategy").isNull() & F.col("version").isNull() & ~has_snapshot
    rows = rows.withColumn("changed", F.col("old") != F.col("new"))
    behind = unversioned | ~F.col("strategy").eqNullSafe(F.col("proposed_strategy")) | ~F.col("version").eqNullSafe(F.lit(VERSION)) | ~has_snapshot
    reasons = F.array_compact(F.array(F.when(F.col("linked") > 0, LINKS_ATTACHED), F.when(F.col("run") > 0, RUNS_ATTACHED)))
    blocked_by = F.when(F.col("changed"), reasons).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("changed") & (F.size(blocked_by) > 0), "blocked").when(F.col("changed") | behind, "ready").otherwise("unchanged")
    existing = F.when(unversioned, "legacy_unversioned").otherwise("versioned")
    return rows.select(
        "draft_id", "assertion_id", existing.alias("existing"), "old", "new", F.col("proposed_strategy").alias("strategy"), "changed",
        blocked_by.alias("blocked_by"), status.alias("status"),
    )


def preview_counters(rows: DataFrame) -> DataFrame:
    """R2: a row a draft with its assertions by status, those that would change, and those without a version."""
    count = lambda name, on: F.count_if(on).alias(name)
    return rows.groupBy("draft_id").agg(
        F.count("*").alias("assertions"), *[count(s, F.col("status") == s) for s in ("ready", "unchanged", "blocked")],
        count("changed", F.col("changed")), count("legacy_unversioned", F.col("existing") == "legacy_unversioned"),
    )


def claims_after(applied: DataFrame) -> DataFrame:
    """draft_id, assertion_id, seq, claim, claim_type after the application."""
    kept = F.when(F.col("outcome") == "replaced", F.col("new")).otherwise(F.col("old"))
    return applied.select("draft_id", "assertion_id", F.inline(kept))


def snapshots(assertions: DataFrame, proposed: DataFrame, persisted: DataFrame) -> DataFrame:
    """U4: assertion_id, strategy, version, snapshot (JSON) of each assertion (assertion_id, text) without claims on record; others keep theirs."""
    new = assertions.select("assertion_id", "text").join(persisted.select("assertion_id").distinct(), "assertion_id", "left_anti").join(_entries(proposed, "new", F.min("strategy").alias("strategy")), "assertion_id")
    entry = lambda e: F.struct(e["seq"].alias("sequence_order"), e["claim"].alias("text"), text.matchable(e["claim"]).alias("normalized_text"), e["claim_type"].alias("claim_type"))
    body = F.struct(
        F.col("assertion_id"), F.col("text").alias("source_assertion_text"), text.matchable(F.col("text")).alias("normalized_assertion_text"),
        F.col("strategy").alias("extraction_strategy"), F.lit(VERSION).alias("extraction_version"), F.transform("new", entry).alias("claims"),
    )
    return new.select("assertion_id", "strategy", F.lit(VERSION).alias("version"), F.to_json(body).alias("snapshot"))


def write_claims(after: DataFrame, path: str, parts: int) -> None:
    """The claims of the drafts that ``after`` has in place of those on record, by partitions of drafts.

    ``after`` must hold all claims of each partition it touches: give it whole partitions."""
    store.replace(after.withColumn("part", store.part_of("draft_id", parts)), path, ["part"])
