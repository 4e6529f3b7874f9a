"""Latest and previous rows of append-only histories, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources import store


def latest(rows: DataFrame, key: str, row_id: str, at: str = "created_at") -> DataFrame:
    """The row of each key with the greatest (at, id as text); one partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in (key, at)]
    order = F.struct(F.col(at), F.col(row_id).cast("string").alias("id_text"), *rest)
    best = rows.groupBy(key).agg(F.max(order).alias("best"))
    return best.select(key, F.col(f"best.{at}").alias(at), *[F.col(f"best.{c}").alias(c) for c in rest])


def with_previous(rows: DataFrame, key: str, row_id: str, columns) -> DataFrame:
    """The latest row of each key, with the previous row's columns as prev_<name>."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc(F.col(row_id).cast("string")))
    before = [F.lead(c).over(order).alias(f"prev_{c}") for c in (row_id, *columns)]
    return rows.select("*", *before, F.row_number().over(order).alias("rn")).filter("rn = 1").drop("rn")


def last_of(rows: DataFrame, key: str, row_id: str, n: int) -> DataFrame:
    """The last n rows of each key, the latest first, with their place."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc(F.col(row_id).cast("string")))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def change_summary(runs: DataFrame) -> DataFrame:
    """For each claim which parts of its latest run differ from the one before; none if there is none."""
    pairs = with_previous(runs, "claim_id", "run_id", ("verdict", "confidence", "flags", "categories", "anchor", "n_support", "n_excluded"))
    has = F.col("prev_run_id").isNotNull()
    differs = lambda c: has & ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    as_set = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    sets_differ = lambda c: has & (as_set(c) != as_set(f"prev_{c}"))
    parts = pairs.select(
        "*", differs("verdict").alias("verdict_changed"), differs("confidence").alias("confidence_changed"),
        F.coalesce(sets_differ("flags"), F.lit(False)).alias("flags_changed"), F.coalesce(sets_differ("categories"), F.lit(False)).alias("categories_changed"),
        differs("anchor").alias("anchor_changed"), (differs("anchor") | differs("n_support") | differs("n_excluded")).alias("support_changed"),
    )
    changed = [f"{c}_changed" for c in ("verdict", "confidence", "flags", "support", "categories")]
    return parts.withColumn("changed", F.expr(" OR ".join(changed))).withColumn("score", change_score())


def change_score() -> Column:
    """How much a claim changed."""
    weights = (("verdict", 3), ("flags", 2), ("categories", 2), ("support", 1), ("confidence", 1))
    total = F.lit(0)
    for name, weight in weights:
        total = total + F.when(F.col(f"{name}_changed"), weight).otherwise(0)
    return F.when(F.col("changed"), total).otherwise(0)


# --- fixed value: version of a run's snapshot ---
SNAPSHOT_VERSION = 1


def append_runs(runs: DataFrame, path: str, batch: str, parts: int) -> bool:
    """Adds runs (claim_id, draft_id and whatever else, support_snapshot among it) as one batch by partitions of drafts.

    Runs are never changed: a claim's status is read from them (``statuses``). False, and nothing added, where the batch is there."""
    return store.append(runs.withColumn("part", store.part_of("draft_id", parts)), path, batch, ["part"])


def statuses(runs: DataFrame) -> DataFrame:
    """claim_id, run_id, support_status: what the latest run of each claim says."""
    return latest(runs.select("claim_id", "run_id", "created_at", "verdict"), "claim_id", "run_id").select("claim_id", "run_id", F.col("verdict").alias("support_status"))
