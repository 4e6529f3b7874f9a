"""Queries that write or replace: snapshots of runs, re-extraction, review rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import duck as D
from claimloom.functions import rules, text
from claimloom.operators import history, reextract, review
from claimloom.plans.records import CLAUSES, _clauses
from claimloom.plans.workflow import RUNS, _latest
from claimloom.sources import store, views
from claimloom.sources.views import with_views


def _applied(spark, sf_dir):
    old, new = _clauses(spark, sf_dir, ";"), _clauses(spark, sf_dir, ",")
    linked = views.text_links(spark, sf_dir).filter("claim_id % 4 = 1")
    return reextract.outcomes(reextract.preview(old, new, linked, old.filter("claim_id % 3 = 0")))


def r3_claims(spark, sf_dir):
    return reextract.resulting_claims(_applied(spark, sf_dir))


def r3(spark, sf_dir):
    return reextract.counters(_applied(spark, sf_dir))


APPLIED = with_views("claims", "segments", "text_links") + "," + CLAUSES("o", ";") + "," + CLAUSES("p", ",") + """,
  ol AS (SELECT draft_id, claim_id, list(piece ORDER BY seq) AS a FROM o GROUP BY 1, 2), pl AS (SELECT claim_id, list(piece ORDER BY seq) AS b FROM p GROUP BY 1),
  ap AS (SELECT *, CASE WHEN a = b AND claim_id % 3 = 0 THEN 'skipped' WHEN a <> b AND claim_id IN (SELECT claim_id FROM text_links WHERE claim_id % 4 = 1) THEN 'blocked' WHEN a <> b THEN 'replaced' ELSE 'metadata_only' END AS outcome
    FROM ol JOIN pl USING (claim_id)),
  rs AS (SELECT draft_id, claim_id, CASE WHEN outcome = 'replaced' THEN b ELSE a END AS k FROM ap)"""
R3 = APPLIED + """ SELECT draft_id, count(*) AS assertions, count(*) FILTER (outcome = 'replaced') AS replaced, count(*) FILTER (outcome = 'metadata_only') AS metadata_only,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'blocked') AS blocked FROM ap GROUP BY draft_id"""
R3_CLAIMS = APPLIED + " SELECT draft_id, claim_id, CAST(generate_subscripts(k, 1) AS INTEGER) AS seq, unnest(k) AS piece FROM rs"


def u4(spark, sf_dir):
    """U4: the ordered claims of each assertion not extracted before, as a versioned JSON snapshot."""
    rows = _clauses(spark, sf_dir).join(views.text_links(spark, sf_dir).filter("claim_id % 5 = 0").select("claim_id"), "claim_id", "left_anti")
    entry = F.struct("seq", F.col("piece").alias("text"), text.claim_type(F.col("piece")).alias("type"))
    return rows.groupBy("claim_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("snapshot"), F.lit(1).alias("version"))


U4 = with_views("claims", "segments", "text_links") + "," + CLAUSES("u", ",") + f"""
SELECT claim_id, CAST(to_json(list(struct_pack(seq := seq, text := piece, type := {D.claim_type("piece")}) ORDER BY seq)) AS VARCHAR) AS snapshot, 1 AS version
FROM u WHERE claim_id NOT IN (SELECT claim_id FROM text_links WHERE claim_id % 5 = 0) GROUP BY claim_id"""


def s8(spark, sf_dir):
    """A run to append for each claim, with its snapshot, and the claim's status after it."""
    latest = _latest(spark, sf_dir)
    snapshot = F.to_json(F.struct("claim_id", "draft_id", F.struct("anchor", "n_support").alias("provider_output"), "flags"), {"ignoreNullFields": "false"})
    return latest.select("claim_id", "run_id", snapshot.alias("support_snapshot"), F.lit(1).alias("support_snapshot_version"), F.col("verdict").alias("support_status"))


S8 = RUNS + """ SELECT claim_id, run_id, CAST(to_json(struct_pack(claim_id := claim_id, draft_id := draft_id, provider_output := struct_pack(anchor := anchor, n_support := n_support), flags := flags)) AS VARCHAR) AS support_snapshot,
  1 AS support_snapshot_version, verdict AS support_status FROM latest"""


def _log(spark, sf_dir):
    """The runs in three batches by month, the last tried twice, as reread."""
    runs, path = views.runs(spark, sf_dir), store.new_path(spark, "runs")
    turn = F.month("created_at") % 3
    for n in (0, 1, 2, 2):
        history.append_runs(runs.filter(turn == n), path, f"batch {n}", 16)
    return store.read(spark, path, runs.schema)


def s8_log(spark, sf_dir):
    """Every run once, with the batch that brought it."""
    return _log(spark, sf_dir).select("claim_id", "run_id", "draft_id", "verdict", "confidence", F.array_join("flags", ",").alias("flags"), "anchor", "batch")


def s8_statuses(spark, sf_dir):
    """claims' statuses from the runs as appended."""
    return history.statuses(_log(spark, sf_dir))


S8_LOG = with_views("runs") + " SELECT claim_id, run_id, draft_id, verdict, confidence, array_to_string(flags, ',') AS flags, anchor, 'batch ' || (month(created_at) % 3) AS batch FROM runs"
S8_STATUSES = RUNS + " SELECT claim_id, run_id, verdict AS support_status FROM latest"


def a14(spark, sf_dir):
    """A review run's row for each draft: counts, severity and its flagged claims as JSON."""
    latest = _latest(spark, sf_dir)
    claims = review.flagged(latest).groupBy("draft_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("claim_id", "verdict")))).alias("snapshot"))
    return review.verdict_counts(latest).select("draft_id", "total_claims").join(review.flagged_counts(latest).select("draft_id", "total_flagged", "highest"), "draft_id").join(claims, "draft_id")


A14 = RUNS + """ SELECT draft_id, total_claims, count(*) AS total_flagged, ['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'][min(rank0)] AS highest,
  CAST(to_json(list(struct_pack(claim_id := claim_id, verdict := verdict) ORDER BY claim_id)) AS VARCHAR) AS snapshot
FROM flagged JOIN (SELECT draft_id, count(*) AS total_claims FROM latest GROUP BY 1) USING (draft_id) GROUP BY draft_id, total_claims"""


def d7(spark, sf_dir):
    """The first support item of a claim as a snippet of limited length."""
    s = views.segments(spark, sf_dir).select("segment_id", "raw_text")
    first = views.text_links(spark, sf_dir).join(s, "segment_id").groupBy("claim_id").agg(F.min(F.struct("link_order", "segment_id", "raw_text")).alias("f"))
    raw = F.trim("f.raw_text")
    cut = F.concat(F.rtrim(F.substring(raw, 1, rules.SNIPPET_CHARS - 3)), F.lit("..."))
    return first.select("claim_id", F.col("f.segment_id").alias("segment_id"), F.when(F.length(raw) > rules.SNIPPET_CHARS, cut).otherwise(raw).alias("snippet"))


D7 = with_views("claims", "segments", "text_links") + """,
  f AS (SELECT claim_id, segment_id, trim(raw_text, ' ') AS r FROM text_links JOIN segments USING (segment_id) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY link_order, segment_id) = 1)
SELECT claim_id, segment_id, CASE WHEN length(r) > 220 THEN rtrim(left(r, 217), ' ') || '...' ELSE r END AS snippet FROM f"""

_ALL = {
    "r3_reextraction_counters": (r3, R3), "r3_resulting_claims": (r3_claims, R3_CLAIMS), "u4_extraction_snapshots": (u4, U4), "s8_run_snapshots": (s8, S8), "s8_appended_runs": (s8_log, S8_LOG), "s8_claim_statuses": (s8_statuses, S8_STATUSES), "a14_review_rollup": (a14, A14), "d7_support_snippets": (d7, D7),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
