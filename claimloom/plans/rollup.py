"""Queries on what a review keeps of drafts and shows of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import graph, rollup
from claimloom.plans.evidence import EDGES
from claimloom.plans.workflow import A3_CTE, W9_CTE, _latest, _runs
from claimloom.sources import views


def _claims(spark, sf_dir):
    """Claims with runs, some of them taken again for unverified ones without."""
    run = views.runs(spark, sf_dir).select("claim_id", "draft_id").distinct()
    return run.unionByName(run.select((F.col("claim_id") + 10_000_000).alias("claim_id"), "draft_id").filter("claim_id % 3 = 0")).withColumn("support_status", F.lit("UNVERIFIED"))


def _snapshots(spark, sf_dir):
    return rollup.claim_snapshots(_claims(spark, sf_dir), _latest(spark, sf_dir))


def a14_claims(spark, sf_dir):
    rows = _snapshots(spark, sf_dir)
    return rows.withColumn("flags", F.array_join("flags", ",")).withColumn("categories", F.array_join("categories", ","))


def a14_summaries(spark, sf_dir):
    rows = rollup.review_summaries(_snapshots(spark, sf_dir), views.decisions(spark, sf_dir))
    return rows.withColumn("top_issue_categories", F.array_join("top_issue_categories", ","))


def _recorded(spark, sf_dir):
    """``_claims``, and the claims of the graph besides: they have relationships, most of them no run."""
    own = _claims(spark, sf_dir).select("claim_id", "support_status")
    others = views.graph_claims(spark, sf_dir).select("claim_id").distinct().join(own, "claim_id", "left_anti")
    return own.unionByName(others.withColumn("support_status", F.lit("UNVERIFIED")))


def p4_records(spark, sf_dir):
    return rollup.claim_records(_recorded(spark, sf_dir), _runs(spark, sf_dir), views.decisions(spark, sf_dir), graph.claim_edges(views.graph_claims(spark, sf_dir)))


def p4_timeline(spark, sf_dir):
    return rollup.claim_timeline(views.runs(spark, sf_dir), views.decisions(spark, sf_dir), graph.claim_edges(views.graph_claims(spark, sf_dir)))


CLAIMS = """
  rc AS (SELECT DISTINCT claim_id, draft_id FROM runs), every AS (SELECT * FROM rc UNION ALL SELECT * FROM (SELECT claim_id + 10000000 AS claim_id, draft_id FROM rc) WHERE claim_id % 3 = 0)"""
SNAPSHOTS = A3_CTE.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + ",") + f""",{CLAIMS},
  sn AS (SELECT e.draft_id, claim_id, coalesce(verdict, 'UNVERIFIED') AS verdict, confidence, coalesce(flags, []) AS flags, coalesce(categories, []) AS categories, anchor AS primary_anchor,
    CAST(coalesce(n_support, 0) AS BIGINT) AS support_assessment_count, CAST(coalesce(n_excluded, 0) AS BIGINT) AS excluded_link_count, run_id AS latest_run_id FROM every e LEFT JOIN latest USING (claim_id))"""
A14_CLAIMS = SNAPSHOTS + " SELECT * REPLACE (array_to_string(flags, ',') AS flags, array_to_string(categories, ',') AS categories) FROM sn"
A14_SUMMARIES = SNAPSHOTS + """,
  rk AS (SELECT *, list_position(['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'], verdict) AS sv, claim_id IN (SELECT claim_id FROM decisions) AS done FROM sn),
  tp AS (SELECT draft_id, string_agg(flag, ',' ORDER BY rank) AS t FROM fb WHERE rank <= 3 GROUP BY 1)
SELECT draft_id, count(*) AS total_claims, count(*) FILTER (sv > 0) AS total_flagged, count(*) FILTER (sv = 1) AS unsupported, count(*) FILTER (sv = 2) AS overstated, count(*) FILTER (sv = 3) AS ambiguous,
  count(*) FILTER (sv = 4) AS unverified, count(*) FILTER (sv > 0 AND done) AS resolved, count(*) FILTER (sv > 0 AND NOT done) AS remaining,
  ['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'][min(sv)] AS highest_severity, coalesce(any_value(t), '') AS top_issue_categories FROM rk LEFT JOIN tp USING (draft_id) GROUP BY draft_id"""
RECORDS = W9_CTE.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + "," + views.SQL["claims"] + "," + EDGES + ",")
_F = lambda *names: ", ".join(f"coalesce({n}, false) AS {n}" for n in names)
P4_RECORDS = RECORDS + f""",{CLAIMS},
  recorded AS (SELECT claim_id FROM every UNION ALL SELECT DISTINCT claim_id FROM graph_claims g WHERE NOT EXISTS (SELECT 1 FROM every WHERE every.claim_id = g.claim_id)),
  dl AS (SELECT claim_id, count(*) AS n, max(created_at) AS newest FROM decisions GROUP BY 1),
  da AS (SELECT claim_id, action FROM decisions QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, CAST(decision_id AS VARCHAR) DESC) = 1),
  rl AS (SELECT source_id AS claim_id, count(*) AS n, bool_or(relation = 'contradicts') AS contradicted FROM edges GROUP BY 1),
  rn AS (SELECT claim_id, count(*) AS n, count(DISTINCT verdict) > 1 AS unstable FROM runs GROUP BY 1)
SELECT e.claim_id, CASE WHEN action IS NULL THEN 'active' ELSE 'resolved' END AS disposition, coalesce(l.verdict, 'UNVERIFIED') AS latest_verdict, c.run_id AS latest_run_id, c.prev_run_id AS previous_run_id, c.prev_verdict AS previous_verdict,
  {_F("verdict_changed", "confidence_changed", "anchor_changed", "flags_changed", "categories_changed", "support_changed")}, coalesce(changed, false) AS changed_since_last_run,
  coalesce(rn.n, 0) AS runs, coalesce(unstable, false) AS unstable, newest AS latest_decision_at, action AS latest_action, coalesce(dl.n, 0) AS decisions, coalesce(rl.n, 0) AS relationships, coalesce(contradicted, false) AS contradicted
FROM recorded e LEFT JOIN scored c USING (claim_id) LEFT JOIN latest l USING (claim_id) LEFT JOIN dl USING (claim_id) LEFT JOIN da USING (claim_id) LEFT JOIN rl USING (claim_id) LEFT JOIN rn USING (claim_id)"""
P4_TIMELINE = RECORDS + """ SELECT claim_id, 'run' AS part, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC) AS INTEGER) AS place, run_id AS ref_id, verdict AS told FROM runs
UNION ALL SELECT claim_id, 'decision', row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, CAST(decision_id AS VARCHAR) DESC), decision_id, action FROM decisions
UNION ALL SELECT source_id, 'relationship', row_number() OVER (PARTITION BY source_id ORDER BY relation, target_id), target_id, relation FROM edges"""

QUERIES = {"a14_claim_snapshots": a14_claims, "a14_review_summaries": a14_summaries, "p4_claim_records": p4_records, "p4_claim_timeline": p4_timeline}
SQL = {"a14_claim_snapshots": A14_CLAIMS, "a14_review_summaries": A14_SUMMARIES, "p4_claim_records": P4_RECORDS, "p4_claim_timeline": P4_TIMELINE}
