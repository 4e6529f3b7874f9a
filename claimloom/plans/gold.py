"""Queries that hold results against a gold of earlier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import duck as D
from claimloom.functions import text
from claimloom.operators import gold, history
from claimloom.plans.records import CLAUSES, _clauses
from claimloom.plans.workflow import RUNS, _runs
from claimloom.sources.views import with_views


def _pieces(spark, sf_dir, sign):
    rows = _clauses(spark, sf_dir, sign).withColumn("type", text.claim_type(F.col("piece")))
    found = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "type"))).alias("t"))
    of = lambda c: F.transform("t", lambda x: x[c])
    return found.select(F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("case"), "claim_id", of("piece").alias("texts"), of("type").alias("types"))


def results(spark, sf_dir):
    """Claims cut at commas against those cut at "and", less some on either side; runs before the last one against the last."""
    mine = _pieces(spark, sf_dir, ",").filter("claim_id % 17 != 3").withColumn("category", F.concat(F.lit("turn"), (F.col("claim_id") % 5).cast("string")))
    cut = gold.extraction(mine, _pieces(spark, sf_dir, r"\band\b").filter("claim_id % 19 != 4"))
    last = history.with_previous(_runs(spark, sf_dir), "claim_id", "run_id", ("flags", "verdict", "anchor", "n_support")).filter("prev_run_id IS NOT NULL")
    case = F.concat(F.lit("r"), F.col("claim_id").cast("string")).alias("case")
    category = F.concat(F.lit("claim"), (F.col("claim_id") % 4).cast("string")).alias("category")
    role = lambda n: F.transform(F.sequence(F.lit(0), F.col(n).cast("int")), lambda i: F.when(i == 0, "primary").otherwise("secondary"))
    place = lambda n: F.transform(F.sequence(F.lit(0), F.col(n).cast("int")), lambda i: F.concat(F.lit("p."), i.cast("string")))
    side = lambda p: (F.col(f"{p}flags").alias("flags"), F.col(f"{p}verdict").alias("verdict"), F.col(f"{p}anchor").alias("primary_anchor"), role(f"{p}n_support").alias("roles"), place(f"{p}n_support").alias("anchors"))
    before, after = last.select(case, category, *side("prev_")), last.select(case, *side(""))
    return cut.unionByName(gold.heuristics(before, after)).unionByName(gold.provider(before, after))


def a15_cases(spark, sf_dir):
    return results(spark, sf_dir).withColumn("kinds", F.array_join("kinds", ","))


def a15_suites(spark, sf_dir):
    return gold.suites(results(spark, sf_dir))


def a15_failures(spark, sf_dir):
    return gold.failures(results(spark, sf_dir))


_beyond = lambda a, b: f"coalesce(nullif(array_to_string([{a}[i] FOR i IN range(1, coalesce(len({a}), 0) + 1) IF len([1 FOR j IN range(1, i + 1) IF {a}[j] = {a}[i]]) > len([1 FOR y IN coalesce({b}, []) IF y = {a}[i]])], ', '), ''), '')"
_less = lambda a, b: f"array_to_string(list_sort([x FOR x IN {a} IF NOT list_contains({b}, x)]), ', ')"
_T = lambda name: f"{name}t AS (SELECT claim_id, list(piece ORDER BY seq) AS texts, list({D.claim_type('piece')} ORDER BY seq) AS types FROM {name} GROUP BY 1)"
RESULTS = with_views("claims", "segments", "text_links") + "," + CLAUSES("u", ",") + "," + CLAUSES("w", r"\band\b") + f",{_T('u')},{_T('w')}," + RUNS.removeprefix("WITH RECURSIVE") + f""",
  x0 AS (SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, a.claim_id IS NOT NULL AS mine, b.claim_id IS NOT NULL AS theirs, a.texts AS t, b.texts AS bt, a.types AS y, b.types AS byy
    FROM (SELECT * FROM ut WHERE claim_id % 17 <> 3) a FULL JOIN (SELECT * FROM wt WHERE claim_id % 19 <> 4) b USING (claim_id)),
  x1 AS (SELECT 'extraction' AS suite, 'c' || claim_id AS "case", CASE WHEN mine THEN 'turn' || (claim_id % 5) END AS category,
    CASE WHEN NOT theirs THEN ['missing_case'] WHEN NOT mine THEN ['unexpected_case'] ELSE list_filter([CASE WHEN t <> bt THEN 'extraction_text_mismatch' END, CASE WHEN y <> byy THEN 'claim_type_mismatch' END], lambda z: z IS NOT NULL) END AS kinds,
    'lacks [' || {_beyond("t", "bt")} || '], adds [' || {_beyond("bt", "t")} || ']' AS said FROM x0),
  h0 AS (SELECT claim_id, row_number() OVER w AS rn, flags AS f1, verdict AS v1, anchor AS a1, n_support AS s1, lead(run_id) OVER w AS p, lead(flags) OVER w AS f0, lead(verdict) OVER w AS v0, lead(anchor) OVER w AS a0, lead(n_support) OVER w AS s0
    FROM r WINDOW w AS (PARTITION BY claim_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC)),
  h AS (SELECT * FROM h0 WHERE rn = 1 AND p IS NOT NULL),
  x2 AS (SELECT 'verification_heuristics' AS suite, 'r' || claim_id AS "case", 'claim' || (claim_id % 4) AS category,
    list_filter([CASE WHEN NOT list_has_all(f1, f0) THEN 'missing_heuristic_flags' END, CASE WHEN NOT list_has_all(f0, f1) THEN 'unexpected_heuristic_flags' END, CASE WHEN v0 <> v1 THEN 'verdict_mismatch' END], lambda z: z IS NOT NULL) AS kinds,
    'lacks [' || {_less("f0", "f1")} || '], adds [' || {_less("f1", "f0")} || '], ' || v0 || ' became ' || v1 AS said FROM h),
  x3 AS (SELECT 'verification_provider' AS suite, 'r' || claim_id AS "case", 'claim' || (claim_id % 4) AS category,
    list_filter([CASE WHEN v0 <> v1 THEN 'verdict_mismatch' END, CASE WHEN a0 IS DISTINCT FROM a1 THEN 'primary_anchor_mismatch' END, CASE WHEN s0 <> s1 THEN 'support_role_mismatch' END, CASE WHEN s0 <> s1 THEN 'support_anchor_order_mismatch' END], lambda z: z IS NOT NULL) AS kinds,
    v0 || ' became ' || v1 || '; ' || coalesce(a0, 'none') || ' became ' || coalesce(a1, 'none') AS said FROM h),
  results AS (SELECT *, CASE WHEN len(kinds) > 0 THEN said END AS details FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3))"""
A15_CASES = RESULTS + """ SELECT suite, "case", category, array_to_string(kinds, ',') AS kinds, details FROM results"""
A15_SUITES = RESULTS + " SELECT suite, category, count(*) AS cases, count(*) FILTER (len(kinds) = 0) AS passed, count(*) FILTER (len(kinds) > 0) AS failed FROM results GROUP BY ALL"
A15_FAILURES = RESULTS + " SELECT suite, category, kind, count(*) AS failures FROM (SELECT suite, category, unnest(kinds) AS kind FROM results) GROUP BY ALL"

QUERIES = {"a15_gold_cases": a15_cases, "a15_gold_suites": a15_suites, "a15_gold_kinds": a15_failures}
SQL = {"a15_gold_cases": A15_CASES, "a15_gold_suites": A15_SUITES, "a15_gold_kinds": A15_FAILURES}
