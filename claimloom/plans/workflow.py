"""Queries on scopes, histories and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import graph, history, review, scope, verify
from claimloom.plans.evidence import EDGES
from claimloom.sources import views
from claimloom.sources.views import table, with_views


def _runs(spark, sf_dir):
    rows = views.runs(spark, sf_dir)
    return rows.withColumn("categories", review.categories_of(F.col("flags"), F.col("verdict")))


def _latest(spark, sf_dir):
    return history.latest(_runs(spark, sf_dir), "claim_id", "run_id")


def _joined(c):
    return F.array_join(c, ",").alias(c)


#: D2 for DuckDB, and the latest run of each claim
CATEGORIES = "list_filter([" + ", ".join(
    f"CASE WHEN list_has_any(flags, {list(own)!r}) THEN '{name}' END" for name, own in review.CATEGORIES
) + ", CASE WHEN verdict = 'CONTRADICTED' THEN 'contradiction' END], lambda z: z IS NOT NULL)"
RUNS = with_views("runs") + f""",
  r AS (SELECT *, {CATEGORIES} AS categories FROM runs),
  latest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC) = 1),
  sev AS (SELECT *, list_position(['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'], verdict) AS rank0 FROM latest),
  flagged AS (SELECT * FROM sev WHERE rank0 > 0)"""


def w1(spark, sf_dir):
    return _latest(spark, sf_dir).select("claim_id", "run_id", "verdict", "confidence", _joined("flags"), _joined("categories"))


W1 = RUNS + " SELECT claim_id, run_id, verdict, confidence, array_to_string(flags, ',') AS flags, array_to_string(categories, ',') AS categories FROM latest"


def w2(spark, sf_dir):
    return history.latest(views.decisions(spark, sf_dir), "claim_id", "decision_id").select("claim_id", "decision_id", "action")


W2 = with_views("decisions") + """
SELECT claim_id, decision_id, action FROM decisions QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, CAST(decision_id AS VARCHAR) DESC) = 1"""


CHANGED = ("verdict_changed", "confidence_changed", "flags_changed", "categories_changed", "anchor_changed", "support_changed", "changed")


def w9(spark, sf_dir):
    return history.change_summary(_runs(spark, sf_dir)).select("claim_id", "run_id", "prev_run_id", "prev_verdict", *CHANGED, F.col("score").cast("long").alias("score"))


W9_CTE = RUNS + """,
  pr AS (SELECT *, row_number() OVER w AS rn, lead(run_id) OVER w AS p_id, lead(verdict) OVER w AS p_v, lead(confidence) OVER w AS p_c, lead(flags) OVER w AS p_f,
      lead(categories) OVER w AS p_k, lead(anchor) OVER w AS p_a, lead(n_support) OVER w AS p_s, lead(n_excluded) OVER w AS p_x
    FROM r WINDOW w AS (PARTITION BY claim_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC)),
  ch AS (SELECT claim_id, draft_id, run_id, p_id AS prev_run_id, p_v AS prev_verdict, p_id IS NOT NULL AND verdict IS DISTINCT FROM p_v AS verdict_changed,
      p_id IS NOT NULL AND confidence IS DISTINCT FROM p_c AS confidence_changed, p_id IS NOT NULL AND list_sort(flags) <> list_sort(p_f) AS flags_changed,
      p_id IS NOT NULL AND categories <> p_k AS categories_changed, p_id IS NOT NULL AND anchor IS DISTINCT FROM p_a AS anchor_changed,
      p_id IS NOT NULL AND (anchor IS DISTINCT FROM p_a OR n_support <> p_s OR n_excluded <> p_x) AS support_changed FROM pr WHERE rn = 1),
  scored AS (SELECT *, verdict_changed OR confidence_changed OR flags_changed OR support_changed OR categories_changed AS changed,
      CAST(3 * verdict_changed::INT + 2 * flags_changed::INT + 2 * categories_changed::INT + support_changed::INT + confidence_changed::INT AS BIGINT) AS score FROM ch)"""
W9 = W9_CTE + " SELECT claim_id, run_id, prev_run_id, prev_verdict, " + ", ".join(CHANGED) + ", score FROM scored"


def w8(spark, sf_dir):
    from pyspark.sql import Window

    rows = history.change_summary(_runs(spark, sf_dir)).filter("score > 0")
    order = Window.partitionBy("draft_id").orderBy(F.desc("score"), F.desc(F.col("claim_id").cast("string")))
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("draft_id", "claim_id", F.col("score").cast("long").alias("score"), "rank")


W8 = W9_CTE + """ SELECT draft_id, claim_id, score, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, CAST(claim_id AS VARCHAR) DESC) AS INTEGER) AS rank
FROM scored WHERE score > 0 QUALIFY rank <= 5"""


def a1(spark, sf_dir):
    return review.verdict_counts(_latest(spark, sf_dir))


A1 = RUNS + " SELECT draft_id, count(*) AS total_claims, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in review.COUNTED) + " FROM latest GROUP BY draft_id"


def a2(spark, sf_dir):
    return review.flagged_counts(_latest(spark, sf_dir))


A2 = RUNS + " SELECT draft_id, count(*) AS total_flagged, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in review.SEVERITY) + ", ['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'][min(rank0)] AS highest FROM flagged GROUP BY draft_id"


def a3(spark, sf_dir):
    return review.flag_buckets(_latest(spark, sf_dir))


A3_CTE = RUNS + """, fb AS (SELECT draft_id, flag, count(*) AS claim_count, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY count(*) DESC, flag) AS INTEGER) AS rank
  FROM (SELECT draft_id, unnest(flags) AS flag FROM flagged) GROUP BY draft_id, flag)"""
A3 = A3_CTE + " SELECT * FROM fb"


def w6(spark, sf_dir):
    return review.top_risky(_latest(spark, sf_dir)).select("draft_id", "claim_id", "verdict", "rank")


W6 = RUNS + """ SELECT draft_id, claim_id, verdict, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY rank0, len(flags) DESC, coalesce(confidence, -1), claim_id) AS INTEGER) AS rank
FROM flagged QUALIFY rank <= 5"""


def a7(spark, sf_dir):
    from pyspark.sql import Window

    weak = _latest(spark, sf_dir).filter(F.array_contains("categories", "weak_support"))
    flags = F.when(F.size("flags") == 0, F.array(F.lit("weak_support"))).otherwise(F.col("flags"))
    counts = weak.select("draft_id", F.explode(flags).alias("flag")).groupBy("draft_id", "flag").agg(F.count("*").alias("claim_count"))
    order = Window.partitionBy("draft_id").orderBy(F.desc("claim_count"), "flag")
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


A7 = RUNS + """ SELECT draft_id, flag, count(*) AS claim_count, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY count(*) DESC, flag) AS INTEGER) AS rank
FROM (SELECT draft_id, unnest(flags) AS flag FROM latest WHERE list_contains(categories, 'weak_support')) GROUP BY draft_id, flag QUALIFY rank <= 5"""


def a8(spark, sf_dir):
    edges = graph.claim_edges(views.graph_claims(spark, sf_dir))
    return edges.groupBy("draft_id", "relation").agg(F.count_distinct(F.least("source_id", "target_id"), F.greatest("source_id", "target_id")).alias("pairs"))


A8 = with_views("claims") + "," + EDGES + " SELECT draft_id, relation, count(DISTINCT (least(source_id, target_id), greatest(source_id, target_id))) AS pairs FROM edges GROUP BY draft_id, relation"


def j15(spark, sf_dir):
    claims = views.graph_claims(spark, sf_dir)
    texts = claims.filter("claim_id % 11 != 0").select(F.col("claim_id").alias("target_id"), "text")
    edges = graph.claim_edges(claims).join(texts, "target_id", "left").withColumn("text", F.coalesce("text", F.lit("Unknown claim")))
    entry = F.struct("relation", "text", F.col("target_id").cast("string").alias("id"))
    return edges.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.concat_ws(":", e["relation"], e["id"])), ",").alias("related"))


J15 = with_views("claims") + "," + EDGES + """
SELECT source_id, string_agg(relation || ':' || target_id, ',' ORDER BY relation, coalesce(text, 'Unknown claim'), CAST(target_id AS VARCHAR)) AS related
FROM edges LEFT JOIN (SELECT claim_id, text FROM graph_claims WHERE claim_id % 11 <> 0) ON claim_id = target_id GROUP BY source_id"""


def a9(spark, sf_dir):
    """Each claim's distinct verdicts over all its runs, and whether another claim contradicts it."""
    verdicts = views.runs(spark, sf_dir).groupBy("claim_id").agg(F.count_distinct("verdict").alias("verdicts"), (F.count_distinct("verdict") > 1).alias("unstable"))
    edges = graph.claim_edges(views.graph_claims(spark, sf_dir)).filter("relation = 'contradicts'").select(F.col("source_id").alias("claim_id"), F.lit(True).alias("contradicted")).distinct()
    return verdicts.join(edges, "claim_id", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))


A9 = with_views("runs", "claims") + "," + EDGES + """ SELECT claim_id, count(DISTINCT verdict) AS verdicts, count(DISTINCT verdict) > 1 AS unstable,
  claim_id IN (SELECT source_id FROM edges WHERE relation = 'contradicts') AS contradicted FROM runs GROUP BY claim_id"""


def a11(spark, sf_dir):
    runs = views.runs(spark, sf_dir)
    return review.freshness(runs.select("draft_id").distinct(), views.review_runs(spark, sf_dir), views.decisions(spark, sf_dir), runs)


A11 = with_views("runs", "decisions", "review_runs") + """
SELECT draft_id, review_at, decision_at, run_at, coalesce(decision_at > review_at, false) AS decided_after, coalesce(run_at > review_at, false) AS verified_after,
  review_at IS NULL OR coalesce(decision_at > review_at, false) OR coalesce(run_at > review_at, false) AS stale
FROM (SELECT draft_id, max(created_at) AS run_at FROM runs GROUP BY 1)
LEFT JOIN (SELECT draft_id, max(created_at) AS review_at FROM review_runs GROUP BY 1) USING (draft_id)
LEFT JOIN (SELECT draft_id, max(created_at) AS decision_at FROM decisions GROUP BY 1) USING (draft_id)"""


def a16(spark, sf_dir):
    d = views.decisions(spark, sf_dir).groupBy("claim_id").agg(F.count("*").alias("n_decisions"), F.max(F.struct("created_at", F.col("decision_id").cast("string").alias("id"), "action")).alias("last"))
    rows = _latest(spark, sf_dir).join(d, "claim_id", "left")
    return rows.select("claim_id", F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"), F.col("last.action").alias("action"), "run_id", "verdict", F.col("last").isNotNull().alias("removed"))


A16 = RUNS.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + ",") + """
SELECT claim_id, count(decision_id) AS n_decisions, arg_max(action, (d.created_at, CAST(decision_id AS VARCHAR))) AS action, any_value(run_id) AS run_id, any_value(verdict) AS verdict,
  count(decision_id) > 0 AS removed
FROM latest LEFT JOIN decisions d USING (claim_id) GROUP BY claim_id"""


def j16(spark, sf_dir):
    return review.queue(_latest(spark, sf_dir), views.decisions(spark, sf_dir), F.col("draft_id") + 60)


J16 = RUNS.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + ",") + """,
  mk AS (SELECT *, claim_id IN (SELECT claim_id FROM decisions) AS done FROM flagged)
SELECT draft_id, count(*) AS total, count(*) FILTER (done) AS resolved, count(*) FILTER (NOT done) AS remaining,
  coalesce(min(claim_id) FILTER (NOT done AND claim_id > draft_id + 60), min(claim_id) FILTER (NOT done)) AS next_claim_id
FROM mk GROUP BY draft_id"""


def j16_rows(spark, sf_dir):
    return review.queue_rows(_latest(spark, sf_dir), views.decisions(spark, sf_dir))


J16_ROWS = RUNS.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + ",") + """,
  mk AS (SELECT draft_id, claim_id, verdict, CASE WHEN claim_id IN (SELECT claim_id FROM decisions) THEN 'resolved' ELSE 'active' END AS state FROM flagged)
SELECT *, CAST(row_number() OVER (PARTITION BY draft_id, state ORDER BY claim_id) AS INTEGER) AS place FROM mk"""


def w3_reviews(spark, sf_dir):
    return history.last_of(views.review_runs(spark, sf_dir), "draft_id", "review_id", 2)


W3_REVIEWS = with_views("review_runs") + """
SELECT *, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY created_at DESC, CAST(review_id AS VARCHAR) DESC) AS INTEGER) AS place FROM review_runs QUALIFY place <= 2"""


def d6(spark, sf_dir):
    return review.validated(views.decisions(spark, sf_dir))


D6 = with_views("decisions") + """, cl AS (SELECT decision_id, claim_id, action, nullif(trim(note), '') AS note, nullif(trim(replacement), '') AS replacement FROM decisions)
SELECT *, CASE WHEN action = 'ACKNOWLEDGE_RISK' AND replacement IS NOT NULL THEN 'replacement_not_allowed' WHEN action = 'MARK_FOR_REVISION' AND note IS NULL THEN 'note_required'
  WHEN action = 'MARK_FOR_REVISION' AND replacement IS NOT NULL THEN 'replacement_not_allowed' WHEN action = 'RESOLVE_WITH_EDIT' AND replacement IS NULL THEN 'replacement_required' END AS rejected
FROM cl"""


def d3(spark, sf_dir):
    """Refined verdicts and their ceilings: the latest run's verdict is refined to the claim's strongest."""
    runs = _runs(spark, sf_dir)
    best = runs.groupBy("claim_id").agg(F.max(F.struct(verify.strength_of(F.col("verdict")).alias("s"), "verdict"))["verdict"].alias("refined"))
    role = lambda i: F.when((F.col("run_id") + i) % 3 == 0, "substantive").otherwise("contextual")
    roles = F.when(F.col("n_support") > 0, F.transform(F.sequence(F.lit(1), F.col("n_support")), role)).otherwise(F.array().cast("array<string>"))
    rows = _latest(spark, sf_dir).join(best, "claim_id")
    blocked = F.arrays_overlap("flags", F.array(*map(F.lit, verify.BLOCKING)))
    return rows.select("claim_id", "refined", F.when(blocked, F.col("verdict")).otherwise(verify.capped(F.col("refined"), F.col("flags"), roles)).alias("verdict"))


D3 = RUNS + """,
  sg AS (SELECT claim_id, verdict, CASE verdict WHEN 'SUPPORTED' THEN 4 WHEN 'PARTIALLY_SUPPORTED' THEN 3 WHEN 'AMBIGUOUS' THEN 2 WHEN 'OVERSTATED' THEN 2 WHEN 'UNVERIFIED' THEN 0 ELSE 1 END AS s FROM r),
  st AS (SELECT claim_id, s, verdict AS refined FROM sg QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY s DESC, verdict DESC) = 1),
  ro AS (SELECT claim_id, verdict, flags, refined, s, n_support > 0 AND len([i FOR i IN range(1, n_support + 1) IF (run_id + i) % 3 = 0]) = 0 AS contextual FROM latest JOIN st USING (claim_id))
SELECT claim_id, refined, CASE WHEN list_has_any(flags, ['missing_citation', 'invalid_anchor', 'quote_mismatch_placeholder']) THEN verdict
  WHEN s > 2 AND (contextual OR list_has_any(flags, ['subject_mismatch', 'knowledge_escalation', 'causation_escalation', 'contextual_support_only'])) THEN 'AMBIGUOUS'
  WHEN s > 3 AND list_has_any(flags, ['absolute_qualifier_mismatch', 'temporal_scope_mismatch', 'narrow_support']) THEN 'PARTIALLY_SUPPORTED' ELSE refined END AS verdict
FROM ro"""


def j5(spark, sf_dir):
    return scope.revalidated(views.support_links(spark, sf_dir), views.claim_scope(spark, sf_dir), views.segment_scope(spark, sf_dir), views.bundle_documents(spark, sf_dir))


J5_CTE = with_views("support_links", "claim_scope", "segment_scope", "bundle_documents") + """,
  checked AS (SELECT l.*, CASE WHEN c.claim_id IS NULL THEN 'missing_claim_support_link' WHEN s.segment_id IS NULL THEN 'missing_segment_support_link'
      WHEN c.matter <> s.matter THEN 'cross_matter_support_link' WHEN c.bundle IS NOT NULL AND b.doc_id IS NULL THEN 'out_of_scope_support_link' END AS code
    FROM support_links l LEFT JOIN claim_scope c USING (claim_id) LEFT JOIN segment_scope s USING (segment_id)
    LEFT JOIN bundle_documents b ON b.bundle = c.bundle AND b.doc_id = s.doc_id)"""
J5 = J5_CTE + " SELECT * FROM checked"


def a12(spark, sf_dir):
    return scope.excluded_summary(j5(spark, sf_dir))


A12 = J5_CTE + """, k AS (SELECT claim_id, code, count(*) AS n FROM checked WHERE code IS NOT NULL GROUP BY claim_id, code)
SELECT claim_id, CAST(sum(n) AS BIGINT) AS excluded, 'Excluded links: ' || string_agg(code || '=' || n, ', ' ORDER BY code || '=' || n) || '.' AS sentence FROM k GROUP BY claim_id"""


def j3(spark, sf_dir):
    drafts = views.claim_scope(spark, sf_dir).select("draft_id", "matter", "bundle").distinct()
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment_id"), F.round(F.col("s_acctbal") / 1000).alias("created_at"), F.col("s_name").alias("name"))
    documents = views.segment_scope(spark, sf_dir).join(files, "segment_id")
    return scope.ordered_documents(drafts, views.bundle_documents(spark, sf_dir), documents)


J3 = with_views("claim_scope", "segment_scope", "bundle_documents") + """, d AS (SELECT DISTINCT draft_id, matter, bundle FROM claim_scope),
  a AS (SELECT draft_id, doc_id FROM d JOIN bundle_documents USING (bundle) UNION SELECT draft_id, doc_id FROM d JOIN segment_scope USING (matter) WHERE bundle IS NULL)
SELECT draft_id, doc_id, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY round(s_acctbal / 1000), s_name, doc_id) AS INTEGER) AS place FROM a JOIN supplier ON doc_id = s_suppkey"""


def j6(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("segment_id"), F.col("l_linenumber").alias("order"))
    existing = views.support_links(spark, sf_dir).filter("segment_id % 3 = 0").select("claim_id", "segment_id", "seq")
    return scope.new_links(requests, existing)


J6 = with_views("support_links") + """,
  ex AS (SELECT claim_id, segment_id, seq FROM support_links WHERE segment_id % 3 = 0),
  rq AS (SELECT l_orderkey AS claim_id, l_suppkey AS segment_id, min(l_linenumber) AS o FROM lineitem GROUP BY ALL),
  nw AS (SELECT * FROM rq ANTI JOIN ex USING (claim_id, segment_id))
SELECT claim_id, segment_id, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY claim_id ORDER BY o, segment_id) AS BIGINT) AS seq
FROM nw LEFT JOIN (SELECT claim_id, max(seq) AS last FROM ex GROUP BY 1) USING (claim_id)"""


def w5(spark, sf_dir):
    return scope.context_windows(views.segments(spark, sf_dir)).select("segment_id", F.array_join("near", ",").alias("near"))


W5 = with_views("segments") + """, o AS (SELECT *, lag(segment_id) OVER w AS a, lead(segment_id) OVER w AS z FROM segments
  WINDOW w AS (PARTITION BY doc_id ORDER BY CASE WHEN anchored THEN 0 ELSE 1 END, line_no, segment_id))
SELECT segment_id, concat_ws(',', a, segment_id, z) AS near FROM o"""


def w4(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("draft_id").orderBy(F.when(F.col("item_id") % 7 != 0, F.col("item_id")).asc_nulls_last(), F.col("seq").asc_nulls_last(), "claim_id")
    return views.claims(spark, sf_dir).select("draft_id", "claim_id", F.row_number().over(order).alias("place"))


W4 = with_views("claims") + """
SELECT draft_id, claim_id, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY CASE WHEN item_id % 7 <> 0 THEN item_id END NULLS LAST, seq NULLS LAST, claim_id) AS INTEGER) AS place FROM claims"""


def p3(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    top = review.flag_buckets(latest).filter("rank <= 3").groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("rank", "flag", "claim_count"))).alias("top"))
    rows = review.verdict_counts(latest).select("draft_id", "total_claims").join(review.flagged_counts(latest), "draft_id", "left").join(top, "draft_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    buckets = F.concat(F.lit("Review buckets: "), F.concat_ws(", ", *[F.concat(F.lit(f"{v.lower()}="), n(v.lower())) for v in review.SEVERITY]), F.lit("."))
    common = F.array_join(F.transform("top", lambda t: F.concat_ws("=", t["flag"], t["claim_count"])), ", ")
    return rows.select("draft_id", F.concat_ws(
        " ", F.concat(F.lit("Draft "), F.col("draft_id").cast("string"), F.lit(" review summary.")), F.concat(F.lit("Total claims: "), n("total_claims"), F.lit(".")),
        F.concat(F.lit("Flagged claims: "), n("total_flagged"), F.lit(".")), buckets, F.concat(F.lit("Highest severity: "), F.lower("highest"), F.lit(".")),
        F.concat(F.lit("Top issue categories: "), F.array_join("top.flag", ", "), F.lit(".")), F.concat(F.lit("Common flags: "), common, F.lit(".")),
    ).alias("summary"))


P3 = A3_CTE + """,
  n AS (SELECT draft_id, count(*) AS t FROM latest GROUP BY 1),
  f AS (SELECT draft_id, count(*) AS t, 'Review buckets: unsupported=' || count(*) FILTER (rank0 = 1) || ', overstated=' || count(*) FILTER (rank0 = 2) || ', ambiguous=' || count(*) FILTER (rank0 = 3)
    || ', unverified=' || count(*) FILTER (rank0 = 4) || '.' AS b, lower(['UNSUPPORTED', 'OVERSTATED', 'AMBIGUOUS', 'UNVERIFIED'][min(rank0)]) AS h FROM flagged GROUP BY 1),
  g AS (SELECT draft_id, string_agg(flag, ', ' ORDER BY rank) AS c, string_agg(flag || '=' || claim_count, ', ' ORDER BY rank) AS m FROM fb WHERE rank <= 3 GROUP BY 1)
SELECT draft_id, concat_ws(' ', 'Draft ' || draft_id || ' review summary.', 'Total claims: ' || n.t || '.', 'Flagged claims: ' || coalesce(f.t, 0) || '.',
  coalesce(b, 'Review buckets: unsupported=0, overstated=0, ambiguous=0, unverified=0.'), 'Highest severity: ' || h || '.', 'Top issue categories: ' || c || '.', 'Common flags: ' || m || '.') AS summary
FROM n LEFT JOIN f USING (draft_id) LEFT JOIN g USING (draft_id)"""

_ALL = {
    "w1_latest_runs": (w1, W1), "w2_latest_decisions": (w2, W2), "w4_draft_sequence": (w4, W4), "w5_context_window": (w5, W5), "w6_top_risky": (w6, W6),
    "w8_most_unstable": (w8, W8), "w9_change_summary": (w9, W9), "a1_verdict_counts": (a1, A1), "a2_flagged_counts": (a2, A2), "a3_flag_buckets": (a3, A3),
    "a7_weak_clusters": (a7, A7), "a8_pair_counts": (a8, A8), "a9_instability": (a9, A9), "a11_freshness": (a11, A11), "a12_excluded_links": (a12, A12),
    "a16_review_state": (a16, A16), "j3_allowed_documents": (j3, J3), "j5_link_revalidation": (j5, J5), "j6_new_links": (j6, J6), "j15_relationships": (j15, J15),
    "j16_review_queue": (j16, J16), "j16_queue_rows": (j16_rows, J16_ROWS), "w3_last_reviews": (w3_reviews, W3_REVIEWS), "d3_capped_verdicts": (d3, D3), "d6_decision_rules": (d6, D6), "p3_review_summary": (p3, P3),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
