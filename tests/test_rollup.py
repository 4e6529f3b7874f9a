from datetime import datetime

from pyspark.sql import functions as F

from claimloom.operators import rollup
from claimloom.plans import rollup as queries
from claimloom.sources import views

RUNS = "claim_id long, run_id long, created_at timestamp, draft_id long, verdict string, confidence double, flags array<string>, categories array<string>, anchor string, n_support long, n_excluded long"
DAY = lambda n: datetime(2024, 1, n)


def tables(spark):
    claims = spark.createDataFrame([(1, 1, "UNVERIFIED"), (1, 2, "UNVERIFIED"), (1, 3, "SUPPORTED"), (2, 4, "SUPPORTED")], "draft_id long, claim_id long, support_status string")
    runs = spark.createDataFrame(
        [
            (1, 9, DAY(1), 1, "SUPPORTED", 0.8, ["b"], [], "p.1", 1, 0), (1, 10, DAY(1), 1, "SUPPORTED", 0.7, ["a"], [], None, 1, 0), (1, 11, DAY(2), 1, "UNSUPPORTED", 0.7, ["a", "c"], ["k"], None, 1, 2),
            (3, 20, DAY(3), 1, "AMBIGUOUS", None, [], [], "p.2", 0, 0),
        ], RUNS,
    )
    decisions = spark.createDataFrame([(5, 1, DAY(1), "FIRST"), (6, 1, DAY(1), "LAST")], "decision_id long, claim_id long, created_at timestamp, action string")
    edges = spark.createDataFrame([(1, 2, "supports"), (1, 3, "contradicts"), (3, 1, "contradicts")], "source_id long, target_id long, relation string")
    return claims, runs, decisions, edges


def test_review_of_a_draft(spark):
    claims, runs, decisions, _ = tables(spark)
    # run 9 sorts after 10 and 11 as text, so it is the latest of the first day's only
    latest = runs.filter("run_id IN (11, 20)")
    snaps = {r["claim_id"]: r for r in rollup.claim_snapshots(claims, latest).collect()}
    assert [(k, snaps[k]["verdict"], snaps[k]["flags"], snaps[k]["excluded_link_count"], snaps[k]["latest_run_id"]) for k in (1, 2, 3, 4)] == [
        (1, "UNSUPPORTED", ["a", "c"], 2, 11), (2, "UNVERIFIED", [], 0, None), (3, "AMBIGUOUS", [], 0, 20), (4, "SUPPORTED", [], 0, None)]
    rows = {r["draft_id"]: r for r in rollup.review_summaries(rollup.claim_snapshots(claims, latest), decisions).collect()}
    one = rows[1]
    assert (one["total_claims"], one["total_flagged"], one["unsupported"], one["ambiguous"], one["unverified"], one["resolved"], one["remaining"], one["highest_severity"]) == (3, 3, 1, 1, 1, 1, 2, "UNSUPPORTED")
    assert one["top_issue_categories"] == ["a", "c"]
    assert (rows[2]["total_claims"], rows[2]["total_flagged"], rows[2]["highest_severity"], rows[2]["top_issue_categories"]) == (1, 0, None, [])


def test_history_of_a_claim(spark):
    claims, runs, decisions, edges = tables(spark)
    rows = {r["claim_id"]: r for r in rollup.claim_records(claims, runs, decisions, edges).collect()}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one["disposition"], one["latest_action"], one["latest_run_id"], one["previous_run_id"], one["previous_verdict"]) == ("resolved", "LAST", 11, 9, "SUPPORTED")
    assert (one["runs"], one["decisions"], one["relationships"], one["contradicted"], one["unstable"], one["changed_since_last_run"]) == (3, 2, 2, True, True, True)
    assert (two["disposition"], two["latest_verdict"], two["runs"], two["changed_since_last_run"], two["contradicted"]) == ("active", "UNVERIFIED", 0, False, False)
    assert (three["latest_verdict"], three["previous_run_id"], three["unstable"], three["contradicted"]) == ("AMBIGUOUS", None, False, True)
    line = [(r["part"], r["place"], r["ref_id"]) for r in rollup.claim_timeline(runs, decisions, edges).filter("claim_id = 1").collect()]
    assert sorted(line) == [("decision", 1, 6), ("decision", 2, 5), ("relationship", 1, 3), ("relationship", 2, 2), ("run", 1, 11), ("run", 2, 9), ("run", 3, 10)]


def test_empty_tables(spark):
    claims, runs, decisions, edges = (t.limit(0) for t in tables(spark))
    assert rollup.review_summaries(rollup.claim_snapshots(claims, runs), decisions).count() == 0
    assert rollup.claim_records(claims, runs, decisions, edges).count() == 0 == rollup.claim_timeline(runs, decisions, edges).count()


def test_records_of_all_claims_of_the_graph(spark, sf):
    """Each claim of the graph has one record, with runs or without, and the records count what the timeline lists."""
    rows = queries.p4_records(spark, sf).select("claim_id", "runs", "relationships", "disposition", "latest_verdict").collect()
    by = {r["claim_id"]: r for r in rows}
    graph = {r["claim_id"] for r in views.graph_claims(spark, sf).select("claim_id").collect()}
    assert len(by) == len(rows) and graph <= by.keys()
    listed = {r["claim_id"]: r["count"] for r in queries.p4_timeline(spark, sf).filter("part = 'relationship'").groupBy("claim_id").count().collect()}
    assert {k: r["relationships"] for k, r in by.items() if r["relationships"]} == listed
    assert all((r["disposition"], r["latest_verdict"]) == ("active", "UNVERIFIED") for k, r in by.items() if k in graph and not r["runs"])
    assert any(by[k]["runs"] for k in graph) and any(not by[k]["runs"] for k in graph)
