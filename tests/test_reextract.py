"""Re-extraction on the splitters, against the rules written out over rows in plain Python."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims, reextract
from claimloom.plans import splitting
from claimloom.sources import store

TWO, ONE = "Mara opened the sluice and paid the diver.", "Mara opened the sluice."
#: assertion_id, text, strategy, version, has_snapshot, claims on record (None: as proposed), links, runs, expected
CASES = [
    (1, TWO, None, None, False, [TWO], [], [], ("legacy_unversioned", True, "", "ready", "replaced")),
    (2, ONE, None, None, None, None, [], [], ("legacy_unversioned", False, "", "ready", "metadata_only")),
    (3, TWO, "plain", 1, True, None, [1], [1], ("versioned", False, "", "unchanged", "skipped")),
    (4, TWO, "plain", 1, True, [TWO], [1, 1], [], ("versioned", True, "L", "blocked", "blocked")),
    (5, TWO, None, None, False, [ONE, TWO], [2], [1], ("legacy_unversioned", True, "LR", "blocked", "blocked")),
    (6, TWO, "structured", 1, True, None, [1], [], ("versioned", False, "", "ready", "metadata_only")),
    (7, ONE, "plain", 0, True, None, [], [1], ("versioned", False, "", "ready", "metadata_only")),
    (8, ONE, "plain", 1, False, None, [], [], ("versioned", False, "", "ready", "metadata_only")),
    (9, TWO, None, None, None, [], [], [], ("legacy_unversioned", True, "", "ready", "replaced")),
    (10, " ", None, None, None, [], [], [], ("legacy_unversioned", False, "", "ready", "metadata_only")),
    (11, None, "plain", 1, True, [ONE], [], [1], ("versioned", True, "R", "blocked", "blocked")),
]


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(7, a, t, s, v, h) for a, t, s, v, h, *_ in CASES], "draft_id long, assertion_id long, text string, strategy string, version int, has_snapshot boolean")
    proposed = claims.narrow_claims(texts)
    given = [(f"{a}.{i}", a, i, c) for a, t, *_, on, _, _, _ in CASES for i, c in enumerate(claims.claims_of(t)[1] if on is None else on, 1)]
    persisted = spark.createDataFrame(given, "claim_id string, assertion_id long, seq int, claim string").withColumn("claim_type", F.lit("FACT"))
    ids = lambda at: spark.createDataFrame([(f"{c[0]}.{i}",) for c in CASES for i in c[at]] + [(None,), ("gone",)], "claim_id string")
    return texts, persisted, proposed, ids(6), ids(7)


def test_status_and_outcome_of_each_case(tables):
    texts, persisted, proposed, links, runs = tables
    rows = reextract.outcomes(reextract.compared(texts, persisted, proposed, links, runs))
    told = {"L": reextract.LINKS_ATTACHED, "R": reextract.RUNS_ATTACHED}
    got = {r["assertion_id"]: (r["existing"], r["changed"], tuple(r["blocked_by"]), r["status"], r["outcome"]) for r in rows.collect()}
    assert got == {c[0]: (c[-1][0], c[-1][1], tuple(told[x] for x in c[-1][2]), *c[-1][3:]) for c in CASES}
    (n,) = reextract.preview_counters(rows).collect()
    assert n.asDict() == {"draft_id": 7, "assertions": 11, "ready": 7, "unchanged": 1, "blocked": 3, "changed": 5, "legacy_unversioned": 5}


def test_claims_after_application(tables):
    texts, persisted, proposed, links, runs = tables
    after = reextract.claims_after(reextract.outcomes(reextract.compared(texts, persisted, proposed, links, runs)))
    got = defaultdict(dict)
    for r in after.collect():
        got[r["assertion_id"]][r["seq"]] = r["claim"]
    two = {1: "Mara opened the sluice", 2: "Mara paid the diver."}
    assert got == {1: two, 2: {1: ONE}, 3: two, 4: {1: TWO}, 5: {1: ONE, 2: TWO}, 6: two, 7: {1: ONE}, 8: {1: ONE}, 9: two, 11: {1: ONE}}


def test_empty_tables(tables):
    texts, persisted, proposed, links, runs = (t.limit(0) for t in tables)
    rows = reextract.compared(texts, persisted, proposed, links, runs)
    assert rows.count() == 0 and reextract.claims_after(reextract.outcomes(rows)).count() == 0
    assert reextract.snapshots(texts, proposed, persisted).count() == 0


def test_partitions_of_other_drafts_stay(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("draft_id"), F.col("id").alias("assertion_id"), F.lit(1).alias("seq"), F.lit(ONE).alias("claim"), F.lit("FACT").alias("claim_type"))
    path = str(tmp_path / "claims")
    reextract.write_claims(rows, path, 4)
    files = {p for p in (tmp_path / "claims").rglob("*.parquet") if "part=1" not in str(p)}
    reextract.write_claims(rows.filter(store.part_of("draft_id", 4) == 1).withColumn("claim", F.lit(TWO)), path, 4)
    assert files <= set((tmp_path / "claims").rglob("*.parquet"))
    got = Counter(r["claim"] for r in spark.read.parquet(path).collect())
    assert sum(got.values()) == 40 and got[TWO] == rows.filter(store.part_of("draft_id", 4) == 1).count() > 0


def test_claims_on_record_are_written_without_a_join(spark, sf, monkeypatch):
    """The document of a claim on record is in its assertion's id: its text need not be shuffled to find it."""
    plans, write = [], reextract.write_claims
    monkeypatch.setattr(reextract, "write_claims", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, *a))
    splitting.r3(spark, sf)
    assert len(plans) == 2 and "Join" not in plans[0] and "Join" in plans[1]


def test_queries_against_the_rules(spark, sf):
    lines = {r["assertion_id"]: r for r in splitting.placed(spark, sf).collect() if (r["text"] or "").strip()}
    cut = {a: claims.claims_of(r["text"]) for a, r in lines.items()}
    old = {}
    for a, r in lines.items():
        old[a] = [] if r["line_no"] % 11 == 5 else cut[a][1] if r["line_no"] % 3 == 0 else [p for x in r["text"].split(";") if (p := x.strip(" "))]
    want = {}
    for a, r in lines.items():
        changed, turn = old[a] != cut[a][1], r["line_no"] % 3
        attached = (r["doc_id"] % 4 == 1 and len(old[a]) > 0) or (r["doc_id"] % 6 == 1 and len(old[a]) > 1)
        want[a] = (changed, "blocked" if changed and attached else "unchanged" if not changed and turn == 0 and cut[a][0] == "structured" else "ready")
    got = {r["assertion_id"]: (r["changed"], r["status"]) for r in splitting.r2(spark, sf).collect()}
    assert got == want and len({s for _, s in want.values()}) == 3

    counted = Counter((lines[a]["doc_id"], s) for a, (_, s) in want.items())
    for r in splitting.r2_counters(spark, sf).collect():
        assert all(r[s] == counted[r["draft_id"], s] for s in ("ready", "unchanged", "blocked"))

    part = {r["draft_id"]: r["p"] for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("draft_id")).withColumn("p", store.part_of("draft_id", splitting.PARTS)).collect()}
    after = {(a, i, c) for a, r in lines.items() for i, c in enumerate(cut[a][1] if part[r["doc_id"]] % 2 == 0 and want[a] == (True, "ready") else old[a], 1)}
    rows = splitting.r3(spark, sf).collect()
    assert {(r["assertion_id"], r["seq"], r["claim"]) for r in rows} == after and len(rows) == len(after)

    told = {r["assertion_id"]: (r["strategy"], [c["text"] for c in json.loads(r["snapshot"])["claims"]]) for r in splitting.u4(spark, sf).collect()}
    assert told == {a: cut[a] for a in lines if not old[a]} and told
