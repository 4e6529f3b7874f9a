import pytest

from claimloom.operators import gold
from claimloom.plans import gold as plans

TEXTS = "case string, category string, texts array<string>, types array<string>"


def kinds(rows):
    return {r["case"]: r["kinds"] for r in rows.collect()}


def test_extraction_kinds_and_repeats(spark):
    mine = [("same", "x", ["a", "b"], ["F", "Q"]), ("order", "x", ["a", "b"], ["F", "F"]), ("repeat", "y", ["a", "b", "a", "a"], ["F"] * 4), ("type", "y", ["a"], ["F"]), ("gone", "y", ["a"], ["F"]), ("none", "y", None, None)]
    theirs = [("same", ["a", "b"], ["F", "Q"]), ("order", ["b", "a"], ["F", "F"]), ("repeat", ["a", "b", "b"], ["F"] * 3), ("type", ["a"], ["Q"]), ("new", ["z"], ["F"]), ("none", None, None)]
    rows = gold.extraction(spark.createDataFrame(mine, TEXTS), spark.createDataFrame(theirs, TEXTS.replace(" category string,", "")))
    both = ["extraction_text_mismatch", "claim_type_mismatch"]
    assert kinds(rows) == {"same": [], "order": both[:1], "repeat": both, "type": both[1:], "gone": ["missing_case"], "new": ["unexpected_case"], "none": []}
    told = {r["case"]: r["details"] for r in rows.collect()}
    assert told["repeat"] == "lacks [a, a], adds [b]" and told["order"] == "lacks [], adds []" and told["same"] is None
    assert {tuple(r) for r in gold.suites(rows).collect()} == {("extraction", "x", 2, 1, 1), ("extraction", "y", 4, 1, 3), ("extraction", None, 1, 0, 1)}
    assert ("extraction", "y", "extraction_text_mismatch", 1) in {tuple(r) for r in gold.failures(rows).collect()}


def test_flags_compare_as_sets_and_verdicts_with_nulls(spark):
    schema = "case string, category string, flags array<string>, verdict string"
    mine = [("a", "x", ["p", "q"], "S"), ("b", "x", ["p"], "S"), ("c", "x", None, None), ("d", "x", [], "S")]
    theirs = [("a", ["q", "p", "p"], "S"), ("b", ["q"], "S"), ("c", ["q"], None), ("d", [], None)]
    rows = gold.heuristics(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema.replace(" category string,", "")))
    lacks, adds, verdict = gold.KINDS["verification_heuristics"]
    assert kinds(rows) == {"a": [], "b": [lacks, adds], "c": [adds], "d": [verdict]}


def test_order_of_anchors_and_roles(spark):
    schema = "case string, category string, verdict string, primary_anchor string, roles array<string>, anchors array<string>"
    mine = [("a", "x", "S", "p", ["r", "s"], ["1", "2"]), ("b", "x", "S", None, ["r"], ["1"])]
    theirs = [("a", "S", "p", ["r", "s"], ["2", "1"]), ("b", "U", "p", [], ["1"])]
    rows = gold.provider(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema.replace(" category string,", "")))
    assert kinds(rows) == {"a": ["support_anchor_order_mismatch"], "b": ["verdict_mismatch", "primary_anchor_mismatch", "support_role_mismatch"]}


@pytest.mark.parametrize("side", [0, 1])
def test_empty_sides(spark, side):
    full = [("a", "x", ["t"], ["F"])]
    tables = [spark.createDataFrame(full if side else [], TEXTS), spark.createDataFrame([] if side else full, TEXTS).drop("category")]
    assert kinds(gold.extraction(*tables)) == {"a": ["missing_case" if side else "unexpected_case"]}


def test_query_has_every_kind(spark, sf):
    found = {(r["suite"], r["kind"]) for r in plans.a15_failures(spark, sf).collect()}
    assert {(s, k) for s, ks in gold.KINDS.items() for k in ks} <= found
    assert {("extraction", "missing_case"), ("extraction", "unexpected_case")} <= found
