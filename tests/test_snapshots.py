import pytest
from pyspark.sql import functions as F

from claimloom.operators import snapshots
from claimloom.plans import snapshots as plans


@pytest.fixture(scope="module")
def read(spark):
    def of(*pairs):
        rows = spark.createDataFrame([(i, b, v) for i, (b, v) in enumerate(pairs)], "id int, support_snapshot string, support_snapshot_version int")
        return snapshots.read(rows)

    return of


def test_statuses_and_notes(read):
    cases = [("{}", 1), ("{}", None), ("{}", 2), ("{}", 0), (None, 1), ("null", 1), ("", None), ("{", 1), ('{"a": 1, "a": 2}', 1), ("[]", 1), ("3", None)]
    got = [(r["status"], r["note"]) for r in read(*cases).orderBy("id").collect()]
    v1, legacy, none = ("versioned_v1", None), ("legacy_unversioned_v1", snapshots.LEGACY_NOTE), ("missing", None)
    later = lambda n: ("unsupported_version", f"Snapshot: persisted support snapshot version {n} is not supported for structured rendering.")
    assert got == [v1, legacy, later(2), later(0), none, none, none, none, none, v1, legacy]


def test_values_of_the_wrong_type_are_null_and_lists_empty(read):
    body = """{"claim_scope": {"claim_id": 4, "draft_id": "d", "scope_kind": true, "allowed_source_document_ids": ["a", "", 5, null]},
      "valid_support_links": [{"link_id": "l", "sequence_order": 3, "user_confirmed": "no"}, "x", {"sequence_order": 3.0, "user_confirmed": 0.0}, {"sequence_order": "3", "user_confirmed": {}}],
      "support_items": {"order": 1}, "citations": ["one", 2, "", "three"], "provider_output": {"primary_anchor": ["p"], "support_assessments": [{"anchor": 1, "role": "primary"}]}}"""
    s = read((body, 1)).first()["snapshot"]
    assert s["claim_scope"].asDict() == {"claim_id": None, "draft_id": "d", "matter_id": None, "evidence_bundle_id": None, "scope_kind": None, "allowed_source_document_ids": ["a"]}
    assert [(x["link_id"], x["sequence_order"], x["user_confirmed"]) for x in s["valid_support_links"]] == [("l", 3, True), (None, None, False), (None, None, False), (None, None, False)]
    assert s["support_items"] == [] and s["citations"] == ["one", "three"] and s["excluded_support_links"] == []
    assert s["provider_output"]["primary_anchor"] is None
    assert [x.asDict() for x in s["provider_output"]["support_assessments"]] == [{"segment_id": None, "anchor": "", "role": "primary", "contribution": ""}]


def test_audit_leaves_out_assessments_with_gaps(read):
    full = '{"anchor": "p.1", "role": "primary", "contribution": "says so"}'
    gaps = ", ".join(full.replace(x, "") for x in ("p.1", "primary", "says so"))
    body = f'{{"provider_output": {{"support_assessments": [{gaps}, {full}]}}, "excluded_support_links": [{{"code": "c"}}]}}'
    rows = {r["id"]: r for r in snapshots.audit_view(read((body, 1), (None, 1), (body, 7)), "id").collect()}
    assert set(rows) == {0, 2}
    assert [tuple(x) for x in rows[0]["support_assessments"]] == [("p.1", "primary", "says so")]
    assert [tuple(x) for x in rows[0]["excluded_support_links"]] == [("c", None)]
    assert rows[2]["support_assessments"] == [] and rows[2]["allowed_source_document_count"] == 0 and rows[2]["snapshot_note"]


def test_history_shows_what_has_a_scope(read):
    rows = read(('{"claim_scope": {"claim_id": "c"}}', 1), ('{"claim_scope": {}}', 1), ('{"claim_scope": {"claim_id": "c"}}', 9), (None, None))
    got = [r["support_snapshot"] is not None for r in snapshots.history_fields(rows).orderBy("id").collect()]
    assert got == [True, False, False, False]


def test_clashing_columns_and_empty_tables(read):
    rows = read(("{}", 1)).withColumn("status", F.lit("mine"))
    assert snapshots.read(rows).first()["status"] == "versioned_v1"
    assert snapshots.read(rows.limit(0)).count() == 0


def test_query_has_every_kind(spark, sf):
    rows = plans.s7(spark, sf)
    assert {r["status"] for r in rows.select("status").distinct().collect()} == {"missing", "legacy_unversioned_v1", "versioned_v1", "unsupported_version"}
    (n,) = rows.agg(*[F.countDistinct(c).alias(c) for c in ("allowed", "links", "items", "citations", "assessments", "excluded")]).collect()
    assert all(v > 1 for v in n.asDict().values())


def test_anchor_and_snippet(read):
    item = '{"anchor": "i.1", "raw_text": "%s"}'
    cases = [
        ('{"provider_output": {"primary_anchor": "p.1", "support_assessments": [{"anchor": "a", "contribution": "c"}]}, "support_items": [%s]}' % (item % "text"), ("p.1", "a: c")),
        ('{"provider_output": {"primary_anchor": ""}, "support_items": [%s]}' % (item % "  text "), ("i.1", "text")),
        ('{"support_items": [%s]}' % (item % ("a" * 216 + " " + "b" * 9)), ("i.1", "a" * 216 + "...")),
        ('{"support_items": [%s]}' % (item % ("a" * 220)), ("i.1", "a" * 220)),
        ('{"support_items": [{"anchor": "i.2"}]}', ("i.2", None)),
        ("{}", (None, None)), (None, (None, None)),
    ]
    rows = snapshots.anchor_and_snippet(read(*[(b, 1) for b, _ in cases]), "id").orderBy("id").collect()
    assert [(r["primary_anchor"], r["snippet"]) for r in rows] == [want for _, want in cases]


def test_snippets_of_the_query_are_cut(spark, sf):
    rows = plans.d7(spark, sf)
    assert rows.filter("length(snippet) > 200 AND snippet LIKE '%...'").count() > 0 and rows.filter("snippet LIKE '%: %'").count() > 0
