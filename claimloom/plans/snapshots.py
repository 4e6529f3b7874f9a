"""Queries that read stored snapshots, well and ill formed."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import snapshots
from claimloom.sources.views import table

#: bodies by turns, with an event's number for @; what they have wrong is in their order: nothing, nothing,
#: types of the scope and lists, entries that are no objects, provider output and flags, kinds of the whole, broken
BODIES = (
    '{"claim_scope": {"claim_id": "c@", "draft_id": "d", "matter_id": "m", "scope_kind": "bundle", "allowed_source_document_ids": ["a@", "b"]}, "valid_support_links": [{"link_id": "l@", "sequence_order": @, "user_confirmed": true, "anchor": "p.@"}], "excluded_support_links": [{"code": "outside_bundle", "message": "not in @"}], "support_items": [{"order": @, "anchor": "p.@", "raw_text": "text @"}], "citations": ["one", "two @"], "provider_output": {"primary_anchor": "p.@", "support_assessments": [{"segment_id": "s", "anchor": "p.@", "role": "primary", "contribution": "says @"}]}}',
    '{"claim_scope": {"claim_id": "c@", "evidence_bundle_id": null, "scope_kind": "matter"}, "support_items": [{"order": -@}, {"order": 2, "anchor": ""}], "citations": []}',
    '{"claim_scope": {"claim_id": @, "scope_kind": ["bundle"], "allowed_source_document_ids": ["", 7, null, "z@", {"id": "y"}]}, "valid_support_links": {"link_id": "l"}, "support_items": "none", "citations": [@, "", null, "kept @", ["no"]]}',
    '{"claim_scope": ["claim"], "valid_support_links": [null, 5, "x", [], {"link_id": 5, "sequence_order": "@", "user_confirmed": "yes"}, {"sequence_order": 1.0, "user_confirmed": 0}], "excluded_support_links": [{"code": null, "message": 3}, {}]}',
    '{"claim_scope": {}, "provider_output": {"primary_anchor": 12, "support_assessments": [{"anchor": "p.@", "role": "", "contribution": "x"}, {"anchor": "p.@", "role": "secondary"}, 4, {"anchor": "q.@", "role": "contextual", "contribution": "c"}]}, "valid_support_links": [{"user_confirmed": ""}, {"user_confirmed": []}, {"user_confirmed": {}}, {"user_confirmed": [0]}, {"user_confirmed": null}, {"user_confirmed": 0.5}, {"sequence_order": true}]}',
    '["@"]',
    '"@"',
    "null",
    '{"claim_scope": {"claim_id": "c@"',
    "not JSON, @",
)


def _read(spark, sf_dir, long_texts=False):
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).cast("string")
    turn = (F.col("event_id") % (len(BODIES) + 1) + 1).cast("int")
    body = F.replace(F.get(F.array(*map(F.lit, BODIES)), turn - 1), F.lit("@"), k)
    if long_texts:
        body = F.replace(F.replace(body, F.lit('"support_assessments"'), F.when(turn == 1, '"assessed"').otherwise('"support_assessments"')), F.lit('"text '), F.concat(F.lit('"  text '), F.repeat(F.lit("salt "), (F.col("event_id") % 60).cast("int"))))
    version = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, 9).otherwise(1)
    return snapshots.read(e.select("event_id", body.alias("support_snapshot"), version.alias("support_snapshot_version")))


def _told(entries, *names):
    """Entries as text: fields with bars between them, a dash where one is null."""
    field = lambda x, n: F.coalesce(x[n].cast("string"), F.lit("-"))
    return F.array_join(F.transform(entries, lambda x: F.concat_ws("|", *[field(x, n) for n in names])), ";")


def s7(spark, sf_dir):
    """Each event's snapshot by what its values are."""
    s = F.col("snapshot")
    return _read(spark, sf_dir).select(
        "event_id", "status", "note", s["claim_scope"].isNotNull().alias("scoped"), s["claim_scope"]["claim_id"].alias("claim_id"), s["claim_scope"]["scope_kind"].alias("scope_kind"),
        F.array_join(s["claim_scope"]["allowed_source_document_ids"], ",").alias("allowed"), _told(s["valid_support_links"], "link_id", "sequence_order", "user_confirmed", "anchor").alias("links"),
        _told(s["excluded_support_links"], "code", "message").alias("excluded"), _told(s["support_items"], "order", "anchor", "raw_text").alias("items"),
        F.array_join(s["citations"], ",").alias("citations"), s["provider_output"]["primary_anchor"].alias("primary_anchor"),
        _told(s["provider_output"]["support_assessments"], "anchor", "role", "contribution").alias("assessments"),
    )


def s9_audit(spark, sf_dir):
    rows = snapshots.audit_view(_read(spark, sf_dir), "event_id")
    return rows.withColumn("support_assessments", _told(F.col("support_assessments"), "anchor", "role", "contribution")).withColumn("excluded_support_links", _told(F.col("excluded_support_links"), "code", "message"))


def s9_history(spark, sf_dir):
    rows = snapshots.history_fields(_read(spark, sf_dir))
    s = F.col("support_snapshot")
    return rows.select("event_id", "support_snapshot_status", "support_snapshot_note", "support_snapshot_version", s.isNotNull().alias("shown"), s["claim_scope"]["claim_id"].alias("claim_id"), F.size(s["support_items"]).alias("items"))


def d7(spark, sf_dir):
    """Each run's primary anchor and snippet, with texts of items lengthened by the event's number."""
    rows = _read(spark, sf_dir, long_texts=True)
    return snapshots.anchor_and_snippet(rows, "event_id")


_str = lambda x, path: f"CASE WHEN json_type({x}, '{path}') = 'VARCHAR' THEN json_extract_string({x}, '{path}') END"
_int = lambda x, path: f"CASE WHEN json_type({x}, '{path}') IN ('BIGINT', 'UBIGINT') THEN json_extract_string({x}, '{path}') WHEN json_type({x}, '{path}') = 'BOOLEAN' THEN CASE json_extract_string({x}, '{path}') WHEN 'true' THEN '1' ELSE '0' END END"
_flag = lambda x, path: f"CASE WHEN json_type({x}, '{path}') IS NULL OR json_type({x}, '{path}') = 'NULL' OR CAST(json_extract({x}, '{path}') AS VARCHAR) IN ('false', '0', '0.0', '\"\"', '[]', '{{}}') THEN 'false' ELSE 'true' END"
_list = lambda path, *fields: "array_to_string([" + " || '|' || ".join(f"coalesce({f}, '-')" for f in fields) + f" FOR x IN json_extract(j, '{path}[*]')], ';')"
_strings = lambda path: f"array_to_string([json_extract_string(x, '$') FOR x IN json_extract(j, '{path}[*]') IF json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') <> ''], ',')"
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
READ = f"""WITH b AS (SELECT event_id, replace([{", ".join(map(_quoted, BODIES))}][event_id % {len(BODIES) + 1} + 1], '@', coalesce(json_extract_string(props, '$.k'), '0')) AS body,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 9 ELSE 1 END AS version FROM events),
  g AS (SELECT *, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) <> 'NULL' THEN CAST(body AS JSON) END AS h FROM b),
  t AS (SELECT *, CASE WHEN h IS NULL THEN 'missing' WHEN version IS NULL THEN 'legacy_unversioned_v1' WHEN version = 1 THEN 'versioned_v1' ELSE 'unsupported_version' END AS status FROM g),
  r AS (SELECT *, CASE WHEN status LIKE '%_v1' THEN h ELSE CAST('{{}}' AS JSON) END AS j, CASE status WHEN 'legacy_unversioned_v1' THEN {_quoted(snapshots.LEGACY_NOTE)}
    WHEN 'unsupported_version' THEN 'Snapshot: persisted support snapshot version ' || version || ' is not supported for structured rendering.' END AS note FROM t),
  q AS (SELECT *, coalesce(len(json_keys(j, '$.claim_scope')) > 0, false) AS scoped FROM r)"""
_ASSESSED = [f"coalesce({_str('x', '$.' + n)}, '')" for n in ("anchor", "role", "contribution")]
_EXCLUDED = _list("$.excluded_support_links", _str("x", "$.code"), _str("x", "$.message"))
S7 = READ + f""" SELECT event_id, status, note, scoped, {_str("j", "$.claim_scope.claim_id")} AS claim_id, {_str("j", "$.claim_scope.scope_kind")} AS scope_kind,
  CASE WHEN scoped THEN {_strings("$.claim_scope.allowed_source_document_ids")} END AS allowed,
  {_list("$.valid_support_links", _str("x", "$.link_id"), _int("x", "$.sequence_order"), _flag("x", "$.user_confirmed"), _str("x", "$.anchor"))} AS links, {_EXCLUDED} AS excluded,
  {_list("$.support_items", _int("x", "$.order"), _str("x", "$.anchor"), _str("x", "$.raw_text"))} AS items, {_strings("$.citations")} AS citations,
  {_str("j", "$.provider_output.primary_anchor")} AS primary_anchor, {_list("$.provider_output.support_assessments", *_ASSESSED)} AS assessments FROM q"""
S9_AUDIT = READ + f""" SELECT event_id, version AS support_snapshot_version, {_str("j", "$.claim_scope.scope_kind")} AS scope_kind,
  CAST(len([1 FOR x IN json_extract(j, '$.claim_scope.allowed_source_document_ids[*]') IF json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') <> '']) AS INTEGER) AS allowed_source_document_count,
  {_str("j", "$.provider_output.primary_anchor")} AS primary_anchor,
  array_to_string([{" || '|' || ".join(_ASSESSED)} FOR x IN json_extract(j, '$.provider_output.support_assessments[*]') IF {" AND ".join(f"{a} <> ''" for a in _ASSESSED)}], ';') AS support_assessments,
  {_EXCLUDED} AS excluded_support_links, note AS snapshot_note FROM q WHERE status <> 'missing'"""
S9_HISTORY = READ + f""" SELECT event_id, status AS support_snapshot_status, note AS support_snapshot_note, version AS support_snapshot_version, scoped AS shown, {_str("j", "$.claim_scope.claim_id")} AS claim_id,
  CASE WHEN scoped THEN CAST(len(json_extract(j, '$.support_items[*]')) AS INTEGER) END AS items FROM q"""

D7 = READ.replace(f"[event_id % {len(BODIES) + 1} + 1], '@', coalesce(json_extract_string(props, '$.k'), '0')) AS body", f"""[event_id % {len(BODIES) + 1} + 1], '@', coalesce(json_extract_string(props, '$.k'), '0')) AS plain,
    replace(replace(plain, '"support_assessments"', CASE WHEN event_id % {len(BODIES) + 1} = 0 THEN '"assessed"' ELSE '"support_assessments"' END), '"text ', '"  text ' || repeat('salt ', event_id % 60)) AS body""") + f""",
  a AS (SELECT event_id, nullif({_str("j", "$.provider_output.primary_anchor")}, '') AS named, json_extract(j, '$.provider_output.support_assessments[*]')[1] AS x, {_str("j", "$.support_items[0].anchor")} AS place, trim({_str("j", "$.support_items[0].raw_text")}) AS raw FROM q)
SELECT event_id, coalesce(named, place) AS primary_anchor, CASE WHEN x IS NOT NULL THEN {_ASSESSED[0]} || ': ' || {_ASSESSED[2]} WHEN length(raw) > 220 THEN rtrim(left(raw, 217)) || '...' ELSE raw END AS snippet FROM a"""
QUERIES = {"d7_run_snippets": d7, "s7_typed_snapshots": s7, "s9_audit_view": s9_audit, "s9_history_fields": s9_history}
SQL = {"d7_run_snippets": D7, "s7_typed_snapshots": S7, "s9_audit_view": S9_AUDIT, "s9_history_fields": S9_HISTORY}
