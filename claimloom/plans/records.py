"""Queries on anchors, scoring, snapshots, clause splits, re-extraction and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import duck as D
from claimloom.functions import rules, text
from claimloom.operators import anchors, history, scorer, snapshots
from claimloom.plans.evidence import ROLE
from claimloom.plans.workflow import RUNS, _latest
from claimloom.sources import views
from claimloom.sources.views import table, with_views


def _anchored(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    n = F.col("line_no")
    t = n.cast("string")
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    meta = (
        F.when(n % 5 == 0, j('{"kind": "page_line", "page_start": 1, "line_start": "', t, '", "page_end": ', (n % 3).cast("string"), ', "line_end": ', t, "}"))
        .when(n % 5 == 1, j('{"kind": "Paragraph", "paragraph_number": " ', (n - 1).cast("string"), ' "', F.when(n % 2 == 0, j(', "sequence_order": ', t)).otherwise(""), "}"))
        .when(n % 5 == 2, j('{"kind": "block", "block_index": ', t, ', "label": "', F.when(n % 2 == 0, " Note ").otherwise(" "), '"}'))
        .when(n % 5 == 3, j('{"kind": "exhibit_page", "page_number": ', t, ', "block_index": ', F.when(n % 2 == 0, "true").otherwise("2"), ', "label": "L"}')).otherwise('{"kind": "chapter"}')
    )
    page = F.when(n % 10 != 4, F.floor(n / 8).cast("int"))
    return s.select("segment_id", "doc_id", meta.alias("meta"), page.alias("page_start"), (n % 8).alias("line_start"), page.alias("page_end"), (n % 8).alias("line_end"))


def f8(spark, sf_dir):
    rows = anchors.normalised(_anchored(spark, sf_dir)).withColumn("key", anchors.sort_key())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("key", "segment_id"))
    return rows.select("segment_id", anchors.rendered().alias("rendered"), anchors.usable().alias("usable"), "key.rank", "key.k0", place.alias("place"))


F8 = with_views("segments") + """,
  x AS (SELECT segment_id, doc_id, line_no AS n, CASE WHEN line_no % 10 <> 4 THEN line_no // 8 END AS pg, line_no % 8 AS ln FROM segments),
  r AS (SELECT *, CASE n % 5 WHEN 0 THEN 'p.1:' || n || '-' || (n % 3) || ':' || n WHEN 1 THEN '¶' || (n - 1) WHEN 2 THEN 'block ' || n || CASE WHEN n % 2 = 0 THEN ' [Note]' ELSE '' END
      WHEN 3 THEN 'ex. p.' || n || CASE WHEN n % 2 = 0 THEN '' ELSE ' block 2' END || ' [L]' ELSE CASE WHEN pg IS NULL THEN 'unanchored segment' ELSE 'p.' || pg || ':' || ln || '-' || pg || ':' || ln END END AS rendered,
    CASE n % 5 WHEN 0 THEN n % 3 >= 1 WHEN 1 THEN n - 1 > 0 WHEN 2 THEN n > 0 WHEN 3 THEN true ELSE pg IS NOT NULL END AS usable,
    CASE n % 5 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN CASE WHEN pg IS NULL THEN 99 ELSE 0 END ELSE 2 END AS rank,
    CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN n % 2 = 0 THEN n ELSE n - 1 END WHEN 4 THEN coalesce(pg, 0) ELSE n END AS k0,
    CASE n % 5 WHEN 0 THEN n WHEN 3 THEN CASE WHEN n % 2 = 0 THEN 0 ELSE 2 END WHEN 4 THEN CASE WHEN pg IS NULL THEN 0 ELSE ln END ELSE 0 END AS k1 FROM x)
SELECT segment_id, rendered, usable, CAST(rank AS INTEGER) AS rank, CAST(k0 AS INTEGER) AS k0, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, k0, k1, segment_id) AS INTEGER) AS place FROM r"""


def s10(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    n = F.col("line_no")
    legacy = s.select(
        "segment_id", "segment_type", "speaker", F.when(F.col("doc_id") % 3 == 1, "DECLARATION").otherwise("DEPOSITION").alias("source_type"),
        F.when(n % 4 != 0, n % 6).alias("line_start"), F.when(n % 5 != 0, n).alias("page_start"), n.alias("page_end"), n.alias("line_end"),
    )
    return anchors.backfilled(legacy).select("segment_id", "kind", "number", "sequence_order")


S10 = with_views("segments") + r""",
  x AS (SELECT segment_id, segment_type, CASE WHEN line_no % 4 <> 0 THEN line_no % 6 END AS ls, CASE WHEN line_no % 5 <> 0 THEN line_no END AS ps, doc_id % 3 = 1 AS decl,
    nullif(CAST(nullif(regexp_extract(coalesce(speaker, ''), '¶\s*(\d+)', 1), '') AS INTEGER), 0) AS pn FROM segments),
  k AS (SELECT *, decl AND segment_type = 'DECLARATION_PARAGRAPH' AS p, decl AND segment_type = 'DECLARATION_BLOCK' AS b FROM x)
SELECT segment_id, CASE WHEN p THEN CASE WHEN coalesce(pn, ls) IS NOT NULL THEN 'paragraph' END WHEN b THEN CASE WHEN ls IS NOT NULL THEN 'block' END WHEN ps IS NOT NULL AND ls IS NOT NULL THEN 'page_line' END AS kind,
  CAST(CASE WHEN p THEN coalesce(pn, ls) WHEN b THEN ls WHEN ps IS NOT NULL AND ls IS NOT NULL THEN ps END AS INTEGER) AS number,
  CAST(CASE WHEN p THEN coalesce(nullif(ls, 0), pn, ls) WHEN b THEN ls END AS INTEGER) AS sequence_order FROM k"""


def _items(spark, sf_dir):
    return scorer.scored_items(views.claims(spark, sf_dir), views.text_links(spark, sf_dir), views.segments(spark, sf_dir))


def a5_items(spark, sf_dir):
    return _items(spark, sf_dir).select("claim_id", "segment_id", F.round("score", 6).alias("score"), "primary", "role")


def a5(spark, sf_dir):
    return scorer.scored_claims(_items(spark, sf_dir))


A5_CTE = with_views("claims", "segments", "text_links") + f""",
  c AS (SELECT claim_id, {D.tokens(D.matchable("text"), rules.VERIFY_STOP)} AS mine FROM claims),
  s AS (SELECT segment_id, {ROLE} AS ev, {D.found(D.matchable("raw_text"), rules.WEAK)} AS w, {D.tokens(D.matchable("raw_text"), rules.VERIFY_STOP)} AS t FROM segments),
  j AS (SELECT l.*, mine, t, ev, ev = 'substantive' AS sub, ev = 'substantive' AND w AS weak, {D.overlap("mine", "t")} AS raw FROM text_links l JOIN s USING (segment_id) JOIN c USING (claim_id)),
  k AS (SELECT *, CASE WHEN weak THEN least(raw, 0.05) ELSE raw END AS ov FROM j),
  sc AS (SELECT *, round(ov + CASE WHEN weak THEN -0.25 WHEN sub THEN 0.15 WHEN ev = 'contextual' THEN -0.15 ELSE 0 END, 9) AS score FROM k),
  pm AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, ov DESC, link_order, segment_id) = 1 AS prim FROM sc),
  g AS (SELECT claim_id, count(*) AS n, coalesce(max(ov) FILTER (sub), 0) AS s, coalesce(max(ov) FILTER (NOT sub), 0) AS x, max(ov) FILTER (prim) AS p, bool_or(sub) AND bool_and(NOT sub OR weak) AS all_weak,
    bool_or(sub AND NOT weak AND ov >= 0.55) AND bool_or(weak AND raw >= 0.35) AS tension, any_value(mine) AS mine, list_distinct(flatten(list(t))) AS t FROM pm GROUP BY claim_id),
  h AS (SELECT *, {D.overlap("mine", "t")} AS o FROM g),
  q AS (SELECT *, n >= 2 AND o >= 0.55 AND p < 0.7 AND round(o - p, 9) >= 0.2 AS narrow FROM h),
  v AS (SELECT *, CASE WHEN (x > 0 AND s < 0.2) OR all_weak OR (x >= 0.45 AND s < 0.15) THEN CASE WHEN o > 0 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END WHEN tension AND p >= 0.45 THEN 'PARTIALLY_SUPPORTED'
    WHEN p >= 0.7 AND s >= 0.55 AND NOT narrow THEN 'SUPPORTED' WHEN s >= 0.35 OR p >= 0.45 OR o >= 0.55 THEN 'PARTIALLY_SUPPORTED' WHEN o > 0 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END AS verdict FROM q)"""
A5_ITEMS = A5_CTE + """ SELECT claim_id, segment_id, round(score, 6) AS score, prim AS primary, CASE WHEN weak OR NOT sub THEN 'contextual' WHEN prim AND ov >= 0.25 THEN 'primary' WHEN ov >= 0.3 THEN 'secondary' ELSE 'contextual' END AS role FROM pm"""
A5 = A5_CTE + """ SELECT claim_id, verdict, CAST(CASE verdict WHEN 'SUPPORTED' THEN 0.75 WHEN 'PARTIALLY_SUPPORTED' THEN 0.6 WHEN 'AMBIGUOUS' THEN 0.4 ELSE 0.25 END AS DOUBLE) AS confidence,
  round(p, 6) AS primary_overlap, round(o, 6) AS combined, tension, narrow FROM v"""


def j8(spark, sf_dir):
    """Each claim's support items in link order as one numbered bundle."""
    s = views.segments(spark, sf_dir)
    rows = views.text_links(spark, sf_dir).withColumn("order", F.when(F.col("link_order") % 3 != 0, F.col("link_order"))).join(s.drop("doc_id"), "segment_id")
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("order").asc_nulls_last(), "segment_id"))
    item = F.concat(F.lit("["), place.cast("string"), F.lit("] Anchor: L"), F.col("line_no").cast("string"), F.lit(" | Speaker: "), F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(" | Type: "), "segment_type", F.lit("\n"), "raw_text")
    numbered = rows.select("claim_id", place.alias("place"), item.alias("item"))
    bundle = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]), "\n\n")
    return numbered.groupBy("claim_id").agg(F.count("*").alias("items"), F.sha2(bundle, 256).alias("bundle_sha256"))


J8 = with_views("claims", "segments", "text_links") + """,
  n AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN link_order % 3 <> 0 THEN link_order END NULLS LAST, segment_id) AS place, s.* FROM text_links JOIN segments s USING (segment_id))
SELECT claim_id, count(*) AS items, sha256(string_agg('[' || place || '] Anchor: L' || line_no || ' | Speaker: ' || coalesce(speaker, 'UNKNOWN') || ' | Type: ' || segment_type || chr(10) || raw_text, chr(10) || chr(10) ORDER BY place)) AS bundle_sha256
FROM n GROUP BY claim_id"""


def s7(spark, sf_dir):
    """events' JSON as versioned snapshots: read status, note, and the typed content."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    body = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit('{"provider_output": {"primary_anchor": '), F.when(k % 3 == 0, F.concat(F.lit('"p.'), k.cast("string"), F.lit('"'))).otherwise("null"), F.lit('}, "citations": ["a", "b"], "support_items": [{"order": '), k.cast("string"), F.lit(', "anchor": "x"}]}')))
    version = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, 9).otherwise(1)
    shape = "struct<provider_output: struct<primary_anchor: string>, citations: array<string>, support_items: array<struct<order: int, anchor: string>>>"
    rows = e.select("event_id", body.alias("body"), version.alias("version"))
    status = F.when(F.col("body").isNull(), "missing").when(F.col("version").isNull(), "legacy_unversioned_v1").when(F.col("version") == 1, "versioned_v1").otherwise("unsupported_version")
    read = rows.withColumn("status", status).withColumn("s", F.when(F.col("status").isin("legacy_unversioned_v1", "versioned_v1"), F.from_json("body", shape)))
    anchor = F.coalesce("s.provider_output.primary_anchor", F.get("s.support_items", F.lit(0))["anchor"])
    note = F.when(F.col("status") == "legacy_unversioned_v1", snapshots.LEGACY_NOTE).when(F.col("status") == "unsupported_version", F.concat(F.lit("Snapshot: persisted support snapshot version "), F.col("version").cast("string"), F.lit(" is not supported for structured rendering.")))
    return read.select("event_id", "status", note.alias("note"), anchor.alias("anchor"), F.coalesce(F.size("s.citations"), F.lit(0)).alias("citations"), F.get("s.support_items", F.lit(0))["order"].alias("first_order"))


S7 = """WITH x AS (SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
    CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'legacy_unversioned_v1' WHEN event_id % 7 = 0 THEN 'unsupported_version' ELSE 'versioned_v1' END AS status FROM events)
SELECT event_id, status, CASE WHEN status = 'legacy_unversioned_v1' THEN 'Snapshot: legacy/unversioned persisted support snapshot interpreted as v1-compatible.' WHEN status = 'unsupported_version' THEN 'Snapshot: persisted support snapshot version 9 is not supported for structured rendering.' END AS note,
  CASE WHEN status LIKE '%_v1' THEN CASE WHEN k % 3 = 0 THEN 'p.' || k ELSE 'x' END END AS anchor, CASE WHEN status LIKE '%_v1' THEN 2 ELSE 0 END AS citations, CASE WHEN status LIKE '%_v1' THEN k END AS first_order FROM x"""


def _clauses(spark, sf_dir, sign=",", rows=None):
    """Pieces of each claim at a sign, without blanks; the whole text where none is left."""
    c = views.claims(spark, sf_dir) if rows is None else rows
    pieces = F.filter(F.transform(F.split("text", rf"\s*{sign}\s*"), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.when(F.size(pieces) == 0, F.array(F.trim("text"))).otherwise(pieces)
    return c.select("claim_id", "draft_id", F.posexplode(kept).alias("pos", "piece")).withColumn("seq", F.col("pos") + 1).drop("pos")


def u3(spark, sf_dir):
    # semicolons for every "and"
    marked = views.claims(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" and "), F.lit(" ; ")))
    rows = _clauses(spark, sf_dir, ";", marked)
    return rows.select("claim_id", "seq", "piece", text.claim_type(F.col("piece")).alias("claim_type"))


CLAUSES = lambda name, sign, source="claims": rf"""
  {name}0 AS (SELECT claim_id, draft_id, text, [trim(p, ' ') FOR p IN regexp_split_to_array(text, '\s*{sign}\s*') IF trim(p, ' ') <> ''] AS ps FROM {source}),
  {name} AS (SELECT claim_id, draft_id, unnest(CASE WHEN len(ps) = 0 THEN [trim(text, ' ')] ELSE ps END) AS piece, CAST(generate_subscripts(CASE WHEN len(ps) = 0 THEN [trim(text, ' ')] ELSE ps END, 1) AS INTEGER) AS seq FROM {name}0)"""  # noqa: E731
U3 = with_views("claims") + ", marked AS (SELECT claim_id, draft_id, replace(text, ' and ', ' ; ') AS text FROM claims)," + CLAUSES("u", ";", "marked") + f" SELECT claim_id, seq, piece, {D.claim_type('piece')} AS claim_type FROM u"


def r1(spark, sf_dir):
    """Proposed clauses against persisted ones (split at another sign), by assertion: ready, unchanged or blocked."""
    tuples = lambda rows: rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("t"))
    old, new = tuples(_clauses(spark, sf_dir, ";")), tuples(_clauses(spark, sf_dir, ",")).withColumnRenamed("t", "proposed")
    linked = views.text_links(spark, sf_dir).filter("claim_id % 4 = 1").select("claim_id").distinct().withColumn("linked", F.lit(True))
    rows = old.join(new, "claim_id").join(linked, "claim_id", "left")
    changed = F.col("t") != F.col("proposed")
    current = F.col("claim_id") % 3 == 0
    status = F.when(~changed & current, "unchanged").when(changed & F.col("linked").isNotNull(), "blocked").otherwise("ready")
    return rows.select("claim_id", F.size("t").alias("existing"), F.size("proposed").alias("proposed"), changed.alias("changed"), status.alias("status"))


R1 = with_views("claims", "segments", "text_links") + "," + CLAUSES("o", ";") + "," + CLAUSES("p", ",") + """,
  ol AS (SELECT claim_id, list(piece ORDER BY seq) AS a FROM o GROUP BY 1), pl AS (SELECT claim_id, list(piece ORDER BY seq) AS b FROM p GROUP BY 1)
SELECT claim_id, CAST(len(a) AS INTEGER) AS existing, CAST(len(b) AS INTEGER) AS proposed, a <> b AS changed,
  CASE WHEN a = b AND claim_id % 3 = 0 THEN 'unchanged' WHEN a <> b AND claim_id IN (SELECT claim_id FROM text_links WHERE claim_id % 4 = 1) THEN 'blocked' ELSE 'ready' END AS status
FROM ol JOIN pl USING (claim_id)"""


def w3(spark, sf_dir):
    rows = history.with_previous(views.runs(spark, sf_dir), "claim_id", "run_id", ("verdict", "confidence"))
    return rows.select("claim_id", "run_id", "verdict", "prev_run_id", "prev_verdict", "prev_confidence")


W3 = with_views("runs") + """
SELECT claim_id, run_id, verdict, lead(run_id) OVER w AS prev_run_id, lead(verdict) OVER w AS prev_verdict, lead(confidence) OVER w AS prev_confidence
FROM runs WINDOW w AS (PARTITION BY claim_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC) QUALIFY row_number() OVER w = 1"""


def p1(spark, sf_dir):
    """Each latest run with its claim's decisions in time order, as one line."""
    d = views.decisions(spark, sf_dir).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "decision_id", "action"))), lambda x: F.lower(x["action"])), ", ").alias("made"))
    flags = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("none")
    line = F.concat_ws(
        " ", F.concat(F.lit("Verdict: "), "verdict", F.lit(".")), F.concat(F.lit("Flags: "), flags, F.lit(".")), F.concat(F.lit("Primary support anchor: "), "anchor", F.lit(".")),
        F.concat(F.lit("User decisions: "), F.coalesce("made", F.lit("none")), F.lit(".")),
    )
    return _latest(spark, sf_dir).join(d, "claim_id", "left").select("claim_id", line.alias("summary"))


P1 = RUNS.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + ",") + """,
  m AS (SELECT claim_id, string_agg(lower(action), ', ' ORDER BY created_at, decision_id) AS made FROM decisions GROUP BY 1)
SELECT claim_id, concat_ws(' ', 'Verdict: ' || verdict || '.', 'Flags: ' || CASE WHEN len(flags) > 0 THEN array_to_string(flags, ', ') ELSE 'none' END || '.', 'Primary support anchor: ' || anchor || '.',
  'User decisions: ' || coalesce(made, 'none') || '.') AS summary FROM latest LEFT JOIN m USING (claim_id)"""


def a15(spark, sf_dir):
    """Gold labels against a rule's output, with the kinds of mismatch counted."""
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").filter("doc_id % 9 != 0").select("doc_id", (F.length("text") > 1200).cast("int").alias("long_enough"), F.col("text").contains("disgusting").cast("int").alias("rude"))
    kinds = F.array(F.when(F.col("long_enough").isNull(), "missing"), F.when(F.col("long_enough") != F.col("quality"), "quality"), F.when(F.col("rude") != F.col("toxic"), "toxic"))
    found = gold.join(docs, "doc_id", "left").select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("failures"))


A15 = """WITH d AS (SELECT doc_id, CAST(length(text) > 1200 AS INTEGER) AS q, CAST(contains(text, 'disgusting') AS INTEGER) AS r FROM documents WHERE doc_id % 9 <> 0),
  m AS (SELECT unnest(list_filter([CASE WHEN q IS NULL THEN 'missing' END, CASE WHEN q <> quality THEN 'quality' END, CASE WHEN r <> toxic THEN 'toxic' END], lambda z: z IS NOT NULL)) AS kind
    FROM labels LEFT JOIN d USING (doc_id))
SELECT kind, count(*) AS failures FROM m GROUP BY kind"""


def j19(spark, sf_dir):
    """bundles' listed documents that are missing or of another matter, once each."""
    listed = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("bundle"), (F.col("l_suppkey") * 2).alias("doc_id")).dropDuplicates()
    docs = views.segment_scope(spark, sf_dir).select("doc_id", "matter")
    rows = listed.join(docs, "doc_id", "left")
    problem = F.when(F.col("matter").isNull(), "missing_document").when(F.col("matter") != F.col("bundle") % 3, "other_matter")
    return rows.select("bundle", "doc_id", problem.alias("problem"))


J19 = with_views("segment_scope") + """, l AS (SELECT DISTINCT l_orderkey % 50 AS bundle, l_suppkey * 2 AS doc_id FROM lineitem)
SELECT bundle, doc_id, CASE WHEN matter IS NULL THEN 'missing_document' WHEN matter <> bundle % 3 THEN 'other_matter' END AS problem FROM l LEFT JOIN segment_scope USING (doc_id)"""

_ALL = {
    "f8_anchor_order": (f8, F8), "s10_anchor_backfill": (s10, S10), "a5_support_items": (a5_items, A5_ITEMS), "a5_support_scoring": (a5, A5), "j8_claim_context": (j8, J8), "s7_snapshots": (s7, S7),
    "u3_clause_split": (u3, U3), "r1_reextraction_preview": (r1, R1), "w3_latest_and_previous": (w3, W3), "p1_audit_summary": (p1, P1), "a15_gold_evaluation": (a15, A15), "j19_bundle_integrity": (j19, J19),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
