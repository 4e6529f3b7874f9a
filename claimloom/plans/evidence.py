"""Queries on texts: suggestion, verification, statement checks, the claim graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import duck, rules, text
from claimloom.operators import graph, suggest, verify
from claimloom.sources import views
from claimloom.sources.views import table, with_views

D = duck


def j7(spark, sf_dir):
    return suggest.suggest_support(views.claims(spark, sf_dir), views.segments(spark, sf_dir))


J7 = f"""{with_views("claims", "segments")},
  c AS (SELECT claim_id, matter, {D.tokens(D.matchable("text"), rules.SUGGEST_STOP)} AS t FROM claims),
  s AS (SELECT segment_id, matter, {D.tokens(D.matchable("raw_text"), rules.SUGGEST_STOP)} AS t FROM segments),
  scored AS (SELECT claim_id, segment_id, round(len(list_intersect(c.t, s.t)) / len(c.t), 2) AS score
    FROM c JOIN s ON c.matter = s.matter WHERE len(c.t) > 0 AND list_has_any(c.t, s.t))
SELECT claim_id, segment_id, score, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, segment_id) AS INTEGER) AS rank
FROM scored WHERE score > 0 QUALIFY rank <= {rules.SUGGESTIONS}
"""


def f_text(spark, sf_dir):
    c = views.claims(spark, sf_dir)
    normal = text.matchable(F.col("text"))
    return c.select(
        "claim_id", normal.alias("normal"), text.claim_type(F.col("text")).alias("claim_type"),
        F.array_join(F.array_sort(text.tokens(normal, rules.VERIFY_STOP)), " ").alias("tokens"),
        F.array_join(text.quoted_phrases(F.col("text")), "|").alias("phrases"), F.array_join(F.array_sort(text.names(F.col("text"))), " ").alias("names"),
        text.multiple_predicates(normal).alias("multiple"), text.mentions(normal, rules.KNOWLEDGE).alias("knowledge"), text.mentions(normal, rules.CAUSATION).alias("causation"),
        normal.rlike(text.UNICODE + rules.REPEATED).alias("repeated"),
    )


M = D.matchable("text")
F_TEXT = f"""{with_views("claims")}
SELECT claim_id, {M} AS normal, {D.claim_type("text")} AS claim_type,
  array_to_string(list_sort({D.tokens(M, rules.VERIFY_STOP)}), ' ') AS tokens, array_to_string({D.phrases("text")}, '|') AS phrases,
  array_to_string(list_sort({D.names("text")}), ' ') AS names, {D.multiple_predicates(M)} AS multiple,
  {D.mentions(M, rules.KNOWLEDGE)} AS knowledge, {D.mentions(M, rules.CAUSATION)} AS causation, {D.found(M, rules.REPEATED)} AS repeated
FROM claims
"""


def f6_roles(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    role = text.evidence_role(F.col("segment_type"), F.col("speaker"), F.col("raw_text"))
    weak = (role == "substantive") & text.weak_text(F.col("raw_text"))
    return s.select("segment_id", role.alias("role"), weak.alias("weak"), text.matchable(F.col("raw_text")).rlike(text.UNICODE + rules.DISCRETE).alias("discrete"))


ROLE = D.evidence_role("segment_type", "coalesce(speaker, '')", "raw_text")
F6_ROLES = f"""{with_views("segments")}
SELECT segment_id, {ROLE} AS role, {ROLE} = 'substantive' AND {D.found(D.matchable("raw_text"), rules.WEAK)} AS weak,
  {D.found(D.matchable("raw_text"), rules.DISCRETE)} AS discrete
FROM segments
"""


def a4(spark, sf_dir):
    found = verify.verify(views.claims(spark, sf_dir), views.text_links(spark, sf_dir), views.segments(spark, sf_dir))
    return found.select("claim_id", F.array_join("flags", ",").alias("flags"), "verdict", "confidence", *[F.round(c, 6).alias(c) for c in ("combined", "substantive", "contextual")])


MEASURED = f"""{with_views("claims", "segments", "text_links")},
  c AS (SELECT claim_id, text AS claim, {M} AS cn, {D.tokens(M, rules.VERIFY_STOP)} AS ct FROM claims),
  s AS (SELECT segment_id, raw_text, anchored, {D.matchable("raw_text")} AS normal, {ROLE} = 'substantive' AS sub,
    {D.found(D.matchable("raw_text"), rules.WEAK)} AS weak, {D.tokens(D.matchable("raw_text"), rules.VERIFY_STOP)} AS t FROM segments),
  j AS (SELECT l.*, s.*, {D.overlap("ct", "t")} AS o FROM text_links l JOIN s USING (segment_id) JOIN c USING (claim_id)),
  m AS (SELECT claim_id, string_agg(normal, ' ' ORDER BY link_order, segment_id) AS normal, string_agg(raw_text, ' ' ORDER BY link_order, segment_id) AS raw,
      count(*) FILTER (NOT anchored) AS unanchored, bool_or(sub) AS has_sub, bool_or(sub AND weak) AS has_weak, bool_and(NOT sub OR weak) AND bool_or(sub) AS all_weak,
      coalesce(max(CASE WHEN weak THEN least(o, 0.05) ELSE o END) FILTER (sub), 0) AS s, coalesce(max(o) FILTER (NOT sub), 0) AS x
    FROM j GROUP BY claim_id),
  w AS (SELECT m.*, claim, cn, {D.overlap("ct", D.tokens("normal", rules.VERIFY_STOP))} AS o FROM m JOIN c USING (claim_id)),
  q AS (SELECT *, [k FOR k IN {D.all_tokens("cn")} IF list_contains({D.listed(rules.QUALIFIERS)}, k)] AS quals,
      {D.names("claim")} AS cnames, {D.names("raw")} AS rnames, {D.mentions("cn", rules.KNOWLEDGE)} AS knows, {D.mentions("cn", rules.CAUSATION)} AS causes FROM w),
  f AS (SELECT *, list_filter([
      CASE WHEN unanchored > 0 THEN 'invalid_anchor' END,
      CASE WHEN len(quals) > 0 AND NOT list_has_any(quals, {D.all_tokens("normal")}) THEN 'absolute_qualifier_mismatch' END,
      CASE WHEN len([p FOR p IN {D.phrases("claim")} IF NOT {D.phrase_found("p", "normal")}]) > 0 THEN 'quote_mismatch_placeholder' END,
      CASE WHEN len(cnames) > 0 AND len(rnames) > 0 AND NOT list_has_any(cnames, rnames) THEN 'subject_mismatch' END,
      CASE WHEN {D.found("cn", rules.REPEATED)} AND NOT {D.found("normal", rules.REPEATED)} AND {D.found("normal", rules.DISCRETE)} THEN 'temporal_scope_mismatch' END,
      CASE WHEN knows AND NOT {D.mentions("normal", rules.KNOWLEDGE)} THEN 'knowledge_escalation' END,
      CASE WHEN causes AND NOT {D.mentions("normal", rules.CAUSATION)} THEN 'causation_escalation' END,
      CASE WHEN knows OR causes THEN 'needs_human_review' END,
      CASE WHEN (NOT has_sub AND x > 0) OR (has_weak AND x >= 0.35 AND s < 0.2) OR (x >= 0.4 AND s < 0.2) THEN 'contextual_support_only' END,
      CASE WHEN o >= 0.25 AND s >= 0.2 AND s < 0.7 AND {D.multiple_predicates("cn")} AND (s <= 0.6 OR s < o) THEN 'narrow_support' END],
      lambda z: z IS NOT NULL) AS flags FROM q),
  v AS (SELECT *, CASE
      WHEN list_contains(flags, 'invalid_anchor') THEN 'AMBIGUOUS'
      WHEN list_contains(flags, 'quote_mismatch_placeholder') THEN 'OVERSTATED'
      WHEN list_contains(flags, 'contextual_support_only') OR all_weak THEN CASE WHEN o > 0 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END
      WHEN list_has_any(flags, ['knowledge_escalation', 'causation_escalation']) THEN CASE WHEN o >= 0.15 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END
      WHEN list_contains(flags, 'subject_mismatch') THEN CASE WHEN o >= 0.25 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END
      WHEN list_contains(flags, 'narrow_support') THEN CASE WHEN o >= 0.25 THEN 'OVERSTATED' ELSE 'AMBIGUOUS' END
      WHEN list_has_any(flags, ['absolute_qualifier_mismatch', 'temporal_scope_mismatch']) THEN CASE WHEN o >= 0.45 THEN 'OVERSTATED' ELSE 'AMBIGUOUS' END
      WHEN o >= 0.7 AND NOT list_contains(flags, 'needs_human_review') THEN 'SUPPORTED'
      WHEN o >= 0.4 THEN CASE WHEN list_contains(flags, 'needs_human_review') THEN 'AMBIGUOUS' ELSE 'PARTIALLY_SUPPORTED' END
      WHEN o >= 0.15 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END AS verdict FROM f)"""
A4 = f"""{MEASURED}
SELECT claim_id, array_to_string(flags, ',') AS flags, verdict, CAST(CASE
    WHEN list_contains(flags, 'invalid_anchor') THEN 0.3 WHEN list_contains(flags, 'contextual_support_only') THEN 0.35
    WHEN verdict = 'SUPPORTED' THEN 0.85 WHEN verdict = 'PARTIALLY_SUPPORTED' THEN 0.65
    WHEN verdict = 'OVERSTATED' THEN CASE WHEN o >= 0.45 THEN 0.55 ELSE 0.4 END WHEN verdict = 'AMBIGUOUS' THEN 0.4 ELSE 0.25 END AS DOUBLE) AS confidence,
  round(o, 6) AS combined, round(s, 6) AS substantive, round(x, 6) AS contextual
FROM v
"""


def d1(spark, sf_dir):
    c = views.claims(spark, sf_dir)
    links = views.text_links(spark, sf_dir).filter("claim_id % 3 != 0")
    return verify.unlinked_verdicts(c.join(links.select("claim_id"), "claim_id", "left_anti")).drop("reasoning", "suggested_fix")


D1 = f"""{with_views("claims", "segments", "text_links")},
  k AS (SELECT claim_id, {D.found("text", rules.CASE_CITED)} AS cited, {D.found(M, rules.UNIVERSAL)} AS universal
    FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM text_links WHERE claim_id % 3 <> 0))
SELECT claim_id, CASE WHEN cited THEN 'AMBIGUOUS' WHEN universal THEN 'OVERSTATED' ELSE 'UNSUPPORTED' END AS verdict,
  CAST(CASE WHEN cited THEN 0.65 WHEN universal THEN 0.8 ELSE 0.75 END AS DOUBLE) AS confidence,
  CASE WHEN NOT cited AND universal THEN 'missing_citation,absolute_qualifier_mismatch' ELSE 'missing_citation' END AS flags
FROM k
"""


def a12(spark, sf_dir):
    """Every claim's verdict with its reasons and fix, from the links that are valid, and what was left out."""
    code = F.when(F.col("claim_id") % 3 == 0, "missing_segment").when(F.col("segment_id") % 5 == 0, "outside_evidence_bundle").when(F.col("segment_id") % 7 == 0, "")
    links = views.text_links(spark, sf_dir).withColumn("code", code)
    verdicts = verify.verify_all(views.claims(spark, sf_dir), links.filter("code IS NULL"), views.segments(spark, sf_dir))
    told = verify.with_exclusions(verdicts, links.filter("code IS NOT NULL").withColumn("code", F.nullif("code", F.lit(""))))
    return told.withColumn("flags", F.array_join("flags", ",")).withColumn("reasoning", F.array_join("reasoning", " "))


_q = lambda t: "'" + t.replace("'", "''") + "'"
_said = lambda f, said: f"CASE WHEN list_contains(flags, '{f}') THEN " + ("unanchored || " + _q(said[3:]) if said.startswith("{n}") else _q(said)) + " END"
A12 = f"""{MEASURED.replace("FROM text_links l JOIN", "FROM valid l JOIN").replace("""
  c AS (SELECT claim_id, text AS claim""", """
  coded AS (SELECT *, CASE WHEN claim_id % 3 = 0 THEN 'missing_segment' WHEN segment_id % 5 = 0 THEN 'outside_evidence_bundle' WHEN segment_id % 7 = 0 THEN '' END AS code FROM text_links),
  valid AS (SELECT * FROM coded WHERE code IS NULL),
  c AS (SELECT claim_id, text AS claim""", 1)},
  bad AS (SELECT claim_id, nullif(code, '') AS code, link_order FROM coded WHERE code IS NOT NULL),
  per AS (SELECT claim_id, coalesce(code, 'invalid_support_link') AS shown, code, count(*) AS n, min(link_order) AS f FROM bad GROUP BY ALL),
  notes AS (SELECT claim_id, coalesce(list(code ORDER BY f, code) FILTER (code IS NOT NULL), []) AS codes,
    'Excluded ' || CAST(sum(n) AS BIGINT) || ' invalid support link(s) from reasoning: ' || string_agg(n || ' ' || replace(shown, '_', ' '), ', ' ORDER BY shown) || '.' AS note FROM per GROUP BY claim_id),
  k AS (SELECT claim_id, {D.found("text", rules.CASE_CITED)} AS cited, {D.found(M, rules.UNIVERSAL)} AS universal FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM valid)),
  al AS (SELECT claim_id, flags, verdict, CASE
      WHEN list_contains(flags, 'invalid_anchor') THEN 0.3 WHEN list_contains(flags, 'contextual_support_only') THEN 0.35
      WHEN verdict = 'SUPPORTED' THEN 0.85 WHEN verdict = 'PARTIALLY_SUPPORTED' THEN 0.65
      WHEN verdict = 'OVERSTATED' THEN CASE WHEN o >= 0.45 THEN 0.55 ELSE 0.4 END WHEN verdict = 'AMBIGUOUS' THEN 0.4 ELSE 0.25 END AS confidence,
      concat_ws(' ', {", ".join(_said(f, said) for f, said, _ in verify.SAID)}, CASE WHEN len(flags) = 0 THEN {_q(verify.NO_FLAGS)} END, CASE WHEN all_weak THEN {_q(verify.ALL_WEAK[0])} END,
        CASE verdict {" ".join(f"WHEN '{v}' THEN {_q(x)}" for v, x in verify.OF_VERDICT.items())} END) AS reasoning,
      coalesce({", ".join(f"CASE WHEN list_contains(flags, '{f}') THEN {_q(fix)} END" for f, _, fix in verify.SAID if fix)}, CASE WHEN all_weak THEN {_q(verify.ALL_WEAK[1])} END) AS fix
    FROM v
    UNION ALL SELECT claim_id, CASE WHEN NOT cited AND universal THEN ['missing_citation', 'absolute_qualifier_mismatch'] ELSE ['missing_citation'] END,
      CASE WHEN cited THEN 'AMBIGUOUS' WHEN universal THEN 'OVERSTATED' ELSE 'UNSUPPORTED' END, CASE WHEN cited THEN 0.65 WHEN universal THEN 0.8 ELSE 0.75 END,
      CASE WHEN cited THEN {_q(verify.UNLINKED[0][0])} WHEN universal THEN {_q(verify.UNLINKED[1][0])} ELSE {_q(verify.UNLINKED[2][0])} END,
      CASE WHEN cited THEN {_q(verify.UNLINKED[0][1])} WHEN universal THEN {_q(verify.UNLINKED[1][1])} ELSE {_q(verify.UNLINKED[2][1])} END FROM k)
SELECT claim_id, array_to_string(list_concat(flags, [x FOR x IN coalesce(codes, []) IF NOT list_contains(flags, x)]), ',') AS flags, verdict, CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN note IS NOT NULL AND list_contains(flags, 'missing_citation') THEN {_q(verify.NONE_REMAIN[0])} ELSE reasoning END AS reasoning,
  CASE WHEN note IS NOT NULL AND list_contains(flags, 'missing_citation') THEN {_q(verify.NONE_REMAIN[1])} ELSE coalesce(fix, CASE WHEN note IS NOT NULL THEN {_q(verify.SOME_INVALID)} END) END AS suggested_fix,
  note AS exclusion_note
FROM al LEFT JOIN notes USING (claim_id)
"""


def j13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    statements = docs.join(views.claims(spark, sf_dir).withColumnRenamed("text", "claim"), F.col("doc_id") % views.items(spark, sf_dir) == F.col("item_id"))
    statements = statements.filter("seq = 0").select(F.col("doc_id").alias("statement_id"), "doc_id", F.col("claim").alias("text"))
    return suggest.statement_verdicts(statements, docs)


DOC = lambda c: D.tokens(D.matchable(c), rules.DOCUMENT_STOP, 2)
J13 = rf"""{with_views("claims")},
  st AS (SELECT doc_id, {DOC("c.text")} AS mine FROM documents d JOIN claims c ON d.doc_id % (SELECT count(*) FROM benchmark) = c.item_id WHERE seq = 0),
  ln AS (SELECT * FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE line <> ''),
  pr AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ln),
  sn AS (SELECT doc_id, 0 AS tier, pos, line AS snippet FROM pr UNION ALL SELECT doc_id, 1, pos, line || ' ' || nxt FROM pr WHERE nxt IS NOT NULL),
  sc AS (SELECT st.doc_id, mine, tier, pos, snippet, {DOC("snippet")} AS theirs FROM st LEFT JOIN sn USING (doc_id)),
  so AS (SELECT *, coalesce({D.overlap("mine", "theirs")}, 0) AS o FROM sc),
  b0 AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, tier, pos) = 1),
  b AS (SELECT doc_id, o, CASE WHEN o > 0 THEN snippet END AS snippet,
    len([k FOR k IN mine IF list_contains({D.listed(rules.DOCUMENT_QUALIFIERS)}, k) AND NOT (o > 0 AND list_contains(theirs, k))]) > 0 AS mm FROM b0)
SELECT doc_id AS statement_id, round(o, 6) AS overlap, snippet, mm AS qualifier_mismatch,
  CASE WHEN o >= 0.58 AND NOT mm THEN 'SUPPORTED' WHEN o >= 0.42 AND NOT mm THEN 'PARTIALLY_SUPPORTED' WHEN o >= 0.3 AND mm THEN 'OVERSTATED'
    WHEN o >= 0.22 THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END AS verdict,
  CAST(CASE WHEN o >= 0.58 AND NOT mm THEN 0.84 WHEN o >= 0.42 AND NOT mm THEN 0.68 WHEN o >= 0.3 AND mm THEN 0.66
    WHEN o >= 0.22 THEN 0.52 ELSE 0.74 END AS DOUBLE) AS confidence
FROM b
"""


def j14(spark, sf_dir):
    return graph.claim_edges(views.graph_claims(spark, sf_dir))


EDGES = views.SQL["graph_claims"] + f""",
  p0 AS (SELECT draft_id, claim_id, {M} AS normal, {D.claim_type("text")} AS type, {D.tokens(M, rules.GRAPH_STOP)} AS t FROM graph_claims),
  p AS (SELECT *, list_has_any(t, {D.listed(rules.NEGATIONS)}) AS neg, [k FOR k IN t IF NOT list_contains({D.listed(rules.NEGATIONS)}, k)] AS core FROM p0 WHERE len(t) > 0),
  pairs AS (SELECT a.draft_id, a.claim_id AS l, b.claim_id AS r, a.normal = b.normal AS same, a.type AS lt, b.type AS rt, len(a.core) AS ln, len(b.core) AS rn,
    len(list_intersect(a.core, b.core)) AS n_both, a.neg <> b.neg AS opposite FROM p a JOIN p b ON a.draft_id = b.draft_id AND a.claim_id < b.claim_id),
  ruled AS (SELECT *, NOT same AND opposite AND least(ln, rn) >= 2 AND n_both / least(ln, rn) >= 0.8 AS contra FROM pairs),
  edges AS (
    SELECT draft_id, l AS source_id, r AS target_id, 'duplicate_of' AS relation, CAST(1.0 AS DOUBLE) AS confidence FROM ruled WHERE same
    UNION ALL SELECT draft_id, r, l, 'duplicate_of', 1.0 FROM ruled WHERE same
    UNION ALL SELECT draft_id, l, r, 'contradicts', 0.91 FROM ruled WHERE contra
    UNION ALL SELECT draft_id, r, l, 'contradicts', 0.91 FROM ruled WHERE contra
    UNION ALL SELECT draft_id, l, r, 'depends_on', 0.73 FROM ruled WHERE NOT same AND NOT contra AND rn > 0 AND ln >= rn + 2 AND n_both = rn
    UNION ALL SELECT draft_id, r, l, 'depends_on', 0.73 FROM ruled WHERE NOT same AND NOT contra AND ln > 0 AND rn >= ln + 2 AND n_both = ln
    UNION ALL SELECT draft_id, l, r, 'supports', 0.68 FROM ruled WHERE NOT same AND NOT contra AND ln > 0 AND rn > 0 AND lt IN ('FACT', 'QUOTE', 'MIXED') AND rt IN ('INFERENCE', 'MIXED') AND n_both / rn >= 0.6
    UNION ALL SELECT draft_id, r, l, 'supports', 0.68 FROM ruled WHERE NOT same AND NOT contra AND ln > 0 AND rn > 0 AND rt IN ('FACT', 'QUOTE', 'MIXED') AND lt IN ('INFERENCE', 'MIXED') AND n_both / ln >= 0.6)"""
J14 = f"""{with_views("claims")},{EDGES}
SELECT * FROM edges
"""

QUERIES = {
    "j7_support_suggestion": j7, "f1_text_rules": f_text, "f6_evidence_roles": f6_roles, "a4_verify_claims": a4, "d1_unlinked_verdicts": d1,
    "j13_statement_vs_document": j13, "j14_claim_graph": j14, "a12_reasoned_verdicts": a12,
}
SQL = {
    "j7_support_suggestion": J7, "f1_text_rules": F_TEXT, "f6_evidence_roles": F6_ROLES, "a4_verify_claims": A4, "d1_unlinked_verdicts": D1,
    "j13_statement_vs_document": J13, "j14_claim_graph": J14, "a12_reasoned_verdicts": A12,
}
