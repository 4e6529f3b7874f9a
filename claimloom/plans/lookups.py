"""Queries on lookups, citations in documents, queues and draft summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import duck as D
from claimloom.operators import authority, graph, history, lookups, review, scope
from claimloom.plans.citations import CITES, PATTERN, citations
from claimloom.plans.evidence import EDGES
from claimloom.plans.workflow import RUNS, W9_CTE, _latest, _runs, j5
from claimloom.plans.workflow import J5_CTE
from claimloom.sources import views
from claimloom.sources.views import table, with_views


def _keys(spark, sf_dir):
    """Each citation's whole key; every fourth case is cited once more, under the negative id."""
    rows = authority.parsed(citations(spark, sf_dir).drop("own", "s"))
    k = F.col("cite_id")
    ids = F.when(k % 4 == 2, F.array(k, -k)).otherwise(F.array(k))
    return rows.select(F.explode(ids).alias("cite_id"), F.lit("register").alias("provider"), F.coalesce("reference", F.lit("||||")).alias("lookup_key"))


def _cache(keys):
    old = keys.filter("cite_id % 3 = 1").groupBy("provider", "lookup_key").agg(F.min("cite_id").alias("k"))
    return old.select("provider", "lookup_key", F.when(F.col("k") % 4 == 0, "authority_not_found").otherwise("authority_found").alias("lookup_status"))


def j10(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    return lookups.cache_first(keys, _cache(keys)).select("cite_id", "lookup_key", "lookup_status")


def j10_misses(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    return lookups.to_fetch(lookups.cache_first(keys, _cache(keys))).select("lookup_key", "asked")


KEYS = CITES + """,
  ky AS (SELECT cite_id, reference AS lookup_key FROM parsed UNION ALL SELECT -cite_id, reference FROM parsed WHERE cite_id % 4 = 2),
  ch AS (SELECT lookup_key, CASE WHEN min(cite_id) % 4 = 0 THEN 'authority_not_found' ELSE 'authority_found' END AS lookup_status FROM ky WHERE cite_id % 3 = 1 GROUP BY 1)"""
J10 = KEYS + " SELECT cite_id, lookup_key, lookup_status FROM ky LEFT JOIN ch USING (lookup_key)"
J10_MISSES = KEYS + " SELECT lookup_key, count(*) AS asked FROM ky ANTI JOIN ch USING (lookup_key) GROUP BY 1"


def j11(spark, sf_dir):
    rows = authority.parsed(citations(spark, sf_dir).drop("own", "s"))
    k = F.col("cite_id")
    cluster = lambda i, name, year: F.to_json(F.struct(F.concat(F.lit(f"c{i}-"), k.cast("string")).alias("id"), name.alias("case_name"), year.alias("date_filed")))
    other = F.lit("Nation99 v. Nation98")
    year = F.concat((1950 + k % 70).cast("string"), F.lit("-05-06"))
    wrong = F.concat((1950 + (k + 1) % 70).cast("string"), F.lit("-05-06"))
    clusters = F.concat_ws(",", cluster(0, other, year), F.when(k % 5 != 0, cluster(1, F.col("case_name"), F.when(k % 7 == 0, wrong).otherwise(year))))
    clusters = F.when(k % 11 == 0, "").when(k % 13 == 0, cluster(2, F.col("case_name"), wrong)).otherwise(clusters)
    status = F.when(k % 17 == 0, 404).when(k % 19 == 0, 429).when(k % 23 == 0, 503).when(k % 29 == 0, 400).otherwise(200)
    payload = F.when(k % 31 != 0, F.concat(F.lit('{"status": '), status.cast("string"), F.lit(', "clusters": ['), clusters, F.lit("]}")))
    rows = rows.withColumn("payload", payload).withColumn("page", F.when(k % 37 != 0, F.col("page")))
    return lookups.adjudicated(rows)


J11 = CITES + """,
  k AS (SELECT cite_id AS k, year FROM parsed),
  x AS (SELECT k, year IS NULL AS noyear, k % 11 = 0 AS none, k % 13 = 0 AS lone, k % 5 <> 0 AS two, k % 7 = 0 AS wrong FROM k)
SELECT k AS cite_id, CASE WHEN k % 37 = 0 THEN 'lookup_missing_fields' WHEN k % 31 = 0 THEN 'lookup_unavailable' WHEN k % 17 = 0 OR none THEN 'authority_not_found' WHEN k % 19 = 0 OR k % 23 = 0 THEN 'lookup_unavailable'
    WHEN k % 29 = 0 THEN 'lookup_error' WHEN lone THEN CASE WHEN noyear THEN 'authority_found' ELSE 'authority_year_mismatch' END
    WHEN two AND (noyear OR NOT wrong) THEN 'authority_found' ELSE 'authority_name_mismatch' END AS lookup_status,
  CASE WHEN k % 37 = 0 OR k % 31 = 0 OR k % 17 = 0 OR none OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 THEN NULL WHEN lone THEN 'c2-' || k WHEN two AND (noyear OR NOT wrong) THEN 'c1-' || k ELSE 'c0-' || k END AS cluster_id
FROM x"""


def f17(spark, sf_dir):
    """Citing sentences of a draft as one text, cut again into citations and propositions."""
    rows = citations(spark, sf_dir)
    whole = rows.groupBy("draft_id", (F.col("cite_id") / 400).cast("int").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cite_id", "proposition"))), lambda x: x["proposition"]), " ").alias("text"))
    return lookups.citation_pairs(whole.select((F.col("draft_id") * 1_000_000 + F.col("part")).alias("doc_id"), "text"))


_LAST_END, _FIRST_END = r"(?s)^(.*(?:^|[^vV])[.?!])\s*\p{Lu}", r"(?s)^(.*?(?:^|[^vV])[.?!])\s*(?:\p{Lu}|$)"
F17 = CITES + f""",
  wh AS (SELECT draft_id * 1000000 + part AS doc_id, string_agg(proposition, ' ' ORDER BY cite_id) AS text
    FROM (SELECT cite_id, cite_id // 1200 AS draft_id, cite_id // 400 AS part, signal || citation || ' held that ' || CASE WHEN cite_id % 3 = 0 THEN 'all ' ELSE '' END || s[1] || '.' AS proposition FROM cites) GROUP BY 1),
  fo AS (SELECT doc_id, text, regexp_extract_all(text, {PATTERN}) AS found, regexp_split_to_array(text, {PATTERN}) AS gaps FROM wh),
  pl AS (SELECT doc_id, text, unnest(found) AS found, unnest([list_sum([length(g) FOR g IN gaps[1 : i]]) + coalesce(list_sum([length(g) FOR g IN found[1 : i - 1]]), 0) FOR i IN range(1, len(found) + 1)]) AS start FROM fo WHERE len(found) > 0),
  li AS (SELECT *, start + length(found) AS finish, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) AS lim FROM pl),
  se AS (SELECT *, length(regexp_extract(text[1 : CAST(start AS BIGINT) + 1], {D.quoted(_LAST_END)}, 1)) AS b, length(regexp_extract(text[CAST(finish AS BIGINT) + 1 :], {D.quoted(_FIRST_END)}, 1)) AS e FROM li)
SELECT doc_id, regexp_replace(found, '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS citation, CAST(start AS INTEGER) AS start, CAST(finish AS INTEGER) AS "end",
  regexp_replace(text[b + 1 : CAST(CASE WHEN e = 0 THEN lim ELSE least(lim, finish + e) END AS BIGINT)], '^\\s+|\\s+$', '', 'g') AS proposition FROM se"""


def j17(spark, sf_dir):
    cites = citations(spark, sf_dir)
    k = F.col("cite_id")
    given = F.when(k % 8 == 0, "  ").when(k % 8 == 1, "no case at all").otherwise(F.col("cite_text"))
    own = F.when(k % 8 == 2, "A text without any.").when(k % 8 == 3, F.regexp_replace("cite_text", r" v\. ", " North v. ")).when(k % 8 == 4, F.regexp_replace("cite_text", r"\((\d)", "(2d Cir. $1")).otherwise(F.col("cite_text"))
    fields = ("case_name", "volume", "reporter", "page", "year")
    mine = authority.parsed(cites.select("cite_id", given.alias("cite_text")))
    theirs = authority.parsed(cites.select("cite_id", F.substring(own, 1, 4000).alias("cite_text"))).select("cite_id", *[F.col(f).alias(f"own_{f}") for f in fields])
    return mine.join(theirs, "cite_id").select("cite_id", lookups.document_match().alias("match"))


J17 = CITES + """ SELECT cite_id, CASE cite_id % 8 WHEN 0 THEN 'citation_not_provided' WHEN 1 THEN 'citation_unresolved' WHEN 2 THEN 'citation_recognized' WHEN 3 THEN 'citation_mismatch' ELSE 'citation_matches_pdf' END AS match FROM parsed"""


def s6(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "Motion to  dismiss\nNation1 v. Nation2\n\n").when(F.col("doc_id") % 3 == 1, "A heading. With a stop\nNation1 v. Nation2\n \t\n").otherwise("")
    return d.select("doc_id", F.sha2(lookups.split_heading(F.concat(head, "text")), 256).alias("text_sha256"))


S6 = r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Motion to  dismiss' || chr(10) || 'Nation1 v. Nation2' || chr(10) || chr(10) WHEN 1 THEN 'A heading. With a stop' || chr(10) || 'Nation1 v. Nation2' || chr(10) || ' ' || chr(9) || chr(10) ELSE '' END || text AS t FROM documents),
  l AS (SELECT doc_id, [y FOR y IN [trim(regexp_replace(z, '[ \t\r\f\v]+', ' ', 'g'), ' ') FOR z IN string_split(t, chr(10))] IF y <> ''] AS ls FROM x)
SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN ls[1] || chr(10) || chr(10) || array_to_string(ls[2:], chr(10)) ELSE array_to_string(ls, chr(10)) END) AS text_sha256 FROM l"""


def a13(spark, sf_dir):
    """Excluded links by code over a claim matter, in first-seen order."""
    rows = j5(spark, sf_dir).filter("code IS NOT NULL")
    counts = rows.groupBy((F.abs("claim_id") % 30).alias("audit"), "code").agg(F.count("*").alias("n"), F.min(F.struct(F.abs("claim_id").alias("c"), F.abs("segment_id").alias("s"))).alias("first"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "code", "n"))), lambda x: F.concat(x["code"], F.lit(" x"), x["n"].cast("string")))
    return counts.groupBy("audit").agg(F.array_join(parts, "; ").alias("excluded"))


A13 = J5_CTE + """, k AS (SELECT abs(claim_id) % 30 AS audit, code, count(*) AS n, min((abs(claim_id), abs(segment_id))) AS f FROM checked WHERE code IS NOT NULL GROUP BY 1, 2)
SELECT audit, string_agg(code || ' x' || n, '; ' ORDER BY f, code) AS excluded FROM k GROUP BY audit"""


def p2(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    flags = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("no flags")
    line = F.concat("verdict", F.lit(" "), F.col("claim_id").cast("string"), F.lit(" @ "), F.coalesce("anchor", F.lit("no primary anchor")), F.lit(" ["), flags, F.lit("]"))
    listed = review.flagged(latest).select("draft_id", F.struct("claim_id", line.alias("line")).alias("x")).groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "; ").alias("listed"))
    counts = review.verdict_counts(latest).join(listed, "draft_id", "left")
    verdicts = F.concat_ws(", ", *[F.concat(F.lit(f"{v.lower()}="), F.col(v.lower()).cast("string")) for v in review.COUNTED])
    return counts.select("draft_id", F.concat(
        F.lit("Draft "), F.col("draft_id").cast("string"), F.lit(" compile summary. Total claims: "), F.col("total_claims").cast("string"), F.lit(". Verdicts: "), verdicts,
        F.lit(". Flagged claims: "), F.coalesce("listed", F.lit("none")), F.lit("."),
    ).alias("summary"))


P2 = RUNS + """,
  n AS (SELECT draft_id, 'Draft ' || draft_id || ' compile summary. Total claims: ' || count(*) || '. Verdicts: supported=' || count(*) FILTER (verdict = 'SUPPORTED') || ', partially_supported=' || count(*) FILTER (verdict = 'PARTIALLY_SUPPORTED')
    || ', overstated=' || count(*) FILTER (verdict = 'OVERSTATED') || ', ambiguous=' || count(*) FILTER (verdict = 'AMBIGUOUS') || ', unsupported=' || count(*) FILTER (verdict = 'UNSUPPORTED') || ', unverified=0' AS a FROM latest GROUP BY draft_id),
  l AS (SELECT draft_id, string_agg(verdict || ' ' || claim_id || ' @ ' || coalesce(anchor, 'no primary anchor') || ' [' || CASE WHEN len(flags) > 0 THEN array_to_string(flags, ', ') ELSE 'no flags' END || ']', '; ' ORDER BY claim_id) AS b FROM flagged GROUP BY 1)
SELECT draft_id, a || '. Flagged claims: ' || coalesce(b, 'none') || '.' AS summary FROM n LEFT JOIN l USING (draft_id)"""


def a6(spark, sf_dir):
    """A draft's risk distribution, weak, changed and contradicted claims, clusters of weak support and pairs of edges."""
    runs = _runs(spark, sf_dir)
    rows = history.change_summary(runs)
    verdicts = runs.groupBy("claim_id").agg((F.count_distinct("verdict") > 1).alias("unstable"))
    edges = graph.claim_edges(views.graph_claims(spark, sf_dir))
    against = edges.filter("relation = 'contradicts'").select(F.col("source_id").alias("claim_id"), F.lit(True).alias("against")).distinct()
    rows = rows.join(verdicts, "claim_id").join(against, "claim_id", "left")
    weak = F.array_contains("categories", "weak_support")
    ids = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("claim_id")))), ",")
    each = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in review.COUNTED]
    drafts = rows.groupBy("draft_id").agg(
        *each, ids(weak).alias("weak_claims"), ids(F.col("unstable")).alias("changed_claims"), ids(F.col("unstable") | F.col("against")).alias("contradiction_claims"), F.max("score").cast("long").alias("top_score"),
    )
    flags = rows.filter(weak).select("draft_id", F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("weak_support")))).alias("flag"))
    ranked = flags.groupBy("draft_id", "flag").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("draft_id").orderBy(F.desc("n"), "flag"))).filter("place <= 5")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "flag", "n"))), lambda x: F.concat_ws("=", x["flag"], x["n"])), ",")
    clusters = ranked.groupBy("draft_id").agg(listed.alias("weak_clusters"))
    pair = F.struct(F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))
    pairs = edges.groupBy("draft_id").agg(*[F.count_distinct(F.when(F.col("relation") == r, pair)).alias(f"{r}_pairs") for r in ("contradicts", "duplicate_of")])
    joined = drafts.join(clusters, "draft_id", "left").join(pairs, "draft_id", "left")
    return joined.fillna({"weak_clusters": "", "contradicts_pairs": 0, "duplicate_of_pairs": 0})


_COUNTS = ", ".join(f"count(*) FILTER (l.verdict = '{v}') AS {v.lower()}" for v in review.COUNTED)
A6 = W9_CTE.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["claims"] + "," + EDGES + ",") + f""",
  un AS (SELECT claim_id, count(DISTINCT verdict) > 1 AS unstable FROM runs GROUP BY 1),
  dr AS (SELECT s.draft_id, {_COUNTS}, coalesce(string_agg(CASE WHEN list_contains(l.categories, 'weak_support') THEN claim_id END, ',' ORDER BY claim_id), '') AS weak_claims,
      coalesce(string_agg(CASE WHEN unstable THEN claim_id END, ',' ORDER BY claim_id), '') AS changed_claims,
      coalesce(string_agg(CASE WHEN unstable OR claim_id IN (SELECT source_id FROM edges WHERE relation = 'contradicts') THEN claim_id END, ',' ORDER BY claim_id), '') AS contradiction_claims,
      max(CASE WHEN changed THEN score ELSE 0 END) AS top_score
    FROM scored s JOIN latest l USING (claim_id) JOIN un USING (claim_id) GROUP BY s.draft_id),
  fl AS (SELECT draft_id, unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['weak_support'] END) AS flag FROM latest WHERE list_contains(categories, 'weak_support')),
  fn AS (SELECT draft_id, flag, count(*) AS n FROM fl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, flag) <= 5),
  cl AS (SELECT draft_id, string_agg(flag || '=' || n, ',' ORDER BY n DESC, flag) AS weak_clusters FROM fn GROUP BY 1),
  pa AS (SELECT draft_id, count(DISTINCT (least(source_id, target_id), greatest(source_id, target_id))) FILTER (relation = 'contradicts') AS a,
      count(DISTINCT (least(source_id, target_id), greatest(source_id, target_id))) FILTER (relation = 'duplicate_of') AS b FROM edges GROUP BY 1)
SELECT dr.*, coalesce(weak_clusters, '') AS weak_clusters, coalesce(a, 0) AS contradicts_pairs, coalesce(b, 0) AS duplicate_of_pairs
FROM dr LEFT JOIN cl USING (draft_id) LEFT JOIN pa USING (draft_id)"""


def o2(spark, sf_dir):
    """O2: each draft's flagged claims by severity, then the draft's order; places within sections."""
    rows = review.flagged(_latest(spark, sf_dir)).withColumn("rank", review.severity(F.col("verdict")))
    order = Window.partitionBy("draft_id").orderBy("rank", "claim_id")
    section = Window.partitionBy("draft_id", "verdict").orderBy("claim_id")
    return rows.select("draft_id", "claim_id", "verdict", F.row_number().over(order).alias("place"), F.row_number().over(section).alias("in_section"))


O2 = RUNS + """ SELECT draft_id, claim_id, verdict, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY rank0, claim_id) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY draft_id, verdict ORDER BY claim_id) AS INTEGER) AS in_section FROM flagged"""


def p4(spark, sf_dir):
    """A claim's history record: runs, decisions, change score, edges, instability."""
    runs = _runs(spark, sf_dir)
    change = history.change_summary(runs).select("claim_id", "run_id", "verdict", "prev_verdict", F.col("score").cast("long").alias("score"))
    decided = views.decisions(spark, sf_dir).groupBy("claim_id").agg(F.count("*").alias("n_decisions"))
    edges = graph.claim_edges(views.graph_claims(spark, sf_dir)).groupBy(F.col("source_id").alias("claim_id")).agg(F.count("*").alias("n_edges"), F.bool_or(F.col("relation") == "contradicts").alias("contradicted"))
    verdicts = runs.groupBy("claim_id").agg((F.count_distinct("verdict") > 1).alias("unstable"))
    rows = change.join(decided, "claim_id", "left").join(edges, "claim_id", "left").join(verdicts, "claim_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("claim_id", "run_id", "verdict", "prev_verdict", "score", zero("n_decisions"), zero("n_edges"), F.coalesce("contradicted", F.lit(False)).alias("contradicted"), "unstable")


P4 = W9_CTE.replace("WITH RECURSIVE", "WITH RECURSIVE" + views.SQL["decisions"] + "," + views.SQL["claims"] + "," + EDGES + ",") + """
SELECT claim_id, run_id, l.verdict, prev_verdict, CASE WHEN changed THEN score ELSE 0 END AS score, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_edges, 0) AS n_edges, coalesce(contradicted, false) AS contradicted, unstable
FROM scored JOIN (SELECT claim_id, verdict FROM latest) l USING (claim_id) LEFT JOIN (SELECT claim_id, count(*) AS n_decisions FROM decisions GROUP BY 1) USING (claim_id)
LEFT JOIN (SELECT source_id AS claim_id, count(*) AS n_edges, bool_or(relation = 'contradicts') AS contradicted FROM edges GROUP BY 1) USING (claim_id)
JOIN (SELECT claim_id, count(DISTINCT verdict) > 1 AS unstable FROM runs GROUP BY 1) USING (claim_id)"""


def j4(spark, sf_dir):
    """A draft's candidate segments: of its bundle's documents, else of its matter's, both in their orders."""
    drafts = views.claims(spark, sf_dir).select("draft_id", "matter").distinct().withColumn("bundle", F.expr("CASE WHEN draft_id % 3 = 0 THEN draft_id END"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("matter"), F.col("n_chars").alias("created_at"), F.col("lang").alias("name"))
    bundles = docs.select(F.expr("doc_id div 10").alias("bundle"), "doc_id")
    allowed = scope.ordered_documents(drafts, bundles, docs)
    order = Window.partitionBy("draft_id", "doc_id").orderBy((~F.col("anchored")).cast("int"), "line_no", "segment_id")
    rows = allowed.select("draft_id", "doc_id", F.col("place").alias("doc_place")).join(views.segments(spark, sf_dir).drop("matter"), "doc_id")
    return rows.select("draft_id", "doc_id", "doc_place", "segment_id", F.row_number().over(order).alias("place"))


J4 = with_views("claims", "segments") + """,
  dr AS (SELECT DISTINCT draft_id, matter, CASE WHEN draft_id % 3 = 0 THEN draft_id END AS bundle FROM claims),
  al AS (SELECT draft_id, doc_id, n_chars, lang FROM dr JOIN documents ON bundle = doc_id // 10 UNION SELECT draft_id, doc_id, n_chars, lang FROM dr JOIN documents ON matter = source WHERE bundle IS NULL),
  od AS (SELECT draft_id, doc_id, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY n_chars NULLS FIRST, lang NULLS FIRST, doc_id) AS INTEGER) AS doc_place FROM al)
SELECT draft_id, doc_id, doc_place, segment_id, CAST(row_number() OVER (PARTITION BY draft_id, doc_id ORDER BY CASE WHEN anchored THEN 0 ELSE 1 END, line_no, segment_id) AS INTEGER) AS place
FROM od JOIN segments USING (doc_id)"""

_ALL = {
    "j4_candidate_segments": (j4, J4), "j10_cached_lookups": (j10, J10), "j10_lookup_misses": (j10_misses, J10_MISSES), "j11_adjudicated_lookups": (j11, J11), "f17_citation_propositions": (f17, F17),
    "j17_citation_vs_document": (j17, J17), "s6_prepared_text": (s6, S6), "a13_excluded_by_code": (a13, A13), "p2_compile_summary": (p2, P2), "a6_draft_intelligence": (a6, A6), "o2_queue_order": (o2, O2),
    "p4_claim_history": (p4, P4),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
