"""The given tables in the shape of the jobs' inputs: claims, segments, links, runs.

Each function makes a DataFrame from a folder of tables; SQL holds the same views
for DuckDB, as common table expressions by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> int:
    """How many benchmark items there are, by which documents and citations are dealt to them."""
    return max(1, table(spark, sf_dir, "benchmark").count())


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as record segments of three source types, with places and phrases by position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n, kind = F.col("line_no"), F.col("doc_id") % 3
    lines = docs.withColumn("line_no", F.col("pos") + 1).filter(F.trim("line") != "")
    segment_type = (
        F.when(n % 11 == 0, "UNANCHORED_TEXT")
        .when(kind == 0, F.when(n % 2 == 1, "QUESTION_BLOCK").otherwise("ANSWER_BLOCK"))
        .when(kind == 1, F.when(n % 3 == 1, "DECLARATION_PARAGRAPH").otherwise("DECLARATION_BLOCK"))
        .otherwise(F.when(n % 3 == 0, "EXHIBIT_LABELED_BLOCK").when(n % 3 == 1, "EXHIBIT_PAGE_BLOCK").otherwise("EXHIBIT_TEXT_BLOCK"))
    )
    speaker = (
        F.when(n % 11 == 0, F.lit(None))
        .when(kind == 0, F.when(n % 2 == 1, "Q").otherwise("A"))
        .when(kind == 1, F.when(n % 3 == 1, F.concat(F.lit("DECLARANT ¶"), n.cast("string"))).otherwise("DECLARANT"))
        .when(n % 3 == 0, F.when(n % 6 == 0, "Subject").otherwise("Note"))
    )
    phrase = (
        F.when(n % 7 == 0, " I do not recall").when(n % 13 == 0, " once on 2024-05-06").when(n % 17 == 0, " executed on that day")
        .when(n % 19 == 0, " Because Morgan knew it").otherwise("")
    )
    return lines.select(
        (F.col("doc_id") * 10000 + n).alias("segment_id"), "doc_id", F.col("source").alias("matter"), "line_no",
        segment_type.alias("segment_type"), speaker.alias("speaker"), F.concat("line", phrase).alias("raw_text"),
        (n % 11 != 0).alias("anchored"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of benchmark passages as claims, two items a draft, with cues by position."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "piece"))
    at = F.col("pos") % 9
    first = F.substring_index(F.trim("piece"), " ", 2)
    cue = (
        F.when(at == 1, " and was not signed").when(at == 2, " because of the daily reports").when(at == 3, " and all were reviewed")
        .when(at == 4, ", which suggests more").when(at == 5, F.concat(F.lit(' "'), first, F.lit('"'))).when(at == 6, " as Morgan knew and approved")
        .when(at == 7, " always and was signed").otherwise("")
    )
    return items.filter(F.trim("piece") != "").select(
        (F.col("item_id") * 100 + F.col("pos")).alias("claim_id"), "item_id", F.expr("item_id div 2").alias("draft_id"),
        F.concat(F.lit("src"), F.expr("item_id div 2 % 20").cast("string")).alias("matter"), F.col("pos").alias("seq"),
        F.concat("piece", cue).alias("text"),
    )


def graph_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draft_id, claim_id, text: the claims, and after each, by turns, it denied, widened, drawn as a conclusion or in capitals, under its negative id."""
    c = claims(spark, sf_dir).select("draft_id", "claim_id", "text")
    turn = F.col("claim_id") % 4
    other = (
        F.when(turn == 0, F.concat("text", F.lit(" not"))).when(turn == 1, F.concat("text", F.lit(" beside harbour walls")))
        .when(turn == 2, F.concat("text", F.lit(", which suggests more"))).otherwise(text.capitals(F.col("text")))
    )
    return c.unionByName(c.select("draft_id", (-F.col("claim_id") - 1).alias("claim_id"), other.alias("text")))


def text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of claims to segments at the same place of the documents dealt to their item."""
    c = claims(spark, sf_dir).select("claim_id", "item_id", "seq")
    s = segments(spark, sf_dir).select("segment_id", "doc_id", "line_no")
    on = (F.col("item_id") == F.col("doc_id") % items(spark, sf_dir)) & (F.col("line_no") == F.col("seq") + 1)
    return c.join(s, on).select("claim_id", "segment_id", F.col("doc_id").alias("link_order"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verification runs: claim_id, run_id, created_at, draft_id, verdict, confidence, flags, anchor."""
    e = table(spark, sf_dir, "events")
    verdict = (
        F.when(F.col("event_type") == "signup", "SUPPORTED").when(F.col("event_type") == "view", "PARTIALLY_SUPPORTED")
        .when(F.col("event_type") == "click", "AMBIGUOUS").when(F.col("event_type") == "error", "UNSUPPORTED").otherwise("OVERSTATED")
    )
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    flags = F.filter(
        F.array(*[F.when(k.bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(RUN_FLAGS)]), lambda f: f.isNotNull()
    )
    return e.select(
        F.col("user_id").alias("claim_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"),
        F.expr("user_id div 6").alias("draft_id"), verdict.alias("verdict"), F.round("value", 2).alias("confidence"), flags.alias("flags"),
        F.when(k % 3 == 0, F.concat(F.lit("p."), (k % 7).cast("string"))).alias("anchor"), (k % 4).alias("n_support"), (k % 3).alias("n_excluded"),
    )


RUN_FLAGS = ("contextual_support_only", "narrow_support", "absolute_qualifier_mismatch", "needs_human_review", "temporal_scope_mismatch")


ACTIONS = ("ACKNOWLEDGE_RISK", "MARK_FOR_REVISION", "RESOLVE_WITH_EDIT")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event of two users in three as a review decision on the claim."""
    e = table(spark, sf_dir, "events").filter("event_id % 7 = 0 AND user_id % 3 != 0")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % 3 + 1).cast("int"))
    note = F.when(F.col("event_id") % 4 == 1, "  ").when(F.col("event_id") % 4 > 1, F.concat(F.lit(" seen "), F.col("user_id").cast("string")))
    return e.select(
        F.col("event_id").alias("decision_id"), F.col("user_id").alias("claim_id"), F.expr("user_id div 6").alias("draft_id"),
        F.col("ts").alias("created_at"), action.alias("action"), note.alias("note"),
        F.when(F.col("event_id") % 5 < 2, "Narrower text.").when(F.col("event_id") % 5 == 2, " ").alias("replacement"),
    )


def review_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review run of each draft at noon of each day on which every fifth event fell."""
    e = table(spark, sf_dir, "events").filter("event_id % 5 = 0")
    noon = F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")
    return e.filter("user_id div 6 % 25 != 24").groupBy(F.expr("user_id div 6").alias("draft_id"), noon.alias("created_at")).agg(F.min("event_id").alias("review_id"))


def support_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as links of orders (claims) to suppliers (segments), with dangling ends by rule."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("seq"), F.min("l_returnflag").alias("link_type")
    )
    claim = F.when(F.col("l_orderkey") % 97 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    segment = F.when(F.col("l_suppkey") % 41 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey"))
    return rows.select(claim.alias("claim_id"), segment.alias("segment_id"), "seq", "link_type")


def claim_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, draft_id, matter, bundle (null without one) by order -> customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    bundle = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 7)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("claim_id"), F.col("c_custkey").alias("draft_id"), (F.col("c_nationkey") % 3).alias("matter"), bundle.alias("bundle")
    )


def segment_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, doc_id, matter of the suppliers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("segment_id"), F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 3).alias("matter"))


def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle, doc_id: each bundle holds the suppliers of one remainder."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("bundle"), F.col("s_suppkey").alias("doc_id"))


SQL = {
    "segments": """
  lined AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  segments AS (
    SELECT doc_id * 10000 + n AS segment_id, doc_id, source AS matter, CAST(n AS INTEGER) AS line_no,
      CASE WHEN n % 11 = 0 THEN 'UNANCHORED_TEXT'
        WHEN doc_id % 3 = 0 THEN CASE WHEN n % 2 = 1 THEN 'QUESTION_BLOCK' ELSE 'ANSWER_BLOCK' END
        WHEN doc_id % 3 = 1 THEN CASE WHEN n % 3 = 1 THEN 'DECLARATION_PARAGRAPH' ELSE 'DECLARATION_BLOCK' END
        ELSE CASE n % 3 WHEN 0 THEN 'EXHIBIT_LABELED_BLOCK' WHEN 1 THEN 'EXHIBIT_PAGE_BLOCK' ELSE 'EXHIBIT_TEXT_BLOCK' END END AS segment_type,
      CASE WHEN n % 11 = 0 THEN NULL
        WHEN doc_id % 3 = 0 THEN CASE WHEN n % 2 = 1 THEN 'Q' ELSE 'A' END
        WHEN doc_id % 3 = 1 THEN CASE WHEN n % 3 = 1 THEN 'DECLARANT ¶' || n ELSE 'DECLARANT' END
        WHEN n % 6 = 0 THEN 'Subject' WHEN n % 3 = 0 THEN 'Note' END AS speaker,
      line || CASE WHEN n % 7 = 0 THEN ' I do not recall' WHEN n % 13 = 0 THEN ' once on 2024-05-06' WHEN n % 17 = 0 THEN ' executed on that day'
        WHEN n % 19 = 0 THEN ' Because Morgan knew it' ELSE '' END AS raw_text,
      n % 11 <> 0 AS anchored
    FROM lined WHERE trim(line, ' ') <> '')""",
    "claims": """
  pieces AS (SELECT item_id, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM benchmark),
  claims AS (
    SELECT item_id * 100 + pos AS claim_id, item_id, item_id // 2 AS draft_id, 'src' || (item_id // 2 % 20) AS matter, CAST(pos AS INTEGER) AS seq,
      piece || CASE pos % 9 WHEN 1 THEN ' and was not signed' WHEN 2 THEN ' because of the daily reports' WHEN 3 THEN ' and all were reviewed'
        WHEN 4 THEN ', which suggests more' WHEN 5 THEN ' "' || array_to_string(string_split(trim(piece, ' '), ' ')[1:2], ' ') || '"'
        WHEN 6 THEN ' as Morgan knew and approved' WHEN 7 THEN ' always and was signed' ELSE '' END AS text
    FROM pieces WHERE trim(piece, ' ') <> '')""",
    "graph_claims": """
  graph_claims AS (
    SELECT draft_id, claim_id, text FROM claims
    UNION ALL
    SELECT draft_id, -claim_id - 1, CASE claim_id % 4 WHEN 0 THEN text || ' not' WHEN 1 THEN text || ' beside harbour walls'
      WHEN 2 THEN text || ', which suggests more' ELSE upper(text) END FROM claims)""",
    "text_links": """
  text_links AS (SELECT claim_id, segment_id, doc_id AS link_order FROM claims JOIN segments ON item_id = doc_id % (SELECT count(*) FROM benchmark) AND line_no = seq + 1)""",
    "runs": """
  runs AS (
    SELECT user_id AS claim_id, event_id AS run_id, ts AS created_at, user_id // 6 AS draft_id,
      CASE event_type WHEN 'signup' THEN 'SUPPORTED' WHEN 'view' THEN 'PARTIALLY_SUPPORTED' WHEN 'click' THEN 'AMBIGUOUS'
        WHEN 'error' THEN 'UNSUPPORTED' ELSE 'OVERSTATED' END AS verdict,
      round(value, 2) AS confidence,
      list_filter([CASE WHEN k & 1 <> 0 THEN 'contextual_support_only' END, CASE WHEN k & 2 <> 0 THEN 'narrow_support' END,
        CASE WHEN k & 4 <> 0 THEN 'absolute_qualifier_mismatch' END, CASE WHEN k & 8 <> 0 THEN 'needs_human_review' END,
        CASE WHEN k & 16 <> 0 THEN 'temporal_scope_mismatch' END], lambda f: f IS NOT NULL) AS flags,
      CASE WHEN k % 3 = 0 THEN 'p.' || (k % 7) END AS anchor, k % 4 AS n_support, k % 3 AS n_excluded
    FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events))""",
    "decisions": """
  decisions AS (
    SELECT event_id AS decision_id, user_id AS claim_id, user_id // 6 AS draft_id, ts AS created_at,
      ['ACKNOWLEDGE_RISK', 'MARK_FOR_REVISION', 'RESOLVE_WITH_EDIT'][event_id % 3 + 1] AS action,
      CASE WHEN event_id % 4 = 1 THEN '  ' WHEN event_id % 4 > 1 THEN ' seen ' || user_id END AS note,
      CASE WHEN event_id % 5 < 2 THEN 'Narrower text.' WHEN event_id % 5 = 2 THEN ' ' END AS replacement
    FROM events WHERE event_id % 7 = 0 AND user_id % 3 <> 0)""",
    "review_runs": """
  review_runs AS (
    SELECT user_id // 6 AS draft_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS created_at, min(event_id) AS review_id
    FROM events WHERE event_id % 5 = 0 AND user_id // 6 % 25 <> 24 GROUP BY ALL)""",
    "support_links": """
  support_links AS (
    SELECT CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey ELSE l_orderkey END AS claim_id,
      CASE WHEN l_suppkey % 41 = 0 THEN -l_suppkey ELSE l_suppkey END AS segment_id, min(l_linenumber) AS seq, min(l_returnflag) AS link_type
    FROM lineitem GROUP BY l_orderkey, l_suppkey)""",
    "claim_scope": """
  claim_scope AS (
    SELECT o_orderkey AS claim_id, c_custkey AS draft_id, c_nationkey % 3 AS matter, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 7 END AS bundle
    FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "segment_scope": """
  segment_scope AS (SELECT s_suppkey AS segment_id, s_suppkey AS doc_id, s_nationkey % 3 AS matter FROM supplier)""",
    "bundle_documents": """
  bundle_documents AS (SELECT s_suppkey % 7 AS bundle, s_suppkey AS doc_id FROM supplier)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE" + ",".join(SQL[n] for n in names)
