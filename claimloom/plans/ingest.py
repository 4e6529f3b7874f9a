"""Queries on source texts: the three parsers and their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import ingest
from claimloom.sources import store
from claimloom.sources.raw_lines import SQL as RAW
from claimloom.sources.raw_lines import raw_lines
from claimloom.sources.views import table


def _of(spark, sf_dir, kind):
    return raw_lines(spark, sf_dir).filter(F.col("kind") == kind)


def s2(spark, sf_dir):
    return ingest.transcript_segments(_of(spark, sf_dir, 0))


def s3(spark, sf_dir):
    return ingest.declaration_segments(_of(spark, sf_dir, 1))


def s4(spark, sf_dir):
    return ingest.exhibit_segments(_of(spark, sf_dir, 2))


def s1(spark, sf_dir):
    return ingest.parser_results(table(spark, sf_dir, "documents").select("doc_id", "text"), s2(spark, sf_dir), s3(spark, sf_dir), s4(spark, sf_dir))


got = lambda c, p, g: f"(CASE WHEN regexp_matches({c}, '{p}') THEN nullif(regexp_extract({c}, '{p}', {g}), '') END)"
S2_CTE = f"""WITH RECURSIVE {RAW},
  t0 AS (SELECT doc_id, n, raw, trim(raw, ' ') AS s FROM raw_lines WHERE kind = 0 AND trim(raw, ' ') <> ''),
  t1 AS (SELECT *, CAST({got("s", ingest.PAGE_HEADER, 1)} AS INTEGER) AS header, NOT regexp_matches(s, '{ingest.PAGE_HEADER}') AND regexp_matches(s, '{ingest.INLINE_PLACE}') AS inl FROM t0),
  t2 AS (SELECT *, last_value(coalesce(header, CASE WHEN inl THEN CAST({got("s", ingest.INLINE_PLACE, 1)} AS INTEGER) END) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS pg FROM t1),
  t3 AS (SELECT *, CASE WHEN inl THEN {got("s", ingest.INLINE_PLACE, 2)} WHEN pg IS NOT NULL THEN {got("raw", ingest.NUMBERED_LINE, 1)} END::INTEGER AS num,
    trim(CASE WHEN inl THEN {got("s", ingest.INLINE_PLACE, 3)} WHEN pg IS NOT NULL AND regexp_matches(raw, '{ingest.NUMBERED_LINE}') THEN {got("raw", ingest.NUMBERED_LINE, 2)} ELSE s END, ' ') AS content
    FROM t2 WHERE header IS NULL),
  t4 AS (SELECT doc_id, n, content, num, CASE WHEN num IS NOT NULL THEN pg END AS page,
    CASE WHEN num IS NOT NULL THEN coalesce(upper({got("content", ingest.SPEAKER, 1)}), trim({got("content", ingest.LABEL_SPEAKER, 1)}, ' ')) END AS speaker FROM t3),
  t5 AS (SELECT *, lag(n) OVER w IS NULL OR (num IS NULL) <> (lag(num) OVER w IS NULL)
      OR (num IS NOT NULL AND NOT (page = lag(page) OVER w AND num = lag(num) OVER w + 1 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w)) AS starts
    FROM t4 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
  t6 AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS seg_no FROM t5),
  s2 AS (SELECT doc_id, seg_no, min(page) AS page_start, min(num) AS line_start, max(page) AS page_end, max(num) AS line_end, string_agg(content, chr(10) ORDER BY n) AS raw_text, min(speaker) AS speaker,
    CASE WHEN min(num) IS NULL THEN 'UNANCHORED_TEXT' WHEN min(speaker) = 'Q' THEN 'QUESTION_BLOCK' WHEN min(speaker) = 'A' THEN 'ANSWER_BLOCK' ELSE 'TRANSCRIPT_BLOCK' END AS segment_type
    FROM t6 GROUP BY doc_id, seg_no)"""
S3_PART = f"""
  d0 AS (SELECT doc_id, n, trim(raw, ' ') AS s, regexp_matches(trim(raw, ' '), '{ingest.PARAGRAPH}') AS numbered FROM raw_lines WHERE kind = 1),
  d1 AS (SELECT *, s <> '' AND (numbered OR coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY n) = '', true)) AS starts FROM d0),
  d2 AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS seq FROM d1),
  s3 AS (SELECT doc_id, seq, max(CAST(coalesce({got("s", ingest.PARAGRAPH, 1)}, {got("s", ingest.PARAGRAPH, 2)}, {got("s", ingest.PARAGRAPH, 3)}) AS INTEGER)) AS paragraph,
    string_agg(CASE WHEN numbered THEN trim({got("s", ingest.PARAGRAPH, 4)}, ' ') ELSE s END, chr(10) ORDER BY n) AS raw_text FROM d2 WHERE s <> '' GROUP BY doc_id, seq)"""
S4_PART = f"""
  e0 AS (SELECT doc_id, n, trim(raw, ' ') AS s, CAST({got("trim(raw, ' ')", ingest.EXHIBIT_HEADER, 1)} AS INTEGER) AS page FROM raw_lines WHERE kind = 2),
  e1 AS (SELECT *, CASE WHEN page IS NULL THEN trim({got("s", ingest.EXHIBIT_LABEL, 1)}, ' ') END AS label, s = '' OR page IS NOT NULL AS breaks FROM e0),
  e2 AS (SELECT *, CASE WHEN label IS NOT NULL THEN trim(regexp_extract(s, '{ingest.EXHIBIT_LABEL}', 2), ' ') END AS val,
    sum(CASE WHEN page IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS stretch, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS at_page FROM e1),
  e3 AS (SELECT *, NOT breaks AND (label IS NOT NULL OR coalesce(lag(breaks) OVER w, true) OR coalesce(lag(val) OVER w <> '', false)) AS starts FROM e2 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
  e4 AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS seq,
    CASE WHEN label IS NOT NULL THEN regexp_replace(label || ': ' || val, '[: ]+$', '') ELSE s END AS content FROM e3),
  e5 AS (SELECT doc_id, seq, min(stretch) AS stretch, min(at_page) AS page, max(label) AS label, string_agg(content, chr(10) ORDER BY n) AS raw_text FROM e4 WHERE NOT breaks GROUP BY doc_id, seq),
  s4 AS (SELECT doc_id, seq, page, CASE WHEN page IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY doc_id, stretch ORDER BY seq) AS INTEGER) END AS block_index, label, raw_text,
    CASE WHEN label IS NOT NULL THEN 'EXHIBIT_LABELED_BLOCK' WHEN page IS NOT NULL THEN 'EXHIBIT_PAGE_BLOCK' ELSE 'EXHIBIT_TEXT_BLOCK' END AS segment_type FROM e5)"""
S2 = S2_CTE + " SELECT * FROM s2"
S3 = f"""WITH RECURSIVE {RAW},{S3_PART} SELECT *, CASE WHEN paragraph IS NULL THEN 'DECLARANT' ELSE 'DECLARANT ¶' || paragraph END AS speaker,
  CASE WHEN paragraph IS NULL THEN 'DECLARATION_BLOCK' ELSE 'DECLARATION_PARAGRAPH' END AS segment_type FROM s3"""
S4 = f"WITH RECURSIVE {RAW},{S4_PART} SELECT * FROM s4"
S1 = f"""{S2_CTE},{S3_PART},{S4_PART},
  parts AS (SELECT doc_id, count(*) AS k, CASE WHEN max(line_start) IS NOT NULL THEN 0.95 ELSE 0.55 END AS c FROM s2 GROUP BY 1
    UNION ALL SELECT doc_id, count(*), CASE WHEN max(paragraph) IS NOT NULL THEN 0.85 ELSE 0.7 END FROM s3 GROUP BY 1
    UNION ALL SELECT doc_id, count(*), CASE WHEN max(page) IS NOT NULL THEN 0.8 WHEN max(label) IS NOT NULL THEN 0.72 ELSE 0.65 END FROM s4 GROUP BY 1)
SELECT doc_id, coalesce(k, 0) AS segments, CASE WHEN trim(text, ' ') = '' THEN 'PENDING' WHEN k IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, CAST(coalesce(c, 0) AS DOUBLE) AS confidence
FROM documents LEFT JOIN parts USING (doc_id)"""


def s1_written(spark, sf_dir):
    """Two ingestions, the second tried twice, as reread by source type."""
    rows, path = ingest.source_segments(s2(spark, sf_dir), s3(spark, sf_dir), s4(spark, sf_dir)), store.new_path(spark, "segments")
    for batch, some in (("monday", "doc_id % 4 != 1"), ("tuesday", "doc_id % 4 = 1"), ("tuesday", "doc_id % 4 = 1")):
        ingest.write_segments(rows.filter(some), path, batch)
    return store.read(spark, path, rows.schema)


S1_WRITTEN = f"""{S2_CTE},{S3_PART},{S4_PART},
  every AS (SELECT 'deposition' AS source_type, doc_id, seg_no AS seq, segment_type, speaker, raw_text FROM s2
    UNION ALL SELECT 'declaration', doc_id, seq, CASE WHEN paragraph IS NULL THEN 'DECLARATION_BLOCK' ELSE 'DECLARATION_PARAGRAPH' END, CASE WHEN paragraph IS NULL THEN 'DECLARANT' ELSE 'DECLARANT ¶' || paragraph END, raw_text FROM s3
    UNION ALL SELECT 'exhibit', doc_id, seq, segment_type, NULL, raw_text FROM s4)
SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'tuesday' ELSE 'monday' END AS batch FROM every"""
QUERIES = {"s1_parser_results": s1, "s2_transcript_segments": s2, "s3_declaration_segments": s3, "s4_exhibit_segments": s4, "s1_written_segments": s1_written}
SQL = {"s1_parser_results": S1, "s2_transcript_segments": S2, "s3_declaration_segments": S3, "s4_exhibit_segments": S4, "s1_written_segments": S1_WRITTEN}
