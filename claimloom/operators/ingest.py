"""Source texts to record segments: windows over the lines of each document.

Input: doc_id, n (line place), raw. One exchange on doc_id serves all windows and
the aggregate of a parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources import store

# --- fixed values: the forms of lines ---
PAGE_HEADER = r"(?i)^(?:page|pg\.?)\s+(\d+)$"
NUMBERED_LINE = r"^\s*(\d{1,3})\s+(.*\S.*)$"
INLINE_PLACE = r"^(\d+):(\d+)\s+(.*\S.*)$"
SPEAKER = r"^([QqAa])\.\s"
LABEL_SPEAKER = r"^([A-Z][A-Z ]{1,40}):\s"
PARAGRAPH = r"^(?:¶\s*(\d{1,4})|\((\d{1,4})\)|(\d{1,4})[.)])\s+(.*\S.*)$"
EXHIBIT_HEADER = r"(?i)^(?:exhibit(?:\s+[a-z0-9._-]+)?\s+)?page\s+(\d+)$"
EXHIBIT_LABEL = r"^([A-Z][A-Za-z0-9 /&()#._-]{0,40}):\s*(.*)$"


def _got(c: Column, pattern: str, group: int) -> Column:
    """The group, null where the pattern or the group isn't found."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern) & (found != ""), found)


def _in_order(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), "\n")


def transcript_segments(lines: DataFrame) -> DataFrame:
    """Page and line segments with speaker and type; unnumbered runs merge."""
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    s = F.trim("raw")
    rows = lines.select("doc_id", "n", "raw", s.alias("s")).filter("s != ''").withColumn("header", _got(F.col("s"), PAGE_HEADER, 1).cast("int"))
    inline = F.col("header").isNull() & F.col("s").rlike(INLINE_PLACE)
    rows = rows.withColumn("inline", inline).withColumn("own_page", F.coalesce("header", F.when(F.col("inline"), _got(F.col("s"), INLINE_PLACE, 1).cast("int"))))
    rows = rows.withColumn("page", F.last("own_page", ignorenulls=True).over(by_doc)).filter("header IS NULL")
    plain = ~F.col("inline") & F.col("page").isNotNull() & F.col("raw").rlike(NUMBERED_LINE)
    number = F.when(F.col("inline"), _got(F.col("s"), INLINE_PLACE, 2)).when(plain, _got(F.col("raw"), NUMBERED_LINE, 1)).cast("int")
    content = F.when(F.col("inline"), _got(F.col("s"), INLINE_PLACE, 3)).when(plain, _got(F.col("raw"), NUMBERED_LINE, 2)).otherwise(F.col("s"))
    rows = rows.withColumn("number", number).withColumn("content", F.trim(content)).withColumn("page", F.when(F.col("number").isNotNull(), F.col("page")))
    speaker = F.coalesce(F.upper(_got(F.col("content"), SPEAKER, 1)), F.trim(_got(F.col("content"), LABEL_SPEAKER, 1)))
    rows = rows.withColumn("speaker", F.when(F.col("number").isNotNull(), speaker))
    before = lambda c: F.lag(c).over(by_doc)
    follows = (F.col("page") == before("page")) & (F.col("number") == before("number") + 1) & F.col("speaker").eqNullSafe(before("speaker"))
    both_free = F.col("number").isNull() & before("number").isNull()
    starts = before("n").isNull() | ~(both_free | F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("seg_no", F.sum(starts.cast("int")).over(by_doc))
    found = rows.groupBy("doc_id", "seg_no").agg(
        F.min("page").alias("page_start"), F.min("number").alias("line_start"), F.max("page").alias("page_end"), F.max("number").alias("line_end"),
        _in_order("content").alias("raw_text"), F.min("speaker").alias("speaker"),
    )
    kind = F.when(F.col("line_start").isNull(), "UNANCHORED_TEXT").when(F.col("speaker") == "Q", "QUESTION_BLOCK").when(F.col("speaker") == "A", "ANSWER_BLOCK")
    return found.withColumn("segment_type", kind.otherwise("TRANSCRIPT_BLOCK"))


def declaration_segments(lines: DataFrame) -> DataFrame:
    """S3: numbered paragraphs, else blocks between blank lines."""
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.select("doc_id", "n", F.trim("raw").alias("s")).withColumn("numbered", F.col("s").rlike(PARAGRAPH))
    blank_before = F.coalesce(F.lag("s").over(by_doc) == "", F.lit(True))
    rows = rows.withColumn("starts", (F.col("s") != "") & (F.col("numbered") | blank_before))
    rows = rows.withColumn("seq", F.sum(F.col("starts").cast("int")).over(by_doc)).filter("s != ''")
    number = F.coalesce(*[_got(F.col("s"), PARAGRAPH, g) for g in (1, 2, 3)]).cast("int")
    rows = rows.withColumn("number", number).withColumn("content", F.when(F.col("numbered"), F.trim(_got(F.col("s"), PARAGRAPH, 4))).otherwise(F.col("s")))
    found = rows.groupBy("doc_id", "seq").agg(F.max("number").alias("paragraph"), _in_order("content").alias("raw_text"))
    numbered = F.col("paragraph").isNotNull()
    return found.select(
        "*", F.when(numbered, F.concat(F.lit("DECLARANT ¶"), F.col("paragraph").cast("string"))).otherwise("DECLARANT").alias("speaker"),
        F.when(numbered, "DECLARATION_PARAGRAPH").otherwise("DECLARATION_BLOCK").alias("segment_type"),
    )


def exhibit_segments(lines: DataFrame) -> DataFrame:
    """Labelled, page and text blocks; block index within each page header's stretch."""
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.select("doc_id", "n", F.trim("raw").alias("s")).withColumn("page", _got(F.col("s"), EXHIBIT_HEADER, 1).cast("int"))
    label = F.when(F.col("page").isNull(), F.trim(_got(F.col("s"), EXHIBIT_LABEL, 1)))
    rows = rows.withColumn("label", label).withColumn("value", F.when(F.col("label").isNotNull(), F.trim(F.regexp_extract("s", EXHIBIT_LABEL, 2))))
    rows = rows.withColumn("breaks", (F.col("s") == "") | F.col("page").isNotNull())
    rows = rows.withColumn("stretch", F.sum(F.col("page").isNotNull().cast("int")).over(by_doc)).withColumn("at_page", F.last("page", ignorenulls=True).over(by_doc))
    after = F.coalesce(F.lag("breaks").over(by_doc), F.lit(True)) | F.coalesce(F.lag("value").over(by_doc) != "", F.lit(False))
    rows = rows.withColumn("starts", ~F.col("breaks") & (F.col("label").isNotNull() | after))
    rows = rows.withColumn("seq", F.sum(F.col("starts").cast("int")).over(by_doc)).filter(~F.col("breaks"))
    rows = rows.withColumn("content", F.when(F.col("label").isNotNull(), F.regexp_replace(F.concat_ws(": ", "label", "value"), "[: ]+$", "")).otherwise(F.col("s")))
    found = rows.groupBy("doc_id", "seq").agg(F.min("stretch").alias("stretch"), F.min("at_page").alias("page"), F.max("label").alias("label"), _in_order("content").alias("raw_text"))
    index = F.row_number().over(Window.partitionBy("doc_id", "stretch").orderBy("seq"))
    kind = F.when(F.col("label").isNotNull(), "EXHIBIT_LABELED_BLOCK").when(F.col("page").isNotNull(), "EXHIBIT_PAGE_BLOCK").otherwise("EXHIBIT_TEXT_BLOCK")
    return found.select("doc_id", "seq", "page", F.when(F.col("page").isNotNull(), index).alias("block_index"), "label", "raw_text", kind.alias("segment_type"))


def parser_results(documents: DataFrame, transcripts: DataFrame, declarations: DataFrame, exhibits: DataFrame) -> DataFrame:
    """doc_id, segments, status, confidence; the parsers' rows are unified by document."""
    parts = (
        transcripts.groupBy("doc_id").agg(F.count("*").alias("k"), F.when(F.bool_or(F.col("line_start").isNotNull()), 0.95).otherwise(0.55).alias("c")),
        declarations.groupBy("doc_id").agg(F.count("*").alias("k"), F.when(F.bool_or(F.col("paragraph").isNotNull()), 0.85).otherwise(0.7).alias("c")),
        exhibits.groupBy("doc_id").agg(F.count("*").alias("k"), F.when(F.bool_or(F.col("page").isNotNull()), 0.8).when(F.bool_or(F.col("label").isNotNull()), 0.72).otherwise(0.65).alias("c")),
    )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return documents.join(every, "doc_id", "left").select(
        "doc_id", F.coalesce("k", F.lit(0)).alias("segments"), F.when(F.trim("text") == "", "PENDING").when(F.col("k").isNull(), "FAILED").otherwise("COMPLETED").alias("status"),
        F.coalesce("c", F.lit(0.0)).alias("confidence"),
    )


def source_segments(transcripts: DataFrame, declarations: DataFrame, exhibits: DataFrame) -> DataFrame:
    """source_type, doc_id, seq, segment_type, speaker, raw_text of all parsers."""
    kind = F.when(F.col("paragraph").isNull(), "DECLARATION_BLOCK").otherwise("DECLARATION_PARAGRAPH")
    named = {
        "deposition": transcripts.withColumnRenamed("seg_no", "seq"),
        "declaration": declarations if "segment_type" in declarations.columns else declarations.withColumn("segment_type", kind),
        "exhibit": exhibits.withColumn("speaker", F.lit(None).cast("string")),
    }
    parts = [rows.select(F.lit(name).alias("source_type"), "doc_id", F.col("seq").cast("long").alias("seq"), "segment_type", "speaker", "raw_text") for name, rows in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_segments(segments: DataFrame, path: str, batch: str) -> bool:
    """Appends one ingestion's segments, by source type; False where that batch was ingested before."""
    return store.append(segments, path, batch, ["source_type"])
