"""Lines of documents dressed up as the three kinds of source text, by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.views import table


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, n (from 1), raw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n, line = F.col("n"), F.col("line")
    page = (F.floor(n / 9) + 1).cast("string")
    mark = F.when(n % 4 == 1, "Q. ").when(n % 4 == 3, "a. ").when(n % 8 == 2, "THE COURT: ").otherwise("")
    deposition = (
        F.when(n % 9 == 1, F.concat(F.lit("Page "), page)).when(n % 11 == 0, line).when(n % 13 == 0, F.lit("  "))
        .when(n % 7 == 0, F.concat(page, F.lit(":"), (n % 9).cast("string"), F.lit(" "), line))
        .otherwise(F.concat((n % 9).cast("string"), F.lit("  "), mark, line))
    )
    declaration = F.when(n % 5 == 0, F.lit("")).when(n % 3 == 1, F.concat(n.cast("string"), F.lit(". "), line)).otherwise(F.concat(F.lit("   "), line))
    exhibit = (
        F.when(n % 10 == 1, F.concat(F.lit("Exhibit Page "), (F.floor(n / 10) + 1).cast("string"))).when(n % 6 == 0, F.lit(" "))
        .when(n % 8 == 4, F.concat(F.lit("Subject: "), line)).when(n % 8 == 0, F.lit("Enclosure:")).otherwise(line)
    )
    rows = docs.withColumn("n", F.col("pos") + 1).withColumn("kind", (F.col("doc_id") % 3).cast("int"))
    raw = F.when(F.col("kind") == 0, deposition).when(F.col("kind") == 1, declaration).otherwise(exhibit)
    return rows.select("doc_id", "kind", "n", raw.alias("raw"))


SQL = """
  cut AS (SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS kind, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS n FROM documents),
  raw_lines AS (SELECT doc_id, kind, n, CASE kind
    WHEN 0 THEN CASE WHEN n % 9 = 1 THEN 'Page ' || (n // 9 + 1) WHEN n % 11 = 0 THEN line WHEN n % 13 = 0 THEN '  ' WHEN n % 7 = 0 THEN (n // 9 + 1) || ':' || (n % 9) || ' ' || line
      ELSE (n % 9) || '  ' || CASE WHEN n % 4 = 1 THEN 'Q. ' WHEN n % 4 = 3 THEN 'a. ' WHEN n % 8 = 2 THEN 'THE COURT: ' ELSE '' END || line END
    WHEN 1 THEN CASE WHEN n % 5 = 0 THEN '' WHEN n % 3 = 1 THEN n || '. ' || line ELSE '   ' || line END
    ELSE CASE WHEN n % 10 = 1 THEN 'Exhibit Page ' || (n // 10 + 1) WHEN n % 6 = 0 THEN ' ' WHEN n % 8 = 4 THEN 'Subject: ' || line WHEN n % 8 = 0 THEN 'Enclosure:' ELSE line END END AS raw
    FROM cut)"""
