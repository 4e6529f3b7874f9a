"""Anchors: places in the record, normalised from JSON with columns as the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds of anchors and what each must hold ---
REQUIRED = {
    "page_line": ("page_start", "line_start", "page_end", "line_end"),
    "paragraph": ("paragraph_number",),
    "block": ("block_index",),
    "exhibit_page": ("page_number",),
}
KEY = "struct<rank:int,k0:int,k1:int,k2:int,k3:int>"
NUMBERS = ("page_start", "line_start", "page_end", "line_end", "paragraph_number", "block_index", "page_number", "sequence_order")


def _number(meta: Column, name: str) -> Column:
    """An integer or a string of digits; anything else is null."""
    value = F.trim(F.get_json_object(meta, f"$.{name}"))
    return F.when(value.rlike(r"^\d{1,9}$"), value.cast("int"))


def normalised(rows: DataFrame) -> DataFrame:
    """F8: rows with anchor, a struct of kind, the numbers of that kind, and label; null if unusable.

    rows: meta (JSON), page_start, line_start, page_end, line_end."""
    meta = F.col("meta")
    kind = F.lower(F.get_json_object(meta, "$.kind"))
    numbers = {n: _number(meta, n) for n in NUMBERS}
    label = F.nullif(F.trim(F.get_json_object(meta, "$.label")), F.lit(""))
    keeps = {"page_line": REQUIRED["page_line"], "paragraph": ("paragraph_number", "sequence_order"), "block": ("block_index", "sequence_order"), "exhibit_page": ("page_number", "block_index", "sequence_order")}
    null = F.lit(None).cast("int")

    def struct(of: str, values: dict, with_label: bool) -> Column:
        fields = [F.coalesce(values.get(n, null), null).alias(n) for n in NUMBERS]
        return F.struct(F.lit(of).alias("kind"), *fields, (label if with_label else F.lit(None).cast("string")).alias("label"))

    found = None
    for of, needed in REQUIRED.items():
        test = kind == of
        for n in needed:
            test = test & numbers[n].isNotNull()
        made = struct(of, {n: numbers[n] for n in keeps[of]}, of in ("block", "exhibit_page"))
        found = F.when(test, made) if found is None else found.when(test, made)
    places = {n: F.col(n).cast("int") for n in REQUIRED["page_line"]}
    whole = F.lit(True)
    for c in places.values():
        whole = whole & c.isNotNull()
    return rows.withColumn("anchor", found.when(whole, struct("page_line", places, False)))


def rendered(a: str = "anchor") -> Column:
    g = lambda n: F.col(f"{a}.{n}").cast("string")
    label = F.coalesce(F.concat(F.lit(" ["), g("label"), F.lit("]")), F.lit(""))
    kind = F.col(f"{a}.kind")
    return (
        F.when(kind == "page_line", F.concat(F.lit("p."), g("page_start"), F.lit(":"), g("line_start"), F.lit("-"), g("page_end"), F.lit(":"), g("line_end")))
        .when(kind == "paragraph", F.concat(F.lit("¶"), g("paragraph_number"))).when(kind == "block", F.concat(F.lit("block "), g("block_index"), label))
        .when(kind == "exhibit_page", F.concat(F.lit("ex. p."), g("page_number"), F.coalesce(F.concat(F.lit(" block "), g("block_index")), F.lit("")), label))
        .otherwise("unanchored segment")
    )


def usable(a: str = "anchor") -> Column:
    g = lambda n: F.col(f"{a}.{n}")
    kind = g("kind")
    return (
        F.when(kind == "page_line", F.struct(g("page_end"), g("line_end")) >= F.struct(g("page_start"), g("line_start"))).when(kind == "paragraph", g("paragraph_number") > 0)
        .when(kind == "block", g("block_index") > 0).when(kind == "exhibit_page", (g("page_number") > 0) & F.coalesce(g("block_index") > 0, F.lit(True))).otherwise(F.lit(False))
    )


def sort_key(a: str = "anchor") -> Column:
    """O1: record order as a struct: kind's rank, then its numbers; unanchored last."""
    g = lambda n: F.col(f"{a}.{n}")
    kind, zero = g("kind"), F.lit(0)
    key = lambda rank, *of: F.struct(F.lit(rank).alias("rank"), *[c.cast("int").alias(f"k{i}") for i, c in enumerate((*of, zero, zero, zero)[:4])]).cast(KEY)
    by_sequence = g("sequence_order").isNotNull()
    return (
        F.when(kind == "page_line", key(0, g("page_start"), g("line_start"), g("page_end"), g("line_end"))).when((kind == "exhibit_page") & by_sequence, key(1, g("sequence_order")))
        .when(kind == "exhibit_page", key(1, g("page_number"), F.coalesce(g("block_index"), zero))).when(kind.isNotNull() & by_sequence, key(2, g("sequence_order")))
        .when(kind == "paragraph", key(2, g("paragraph_number"))).when(kind == "block", key(2, g("block_index"))).otherwise(key(99, zero))
    )


def backfilled(rows: DataFrame) -> DataFrame:
    """Kind and numbers of anchors for legacy segments; rows without a basis stay null.

    rows: source_type, segment_type, speaker, page_start, line_start, page_end, line_end."""
    declaration, line = F.col("source_type") == "DECLARATION", F.col("line_start")
    from_speaker = F.nullif(F.regexp_extract("speaker", r"¶\s*(\d+)", 1), F.lit("")).cast("int")
    number = F.coalesce(F.nullif(from_speaker, F.lit(0)), line)
    paragraph = declaration & (F.col("segment_type") == "DECLARATION_PARAGRAPH")
    block = declaration & (F.col("segment_type") == "DECLARATION_BLOCK")
    whole = F.expr("page_start IS NOT NULL AND line_start IS NOT NULL AND page_end IS NOT NULL AND line_end IS NOT NULL")
    kind = F.when(paragraph, F.when(number.isNotNull(), "paragraph")).when(block, F.when(line.isNotNull(), "block")).when(whole, "page_line")
    value = F.when(paragraph, number).when(block, line).when(whole, F.col("page_start"))
    sequence = F.when(paragraph, F.coalesce(F.nullif(line, F.lit(0)), number)).when(block, line)
    return rows.withColumn("kind", kind).withColumn("number", value.cast("int")).withColumn("sequence_order", sequence.cast("int"))
