"""Authority lookups over a table of payloads, and citations with their places in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.operators import authority

PAYLOAD = (
    "struct<status: int, error_message: string, clusters: array<struct<id: string, case_name: string, year: int, date_filed: string>>>"
)


def cache_first(citations: DataFrame, cache: DataFrame) -> DataFrame:
    """Citations with the cached status, null where a fetch is due.

    citations: cite_id, provider, lookup_key; cache: the same key, lookup_status.
    Keys are made distinct first, so a case cited everywhere is probed once."""
    keys = citations.select("provider", "lookup_key").distinct()
    known = keys.join(cache, ["provider", "lookup_key"], "left").select("provider", "lookup_key", "lookup_status")
    return citations.join(known, ["provider", "lookup_key"])


def to_fetch(checked: DataFrame) -> DataFrame:
    """Each missing key once."""
    return checked.filter("lookup_status IS NULL").groupBy("provider", "lookup_key").agg(F.count("*").alias("asked"))


def adjudicated(lookups: DataFrame) -> DataFrame:
    """Status and chosen cluster of each payload.

    lookups: cite_id, case_name, volume, reporter, page, year, payload (JSON, null if
    the fetch failed). Clusters keep their order: the first that fits is taken."""
    p = F.from_json("payload", PAYLOAD)
    rows = lookups.withColumn("p", p)
    clusters = F.coalesce("p.clusters", F.array().cast("array<struct<id: string, case_name: string, year: int, date_filed: string>>"))
    year_of = lambda c: F.coalesce(c["year"], F.substring(c["date_filed"], 1, 4).try_cast("int"))
    fits_year = lambda c: F.col("year").isNull() | year_of(c).isNull() | (year_of(c) == F.col("year"))
    fits_name = lambda c: F.col("case_name").isNull() | F.coalesce(authority.name_key(c["case_name"]) == authority.name_key(F.col("case_name")), F.lit(False))
    rows = rows.withColumn("all", clusters).withColumn("in_year", F.filter("all", fits_year))
    rows = rows.withColumn("named", F.filter("in_year", fits_name))
    status, some = F.col("p.status"), F.size("all") > 0
    found = (
        F.when(F.col("volume").isNull() | F.col("reporter").isNull() | F.col("page").isNull(), "lookup_missing_fields").when(F.col("payload").isNull(), "lookup_unavailable")
        .when((status == 404) | ~some, "authority_not_found").when((status == 429) | (status >= 500), "lookup_unavailable").when(status >= 400, "lookup_error")
        .when(F.size("in_year") == 0, "authority_year_mismatch").when(F.size("named") == 0, "authority_name_mismatch").otherwise("authority_found")
    )
    rows = rows.withColumn("lookup_status", found)
    chosen = F.when(F.col("lookup_status") == "authority_found", F.get("named", F.lit(0))["id"]).when(F.col("lookup_status") == "authority_name_mismatch", F.get("in_year", F.lit(0))["id"])
    return rows.select("cite_id", "lookup_status", chosen.when(F.col("lookup_status") == "authority_year_mismatch", F.get("all", F.lit(0))["id"]).alias("cluster_id"))


def document_match() -> Column:
    """Whether a citation agrees with the document's own, both parsed.

    Columns: cite_text, and case_name, volume, reporter, page, year of the citation, own_* of the document."""
    c = F.col
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    names = (authority.name_key(c("case_name")), authority.name_key(c("own_case_name")))
    reporters = (authority.reporter_key(c("reporter")), authority.reporter_key(c("own_reporter")))
    conflict = differs(*names) | differs(c("volume"), c("own_volume")) | differs(*reporters) | differs(c("page"), c("own_page")) | differs(c("year"), c("own_year"))
    return (
        F.when(F.trim(F.coalesce("cite_text", F.lit(""))) == "", "citation_not_provided").when(c("case_name").isNull(), "citation_unresolved")
        .when(c("own_case_name").isNull(), "citation_recognized").when(conflict, "citation_mismatch").otherwise("citation_matches_pdf")
    )


# --- fixed values: a sentence's end is no "v." and has a capital behind it, or nothing ---
_END = r"(?<![vV])[.?!])\s*\p{Lu}"
FIRST_END, LAST_END = rf"(?s)^.(.*?{_END}", rf"(?s)^.(.*{_END}"


def _cut_citations(found: Column) -> Column:
    """Matches as (head, cite, tail, citation): the lines before that of the "v.", the place in the text, what trimming leaves out."""

    def parts(raw: Column) -> Column:
        head = F.regexp_extract(raw, r"^((?:(?![^\n]* v\. )[^\n]*\n)*)(?=[^\n]* v\. )", 1)
        rest = lambda h: raw.substr(F.length(h) + 1, F.length(raw))
        named = F.struct(head.alias("head"), rest(head).alias("rest"), authority.trimmed(text.collapsed(rest(head)), " ,.;:").alias("citation"))
        return F.transform(
            F.array(named),
            lambda x: F.struct(
                x["head"], F.substring(x["rest"], F.lit(1), F.length(x["citation"])).alias("cite"),
                x["rest"].substr(F.length(x["citation"]) + 1, F.length(raw)).alias("tail"), x["citation"],
            ),
        )[0]

    return F.transform(found, parts)


def citation_pairs(texts: DataFrame) -> DataFrame:
    """doc_id, citation, start, end and proposition, the sentence around it, for each citation of texts (doc_id, text).

    A citation begins on the line that names the parties; its span is as long as its trimmed text.
    A sentence goes on to its first end, or the next citation. The text is cut once, into
    citations and the gaps between them. Each piece is searched for its first and last end of a sentence,
    with the characters next to it in view; a fold over the pieces then keeps what has been
    read since the last end, so that work is in proportion to the text and the sentences."""
    likely = texts.filter(F.col("text").contains("v."))
    found = F.regexp_extract_all("text", F.lit(f"({authority.CITATION})"), 1)
    rows = likely.select("doc_id", found.alias("found"), F.split("text", authority.CITATION, -1).alias("gaps")).filter(F.size("found") > 0)
    rows = rows.select("doc_id", "gaps", _cut_citations(F.col("found")).alias("cites"))
    nothing = F.lit("")
    cite = lambda k, field: F.coalesce(F.get("cites", k)[field], nothing)
    rows = rows.select("doc_id", "cites", F.transform("gaps", lambda gap, k: F.concat(cite(k - 1, "tail"), gap, cite(k, "head"))).alias("gaps"))

    # a piece between the character before it and the next one that isn't white space
    first = lambda c: F.substring(c, 1, 1)
    after_gap = lambda k: F.coalesce(first(F.get("cites", k)["cite"]), F.lit("A"))
    last = lambda c, other: F.when(c != "", F.right(c, F.lit(1))).otherwise(other)
    before_gap = lambda k: last(cite(k - 1, "cite"), F.lit("\n"))
    stripped = lambda c: F.regexp_replace(c, r"^\s+", "")
    after_cite = lambda gap, k: F.when(stripped(gap) != "", first(stripped(gap))).otherwise(after_gap(k + 1))
    gaps = F.transform("gaps", lambda gap, k: F.struct(gap.alias("piece"), F.concat(before_gap(k), gap, after_gap(k)).alias("seen")))
    cites = F.transform(
        "cites", lambda c, k: F.struct(c["cite"].alias("piece"), F.concat(last(F.get("gaps", k), before_gap(k)), c["cite"], after_cite(F.get("gaps", k + 1), k)).alias("seen"))
    )
    rows = rows.select("doc_id", F.transform("cites", lambda c: c["citation"]).alias("citations"), gaps.alias("between"), cites.alias("places"))
    end_of = lambda x, pattern: F.length(F.regexp_extract(x["seen"], pattern, 1))
    judged = lambda x: F.struct(x["piece"], F.length(x["piece"]).alias("size"), end_of(x, FIRST_END).alias("first"), end_of(x, LAST_END).alias("last"))
    rows = rows.select("doc_id", "citations", F.transform("between", judged).alias("gaps"), F.transform("places", judged).alias("cites"))

    since = lambda before, x: F.when(x["last"] > 0, x["piece"].substr(x["last"] + 1, x["size"])).otherwise(F.concat(before, x["piece"]))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    kind = "array<struct<citation: string, start: int, end: int, proposition: string>>"

    def step(acc: Column, k: Column) -> Column:
        c, gap, citation = F.get("cites", k), F.get("gaps", k + 1), F.get("citations", k)
        onward = F.when(gap["first"] > 0, F.substring(gap["piece"], F.lit(1), gap["first"])).otherwise(gap["piece"])
        one = F.struct(
            citation.alias("citation"), acc["at"].alias("start"), (acc["at"] + F.length(citation)).alias("end"),
            bare(F.concat(acc["since"], c["piece"], onward)).alias("proposition"),
        )
        return F.struct(
            (acc["at"] + c["size"] + gap["size"]).alias("at"), since(since(acc["since"], c), gap).alias("since"), F.concat(acc["pairs"], F.array(one)).alias("pairs")
        )

    gap = F.get("gaps", F.lit(0))
    start = F.struct(gap["size"].alias("at"), since(nothing, gap).alias("since"), F.array().cast(kind).alias("pairs"))
    pairs = F.aggregate(F.sequence(F.lit(0), F.size("cites") - 1), start, step, lambda acc: acc["pairs"])
    return rows.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*")


def split_heading(c: Column) -> Column:
    """Lines trimmed, empty ones dropped; a short first line is set off when a case caption follows."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))), lambda x: x != "")
    head, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    heading = (F.length(head) <= 80) & ~head.contains(" v. ") & ~head.rlike("[.;?!]") & second.contains(" v. ")
    body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")
    return F.when(F.coalesce(heading, F.lit(False)), F.concat(head, F.lit("\n\n"), body)).otherwise(F.array_join(lines, "\n"))


