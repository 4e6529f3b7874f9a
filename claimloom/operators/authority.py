"""Case citations: extraction, parsing, resolution in a catalog, and checks of propositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import rules, text

# --- fixed values: the form of a full case citation, its signals and holding verbs ---
_NAME = r"[A-Z][A-Za-z0-9'’.&-]*"
_PARTY = rf"{_NAME}(?:\s+(?:{_NAME}|(?:of|and|the|for|in|on|at|to|by|ex rel\.))){{0,7}}(?:,\s+(?:Inc\.|Corp\.|Co\.|Ltd\.|LLC))?"
_REPORTER = r"[A-Z][A-Za-z0-9.\-]*(?:\s+[A-Z][A-Za-z0-9.\-]*)*"
CITATION = (
    rf"\b({_PARTY}\s+v\.\s+{_PARTY}),\s*(\d{{1,4}})\s+({_REPORTER})\s+(\d{{1,5}})"
    r"(?:,\s*(\d{1,5}(?:-\d{1,5})?))?(?:\s*\(([^()]*?\d{4})\))?"
)
SIGNAL = r"(?i)^(?:Under|See|But see|Cf\.)\s+"
HOLDING = r"(?i)^(?:held(?:\s+that)?|holds(?:\s+that)?|establishes(?:\s+that)?|provides(?:\s+that)?|requires(?:\s+that)?)\s+"


def trimmed(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def citation_text(c: Column) -> Column:
    """F16: without the signal word and punctuation at the ends."""
    return trimmed(F.regexp_replace(text.collapsed(c), SIGNAL, ""), " ,.;:")


def name_key(c: Column, normal=text.matchable) -> Column:
    """a case name in lower case, runs of other signs as one space. normal: F.lower does for collapsed text."""
    lower = F.replace(normal(c), F.lit(" v. "), F.lit(" v "))
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def reporter_key(c: Column, normal=text.matchable) -> Column:
    return F.replace(normal(c), F.lit(" "), F.lit(""))


def parsed(citations: DataFrame) -> DataFrame:
    """The columns of citations (cite_text) with case_name, volume, reporter, page, pin, court, year, reference."""
    rows = citations.withColumn("citation", citation_text(F.col("cite_text")))
    rows = rows.withColumn("match", F.regexp_extract("citation", CITATION, 0))
    # the match is short: its groups, in one more pass over it alone
    groups = F.split(F.regexp_replace("match", CITATION, "\u0001".join(f"${g}" for g in range(1, 7))), "\u0001")
    rows = rows.withColumn("groups", F.when(F.col("match") != "", groups))
    group = lambda g: F.when(F.col("groups")[g - 1] != "", F.col("groups")[g - 1])
    # the citation is collapsed, so its parts are
    rows = rows.select(
        "*", group(1).alias("case_name"), group(2).alias("volume"), group(3).alias("reporter"), group(4).alias("page"), group(5).alias("pin"),
        F.trim(group(6)).alias("in_brackets"),
    ).drop("match", "groups")
    year = F.regexp_extract("in_brackets", r"^(?:(.*\S)\s+)?(\d{4})$", 2)
    court = trimmed(F.regexp_extract("in_brackets", r"^(?:(.*\S)\s+)?(\d{4})$", 1), " ,;")
    odd = F.col("in_brackets").isNotNull() & (year == "")
    rows = rows.withColumn("year", F.when(year != "", year.cast("int"))).withColumn("court", F.when(odd, F.col("in_brackets")).when(court != "", court))
    reference = F.concat_ws("|", name_key(F.col("case_name"), F.lower), "volume", reporter_key(F.col("reporter"), F.lower), "page", F.col("year").cast("string"))
    return rows.drop("in_brackets").withColumn("reference", F.when(F.col("case_name").isNotNull(), reference))


def resolved(citations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Parsed citations with authority_id, null where the catalog has no fitting entry.

    catalog: authority_id, name, volume, reporter, page, year. The join is on volume,
    reporter key and page; names must be equal and years must not contradict."""
    mine = citations.withColumn("rk", reporter_key(F.col("reporter"), F.lower))
    theirs = catalog.select("authority_id", name_key(F.col("name")).alias("nk"), "volume", reporter_key(F.col("reporter")).alias("rk"), "page", F.col("year").alias("c_year"))
    joined = mine.join(theirs, ["volume", "rk", "page"], "left")
    fits = (name_key(F.col("case_name"), F.lower) == F.col("nk")) & (F.col("year").isNull() | F.col("c_year").isNull() | (F.col("year") == F.col("c_year")))
    return joined.select(*citations.columns, F.when(fits, F.col("authority_id")).alias("authority_id"))


def proposition_core(proposition: Column, citation: Column) -> Column:
    """without signal, leading citation, holding verb and punctuation at the ends."""
    c = F.regexp_replace(text.collapsed(proposition), SIGNAL, "")
    after = F.regexp_replace(F.substring(c, F.length(citation) + 1, F.length(c)), "^[ ,]+", "")
    c = F.regexp_replace(F.when(c.startswith(citation), after).otherwise(c), HOLDING, "")
    return trimmed(c, " .;:")


def content_verdicts(propositions: DataFrame, excerpts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Status, verdict, confidence and best excerpt of each proposition.

    propositions: cite_id, core, authority_id, and columns ``also``, which are kept; excerpts: authority_id, place, excerpt.
    An authority's excerpts are gathered once, so that propositions are in no shuffle but the one to their authority."""
    tokens = lambda c: text.tokens(text.matchable(F.col(c)), rules.AUTHORITY_STOP, 2)
    mine = propositions.select("cite_id", "core", "authority_id", *also, tokens("core").alias("mine"))
    held = excerpts.withColumn("theirs", tokens("excerpt")).groupBy("authority_id").agg(F.array_sort(F.collect_list(F.struct("place", "excerpt", "theirs"))).alias("held"))
    rows = mine.join(held, "authority_id", "left").withColumn("shared", F.transform("held", lambda e: F.array_intersect("mine", e["theirs"])))
    # by what is shared, then place and excerpt: the order in which they are held
    rows = rows.withColumn("best", F.array_min(F.transform("shared", lambda t, i: F.struct((-F.size(t)).alias("n"), i.alias("at")))))
    at = F.when(F.col("best.n") < 0, F.col("best.at"))
    theirs = F.coalesce(F.get("shared", at), F.array().cast("array<string>"))
    best = rows.select(
        "cite_id", "core", "authority_id", *also, F.coalesce(F.when(F.col("best.n") < 0, -F.col("best.n") / F.size("mine")), F.lit(0.0)).alias("o"), F.col("held").isNull().alias("empty"),
        text.some_qualifier_missing(F.col("mine"), theirs).alias("mismatch"), F.get("held", F.coalesce(at, F.lit(0)))["excerpt"].alias("excerpt"), F.get("held", F.lit(0))["excerpt"].alias("first"),
    )
    o, mismatch = F.col("o"), F.col("mismatch")
    none, empty, thin = F.col("authority_id").isNull(), F.col("empty"), F.col("core") == ""
    good = (o >= 0.55) & ~mismatch
    status = F.when(none, "not_applicable").when(empty, "unavailable").when(thin, "available").when(good, "support_verified").otherwise("available")
    verdict = F.when(none | empty, None).when(thin, "AMBIGUOUS").when(good, "SUPPORTED").when((o >= 0.28) & mismatch, "OVERSTATED").when(o >= 0.28, "AMBIGUOUS").otherwise("UNSUPPORTED")
    confidence = F.when(none, None).when(empty, 0.55).when(thin, 0.4).when(good, 0.86).when((o >= 0.28) & mismatch, 0.64).when(o >= 0.28, 0.58).otherwise(0.74)
    excerpt = F.when(~none & ~empty, F.when(thin, F.col("first")).otherwise(F.col("excerpt")))
    return best.select("cite_id", F.round(o, 6).alias("overlap"), status.alias("status"), verdict.alias("verdict"), confidence.alias("confidence"), excerpt.alias("excerpt"), *also)


# --- fixed values: what is said of each outcome of a comparison with an authority's text, its basis, and the fix ---
OUTCOMES = {
    "unavailable": ("Authority matched, but no authority content is available in the MVP catalog for proposition verification.", "authority_content_unavailable", "Add authority text coverage for this case or verify the proposition manually."),
    "thin": ("Authority content is available, but the proposition text is too thin to verify deterministically.", "authority_content_insufficient_proposition_text", "State the proposition more explicitly so it can be compared against the authority content."),
    "supported": ("Matched authority content materially overlaps the drafted proposition.", "authority_content_deterministic_supported", None),
    "further": ("Authority content is available, but the proposition goes further than the matched excerpt.", "authority_content_deterministic_partial_overlap", "Narrow the proposition to match the authority excerpt more closely."),
    "partly": ("Authority content is available, but the matched excerpt only partially overlaps the proposition.", "authority_content_deterministic_partial_overlap", "Quote or narrow the proposition to the portion stated more directly in the authority excerpt."),
    "unclear": ("Authority content is available, but no excerpt clearly supports the drafted proposition.", "authority_content_deterministic_no_clear_support", "Revise the proposition to track the authority more closely or verify it manually."),
}


def explained(checked: DataFrame) -> DataFrame:
    """Rows of ``content_verdicts`` with reasoning, basis, suggested_fix and categories; null and none where not applicable."""
    v, thin = F.col("verdict"), F.col("confidence") == 0.4
    outcome = (
        F.when(F.col("status") == "not_applicable", None).when(F.col("status") == "unavailable", "unavailable").when((v == "AMBIGUOUS") & thin, "thin")
        .when(v == "SUPPORTED", "supported").when(v == "OVERSTATED", "further").when(v == "AMBIGUOUS", "partly").otherwise("unclear")
    )
    rows = checked.withColumn("outcome", outcome)
    told = lambda i: F.coalesce(*[F.when(F.col("outcome") == k, F.lit(x[i])) for k, x in OUTCOMES.items() if x[i] is not None])
    weak = F.coalesce(~F.col("outcome").isin("supported"), F.lit(False))
    categories = F.when(weak, F.array(F.lit("weak_support"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*checked.columns, told(0).alias("reasoning"), told(1).alias("basis"), told(2).alias("suggested_fix"), categories.alias("categories"))


def effective(citations: DataFrame, checked: DataFrame, runs: DataFrame, lookups: DataFrame) -> DataFrame:
    """A citation's statuses merged into one: authority and match status, verdict, reasoning, categories, confidence and fix.

    citations: cite_id, claim_id, linked, authority_id, case_name, reference; checked: ``explained``; runs: claim_id and the verdict,
    reasoning, categories, confidence, suggested_fix of its latest run; lookups: cite_id, lookup_status, found_id, where an
    outside lookup was made.

    A lookup that was made decides the authority and its match status; the catalog does where none was. What the record says of
    a claim with linked support stands; of others the authority's text, where it says something, and the run else. Without either
    a verdict is UNVERIFIED."""
    content = checked.select("cite_id", *[F.col(c).alias(f"content_{c}") for c in CONTENT])
    return merged(citations.join(lookups, "cite_id", "left").join(content, "cite_id", "left"), runs)


#: what is told of a comparison with an authority's text; ``merged`` reads these columns under the prefix content_
CONTENT = ("status", "verdict", "reasoning", "categories", "confidence", "suggested_fix")


def merged(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """D4, as ``effective``, of citations that have the columns of their lookup and, with the prefix content_, of their comparison."""
    tried = (F.coalesce("lookup_status", F.lit("lookup_not_attempted")) != "lookup_not_attempted")
    found = F.when(F.col("lookup_status") == "authority_found", F.col("found_id"))
    rows = rows.withColumn("tried", tried)
    rows = rows.withColumn("identity", F.when(F.col("tried"), found).otherwise(F.col("authority_id").cast("string")))
    status, _ = match_status(F.col("linked"), F.col("identity"), F.col("case_name"), F.col("reference"))
    _, of_catalog = match_status(F.col("linked"), F.col("authority_id"), F.col("case_name"), F.col("reference"))
    of_run = runs.select("claim_id", *[F.col(c).alias(f"run_{c}") for c in ("verdict", "reasoning", "categories", "confidence", "suggested_fix")])
    both = rows.join(of_run, "claim_id", "left")
    text_first = lambda c: F.when(F.col("linked"), F.col(f"run_{c}")).otherwise(F.coalesce(f"content_{c}", f"run_{c}"))
    none = F.array().cast("array<string>")
    of_text = ~F.col("linked") & (F.col("content_reasoning").isNotNull() | (F.size("content_categories") > 0))
    categories = F.when(of_text, F.col("content_categories")).otherwise(F.col("run_categories"))
    return both.select(
        "cite_id", "claim_id", F.col("identity").alias("authority_id"), status.alias("authority_status"),
        F.when(F.col("tried"), F.col("lookup_status")).otherwise(of_catalog).alias("match_status"), F.coalesce("content_status", F.lit("not_applicable")).alias("content_status"),
        F.coalesce(text_first("verdict"), F.lit("UNVERIFIED")).alias("verdict"), text_first("reasoning").alias("reasoning"),
        F.coalesce(categories, none).alias("categories"), text_first("confidence").alias("confidence"), text_first("suggested_fix").alias("suggested_fix"),
    )


def match_status(linked: Column, authority: Column, case_name: Column, reference: Column) -> tuple[Column, Column]:
    """Authority status and match status; a reference with a page is a structured candidate."""
    candidate = case_name.isNotNull() & reference.contains("|")
    status = F.when(linked, "linked_authority_support_present").when(authority.isNotNull(), "authority_matched").when(candidate, "authority_candidate_parsed")
    match = F.when(authority.isNotNull(), "matched").when(candidate, "no_match")
    named = case_name.isNotNull()
    return status.when(named, "citation_recognized").otherwise("not_reviewed"), match.when(named, "recognized_only").otherwise("not_reviewed")


def repeated_once(citations: DataFrame) -> DataFrame:
    """the distinct citation texts of a draft in encounter order."""
    first = citations.groupBy("draft_id", "citation").agg(F.min("cite_id").alias("cite_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("draft_id").orderBy("cite_id")))
