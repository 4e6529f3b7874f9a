"""Verification of claims against their linked segments, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules, text


# --- fixed values: what is said of claims without links (with a citation, with universal words, others), and the fix ---
UNLINKED = (
    ("Citation present but no verified authority.", "Attach anchored authority support for the cited proposition."),
    ("Strong universal language appears without verified authority support.", "Narrow the universal language or attach anchored authority support."),
    ("No citation or verified authority supports this claim.", "Attach at least one anchored authority or record segment before verification."),
)
# --- fixed values: what each flag says, in the flags' order, and the fix; {n} is the number of segments ---
SAID = (
    ("invalid_anchor", "{n} linked segment(s) are missing usable provenance anchors.", "Review source parsing and relink the claim to segments with stable provenance."),
    ("absolute_qualifier_mismatch", "The claim uses absolute qualifiers not reflected in the linked record text.", "Soften the qualifier or add record support for the broader assertion."),
    ("quote_mismatch_placeholder", "Quoted language does not appear verbatim in the linked text.", "Check the quote against the transcript and adjust the citation."),
    ("subject_mismatch", "Named subject tokens in the claim do not match the linked record text.", "Relink the claim to testimony about the same actor or witness."),
    ("temporal_scope_mismatch", "The claim suggests repeated or ongoing conduct, but the support looks like a discrete event.", "Narrow the claim's time scope or add broader record support."),
    ("knowledge_escalation", "The claim attributes knowledge or intent beyond what the linked testimony states directly.", "Reframe the claim as an inference or add testimony addressing knowledge directly."),
    ("causation_escalation", "The claim states causation more directly than the linked testimony appears to support.", "Narrow the causal assertion or add testimony that ties the event to the outcome."),
    ("needs_human_review", "Knowledge or causation language should be reviewed by a human before acceptance.", None),
    ("contextual_support_only", "Linked support is mostly contextual framing rather than substantive record support.", "Add anchored support that states the proposition directly."),
    ("narrow_support", "The linked support appears narrower than the broader claim language.", "Split the claim or narrow it to the portion stated directly in the record."),
)
NO_FLAGS = "No deterministic red flags were triggered."
ALL_WEAK = ("Substantive support is equivocal across the linked segments and does not state the fact directly.", "Add direct record support that states the proposition without hedging.")
OF_VERDICT = {
    "SUPPORTED": "Linked record text materially overlaps the claim language.",
    "PARTIALLY_SUPPORTED": "Linked record text appears related but narrower than the claim.",
    "OVERSTATED": "Linked record text supports part of the claim, but the drafted proposition goes further.",
    "UNSUPPORTED": "Linked record text has minimal lexical overlap with the claim.",
}
NONE_REMAIN = ("No valid support links remain after excluding invalid existing links.", "Remove invalid support links and relink the claim to in-scope record support.")
SOME_INVALID = "Review invalid support links and relink the claim to in-scope record support."


def unlinked_verdicts(claims: DataFrame) -> DataFrame:
    """Verdict and confidence of claims that have no valid link."""
    cited = F.col("text").rlike(text.UNICODE + rules.CASE_CITED)
    universal = text.matchable(F.col("text")).rlike(text.UNICODE + rules.UNIVERSAL)
    return claims.select(
        "claim_id",
        F.when(cited, "AMBIGUOUS").when(universal, "OVERSTATED").otherwise("UNSUPPORTED").alias("verdict"),
        F.when(cited, 0.65).when(universal, 0.8).otherwise(0.75).alias("confidence"),
        F.when(~cited & universal, "missing_citation,absolute_qualifier_mismatch").otherwise("missing_citation").alias("flags"),
        *[F.when(cited, UNLINKED[0][i]).when(universal, UNLINKED[1][i]).otherwise(UNLINKED[2][i]).alias(name) for i, name in enumerate(("reasoning", "suggested_fix"))],
    )


def support_measures(claims: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a linked claim: combined texts in link order, overlaps, weak and anchor counts.

    Tokens and roles are taken from segments before they are joined, and texts are
    joined in link order after being gathered for the claim."""
    role = text.evidence_role(F.col("segment_type"), F.col("speaker"), F.col("raw_text"))
    prepared = segments.select(
        "segment_id", "raw_text", "anchored", text.matchable(F.col("raw_text")).alias("normal"),
        (role == "substantive").alias("substantive"), text.weak_text(F.col("raw_text")).alias("weak"),
    ).withColumn("tokens", text.tokens(F.col("normal"), rules.VERIFY_STOP))
    mine = claims.select("claim_id", F.col("text").alias("claim"), text.matchable(F.col("text")).alias("claim_normal"))
    mine = mine.withColumn("claim_tokens", text.tokens(F.col("claim_normal"), rules.VERIFY_STOP))
    joined = links.join(prepared, "segment_id").join(mine.select("claim_id", "claim_tokens"), "claim_id")
    weak = F.col("substantive") & F.col("weak")
    o = text.overlap(F.col("claim_tokens"), F.col("tokens"))
    own = F.when(weak, F.least(o, F.lit(rules.WEAK_OVERLAP))).otherwise(o)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_order", "segment_id", c))), lambda x: x[c]), " ")
    measured = joined.groupBy("claim_id").agg(
        in_order("normal").alias("normal"), in_order("raw_text").alias("raw"),
        F.count(F.when(~F.col("anchored"), 1)).alias("unanchored"),
        F.coalesce(F.max(F.when(F.col("substantive"), own)), F.lit(0.0)).alias("substantive"),
        F.coalesce(F.max(F.when(~F.col("substantive"), own)), F.lit(0.0)).alias("contextual"),
        F.bool_or("substantive").alias("has_substantive"), F.bool_or(weak).alias("has_weak"),
        F.bool_and(~F.col("substantive") | F.col("weak")).alias("only_weak"),
    )
    whole = measured.join(mine, "claim_id")
    combined = text.overlap(F.col("claim_tokens"), text.tokens(F.col("normal"), rules.VERIFY_STOP))
    return whole.withColumn("combined", combined).withColumn("all_weak", F.col("has_substantive") & F.col("only_weak"))


FLAGS = (
    "invalid_anchor", "absolute_qualifier_mismatch", "quote_mismatch_placeholder", "subject_mismatch", "temporal_scope_mismatch",
    "knowledge_escalation", "causation_escalation", "needs_human_review", "contextual_support_only", "narrow_support",
)


def flags_of() -> Column:
    """The flags of a row of support_measures(), in their order."""
    c = F.col
    claim_all, support_all = text.all_tokens(c("claim_normal")), text.all_tokens(c("normal"))
    knows, causes = text.mentions(c("claim_normal"), rules.KNOWLEDGE), text.mentions(c("claim_normal"), rules.CAUSATION)
    s, x, o = c("substantive"), c("contextual"), c("combined")
    tests = (
        c("unanchored") > 0,
        text.any_qualifier_missing(claim_all, support_all),
        F.exists(text.quoted_phrases(c("claim")), lambda p: ~text.phrase_found(p, c("normal"))),
        text.subject_mismatch(c("claim"), c("raw")),
        text.temporal_mismatch(c("claim_normal"), c("normal")),
        knows & ~text.mentions(c("normal"), rules.KNOWLEDGE),
        causes & ~text.mentions(c("normal"), rules.CAUSATION),
        knows | causes,
        (~c("has_substantive") & (x > 0)) | (c("has_weak") & (x >= 0.35) & (s < 0.2)) | ((x >= 0.4) & (s < 0.2)),
        (o >= 0.25) & (s >= 0.2) & (s < 0.7) & text.multiple_predicates(c("claim_normal")) & ((s <= 0.6) | (s < o)),
    )
    return F.filter(F.array(*[F.when(t, F.lit(f)) for t, f in zip(tests, FLAGS)]), lambda f: f.isNotNull())


def verdict_of(flags: Column, o: Column, all_weak: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    either = pick(o > 0, "AMBIGUOUS", "UNSUPPORTED")
    return (
        F.when(has("invalid_anchor"), "AMBIGUOUS").when(has("quote_mismatch_placeholder"), "OVERSTATED")
        .when(has("contextual_support_only"), either).when(all_weak, either)
        .when(has("knowledge_escalation") | has("causation_escalation"), pick(o >= 0.15, "AMBIGUOUS", "UNSUPPORTED"))
        .when(has("subject_mismatch"), pick(o >= 0.25, "AMBIGUOUS", "UNSUPPORTED"))
        .when(has("narrow_support"), pick(o >= 0.25, "OVERSTATED", "AMBIGUOUS"))
        .when(has("absolute_qualifier_mismatch") | has("temporal_scope_mismatch"), pick(o >= 0.45, "OVERSTATED", "AMBIGUOUS"))
        .when((o >= 0.7) & ~has("needs_human_review"), "SUPPORTED")
        .when(o >= 0.4, pick(~has("needs_human_review"), "PARTIALLY_SUPPORTED", "AMBIGUOUS"))
        .when(o >= 0.15, "AMBIGUOUS").otherwise("UNSUPPORTED")
    )


def confidence_of(flags: Column, verdict: Column, o: Column) -> Column:
    return (
        F.when(F.array_contains(flags, "invalid_anchor"), 0.3).when(F.array_contains(flags, "contextual_support_only"), 0.35)
        .when(verdict == "SUPPORTED", 0.85).when(verdict == "PARTIALLY_SUPPORTED", 0.65)
        .when(verdict == "OVERSTATED", F.when(o >= 0.45, 0.55).otherwise(0.4)).when(verdict == "AMBIGUOUS", 0.4).otherwise(0.25)
    )


def reasoning_of(flags: Column, unanchored: Column, all_weak: Column, verdict: Column) -> Column:
    """The sentences that give a verdict's reasons, in the flags' order, then on weak support and the verdict."""
    has = lambda f: F.array_contains(flags, f)
    n = lambda said: F.replace(F.lit(said), F.lit("{n}"), unanchored.cast("string")) if "{n}" in said else F.lit(said)
    of_verdict = [F.when(verdict == v, said) for v, said in OF_VERDICT.items()]
    return F.array_compact(F.array(*[F.when(has(f), n(said)) for f, said, _ in SAID], F.when(F.size(flags) == 0, NO_FLAGS), F.when(all_weak, ALL_WEAK[0]), *of_verdict))


def fix_of(flags: Column, all_weak: Column) -> Column:
    """The first flag's fix, else the one for weak support, else null."""
    return F.coalesce(*[F.when(F.array_contains(flags, f), fix) for f, _, fix in SAID if fix], F.when(all_weak, ALL_WEAK[1]))


def verify(claims: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """A4: claim_id, flags, verdict, confidence, the overlaps, reasoning (sentences in order) and suggested_fix of every linked claim."""
    m = support_measures(claims, links, segments).withColumn("flags", flags_of())
    m = m.withColumn("verdict", verdict_of(F.col("flags"), F.col("combined"), F.col("all_weak")))
    return m.select(
        "claim_id", "flags", "verdict", confidence_of(F.col("flags"), F.col("verdict"), F.col("combined")).alias("confidence"),
        "combined", "substantive", "contextual", "all_weak",
        reasoning_of(F.col("flags"), F.col("unanchored"), F.col("all_weak"), F.col("verdict")).alias("reasoning"), fix_of(F.col("flags"), F.col("all_weak")).alias("suggested_fix"),
    )


def verify_all(claims: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """claim_id, flags, verdict, confidence, reasoning, suggested_fix of every claim, linked or not."""
    linked = verify(claims, links, segments)
    held = links.join(segments.select("segment_id"), "segment_id", "left_semi").select("claim_id")
    rest = unlinked_verdicts(claims.join(held, "claim_id", "left_anti"))
    rest = rest.withColumn("flags", F.split("flags", ",")).withColumn("reasoning", F.array("reasoning"))
    return linked.select(*(names := ["claim_id", "flags", "verdict", "confidence", "reasoning", "suggested_fix"])).unionByName(rest.select(*names))


def with_exclusions(verdicts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Verdicts (of ``verify_all`` over valid links) with what was left out: codes join the flags once, in the links' order,
    reasoning and fix say so, and exclusion_note counts the links by code (null where none was).

    excluded: claim_id, link_order, code (null: an invalid link without one). Counted by claim and code before the join;
    a claim has few codes."""
    code = F.coalesce("code", F.lit("invalid_support_link"))
    first = F.min(F.struct(F.col("link_order").isNull(), "link_order"))
    by_code = excluded.groupBy("claim_id", code.alias("code")).agg(F.count("*").alias("n"), first.alias("first"), F.bool_or(F.col("code").isNotNull()).alias("named"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("first", "code"))))
    told = F.array_sort(F.collect_list(F.struct("code", "n")))
    notes = by_code.groupBy("claim_id").agg(
        F.transform(in_order, lambda x: x["code"]).alias("codes"), F.sum("n").alias("excluded"),
        F.array_join(F.transform(told, lambda x: F.concat_ws(" ", x["n"].cast("string"), F.replace(x["code"], F.lit("_"), F.lit(" ")))), ", ").alias("told"),
    )
    rows = verdicts.join(notes, "claim_id", "left")
    some = F.col("excluded").isNotNull()
    missing = some & F.array_contains("flags", "missing_citation")
    note = F.concat(F.lit("Excluded "), F.col("excluded").cast("string"), F.lit(" invalid support link(s) from reasoning: "), F.col("told"), F.lit("."))
    return rows.select(
        "claim_id", F.when(some, F.array_union("flags", "codes")).otherwise(F.col("flags")).alias("flags"), "verdict", "confidence",
        F.when(missing, F.array(F.lit(NONE_REMAIN[0]))).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(missing, NONE_REMAIN[1]).otherwise(F.coalesce("suggested_fix", F.when(some, SOME_INVALID))).alias("suggested_fix"), note.alias("exclusion_note"),
    )


# --- fixed values: reasoning categories by flag, strengths and ceilings of verdicts ---
STRENGTH = (("UNVERIFIED", 0), ("UNSUPPORTED", 1), ("CONTRADICTED", 1), ("AMBIGUOUS", 2), ("OVERSTATED", 2), ("PARTIALLY_SUPPORTED", 3), ("SUPPORTED", 4))
BLOCKING = ("missing_citation", "invalid_anchor", "quote_mismatch_placeholder")
CEILING_PARTIAL = ("absolute_qualifier_mismatch", "temporal_scope_mismatch", "narrow_support")
CEILING_AMBIGUOUS = ("subject_mismatch", "knowledge_escalation", "causation_escalation", "contextual_support_only")


def capped(verdict: Column, flags: Column, roles: Column) -> Column:
    """D3: a refined verdict, lowered where it is stronger than contextual support or a flag allows.

    roles: the roles of the assessed support, contextual or another. A verdict that is
    no stronger than the ceiling stays as it is."""
    contextual = (F.size(roles) > 0) & F.forall(roles, lambda r: r == "contextual")
    has = lambda own: F.arrays_overlap(flags, F.array(*map(F.lit, own)))
    strength = strength_of(verdict)
    return (
        F.when((contextual | has(CEILING_AMBIGUOUS)) & (strength > 2), "AMBIGUOUS")
        .when(has(CEILING_PARTIAL) & (strength > 3), "PARTIALLY_SUPPORTED")
        .otherwise(verdict)
    )


def strength_of(verdict: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, value in STRENGTH:
        found = F.when(verdict == name, value).otherwise(found)
    return found
