"""Text columns: normal forms, tokens, overlaps and cues. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import rules

#: word boundaries and white space of all scripts
UNICODE = "(?U)"


def collapsed(text: Column) -> Column:
    """White space runs become a space, none at the ends (Unicode white space)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def matchable(text: Column) -> Column:
    return F.lower(collapsed(text))


def capitals(text: Column) -> Column:
    """Upper case character by character, as SQL engines do: of ß its capital form and not SS, no ligature taken apart."""
    whole = f"[{rules.EXPANDED}]+"
    parts = F.regexp_extract_all(text, F.lit(f"{whole}|[^{rules.EXPANDED}]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(whole), F.translate(p, rules.EXPANDED, rules.EXPANDED_CAPITALS)).otherwise(F.upper(p))), "")


def all_tokens(normal: Column) -> Column:
    """Tokens in order, with repeats, of a text in its matchable form."""
    return F.regexp_extract_all(normal, F.lit(rules.TOKEN), 0)


def tokens(normal: Column, stop=(), longer_than: int = 0) -> Column:
    """The set of tokens without those of a stop list."""
    found = F.array_distinct(all_tokens(normal))
    if stop:
        found = F.array_except(found, F.array(*map(F.lit, stop)))
    return F.filter(found, lambda t: F.length(t) > longer_than) if longer_than else found


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap(a: Column, b: Column) -> Column:
    """|a and b| / |a|, 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared(a, b) / F.size(a)).otherwise(F.lit(0.0))


def words(of) -> Column:
    return F.array(*map(F.lit, of))


def mentions(normal: Column, markers) -> Column:
    """Whether one of the markers occurs, also inside a word."""
    found = F.lit(False)
    for marker in markers:
        found = found | normal.contains(marker)
    return found


def quoted_phrases(text: Column) -> Column:
    """Quoted spans in their matchable form, in order, without empty ones."""
    spans = F.regexp_extract_all(text, F.lit(rules.QUOTED), 0)
    inner = F.transform(spans, lambda s: matchable(s.substr(F.lit(2), F.length(s) - 2)))
    return F.filter(inner, lambda s: s != "")


def phrase_found(phrase: Column, normal: Column) -> Column:
    """As a substring, or its tokens in a row among the text's tokens."""
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(all_tokens(t), " "), F.lit(" "))
    return normal.contains(phrase) | (F.size(all_tokens(phrase)) == 0) | spaced(normal).contains(spaced(phrase))


def names(text: Column) -> Column:
    """Capitalised words of three letters or more, lower-cased, without months and court words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(UNICODE + rules.NAME), 0), F.lower)
    return F.array_except(F.array_distinct(found), words(rules.NAME_STOP))


def subject_mismatch(claim: Column, support: Column) -> Column:
    a, b = names(claim), names(support)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def temporal_mismatch(claim: Column, support: Column) -> Column:
    return claim.rlike(UNICODE + rules.REPEATED) & ~support.rlike(UNICODE + rules.REPEATED) & support.rlike(UNICODE + rules.DISCRETE)


def any_qualifier_missing(claim: Column, support: Column, qualifiers=rules.QUALIFIERS) -> Column:
    """The claim has qualifiers and the support has none of them (token arrays)."""
    own = F.array_intersect(claim, words(qualifiers))
    return (F.size(own) > 0) & (F.size(F.array_intersect(own, support)) == 0)


def some_qualifier_missing(claim: Column, support: Column, qualifiers=rules.DOCUMENT_QUALIFIERS) -> Column:
    """The claim has a qualifier that the support lacks (token arrays)."""
    own = F.array_intersect(claim, words(qualifiers))
    return F.size(F.array_except(own, support)) > 0


def multiple_predicates(normal: Column) -> Column:
    found = all_tokens(normal)
    verbs = F.filter(found, lambda t: t.isin(*rules.VERBS) | t.endswith("ed"))
    return F.array_contains(found, "and") & (F.size(verbs) >= 2)


def claim_type(text: Column) -> Column:
    # of the matchable form these patterns need lower case alone: white space of any kind and length will do between words
    lower = F.lower(text)
    quoted = text.rlike(rules.QUOTED)
    inferred = lower.rlike(UNICODE + rules.INFERENCE.replace(" ", r"\s+"))
    gloss = lower.rlike(UNICODE + rules.GLOSS)
    return F.when(gloss | (quoted & inferred), "MIXED").when(quoted, "QUOTE").when(inferred, "INFERENCE").otherwise("FACT")


def weak_text(raw: Column) -> Column:
    return matchable(raw).rlike(UNICODE + rules.WEAK)


def evidence_role(segment_type: Column, speaker: Column, raw: Column) -> Column:
    normal = matchable(raw)
    speaker = F.coalesce(speaker, F.lit(""))
    kind = F.coalesce(segment_type, F.lit(""))
    label = matchable(speaker).isin(*rules.CONTEXT_LABELS)
    exhibit = normal.rlike(UNICODE + rules.EXHIBIT_CONTEXT)
    contextual, substantive = F.lit("contextual"), F.lit("substantive")
    return (
        F.when((kind == "QUESTION_BLOCK") | (speaker == "Q"), contextual)
        .when((kind == "ANSWER_BLOCK") | (speaker == "A"), substantive)
        .when(kind == "DECLARATION_PARAGRAPH", substantive)
        .when(kind == "DECLARATION_BLOCK", F.when(normal.rlike(UNICODE + rules.DECLARATION_CONTEXT), contextual).otherwise(substantive))
        .when(kind == "EXHIBIT_LABELED_BLOCK", F.when(label | exhibit, contextual).otherwise(substantive))
        .when(kind.isin("EXHIBIT_PAGE_BLOCK", "EXHIBIT_TEXT_BLOCK"), F.when(exhibit, contextual).otherwise(substantive))
        .when(kind == "UNANCHORED_TEXT", contextual)
        .otherwise("neutral")
    )
