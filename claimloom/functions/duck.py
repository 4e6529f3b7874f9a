"""SQL text for DuckDB: the checking side's own wording of the text rules."""

from claimloom.functions import rules


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(of) -> str:
    return "[" + ", ".join(map(quoted, of)) + "]"


def matchable(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def all_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, {quoted(rules.TOKEN)})"


def tokens(c: str, stop=(), longer_than: int = 0) -> str:
    tests = ([f"t NOT IN ({', '.join(map(quoted, stop))})"] if stop else []) + ([f"length(t) > {longer_than}"] if longer_than else [])
    return f"list_distinct([t FOR t IN {all_tokens(c)}{' IF ' + ' AND '.join(tests) if tests else ''}])"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0 END)"


def mentions(c: str, markers) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(m)})" for m in markers) + ")"


def found(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def phrases(c: str) -> str:
    """Quoted spans in matchable form, without empty ones."""
    inner = matchable("q[2:-2]")
    return f"[p FOR p IN [{inner} FOR q IN regexp_extract_all({c}, {quoted(rules.QUOTED)})] IF p <> '']"


def phrase_found(p: str, c: str) -> str:
    spaced = lambda x: f"(' ' || array_to_string({all_tokens(x)}, ' ') || ' ')"
    return f"(contains({c}, {p}) OR len({all_tokens(p)}) = 0 OR contains({spaced(c)}, {spaced(p)}))"


def names(c: str) -> str:
    out = ", ".join(map(quoted, rules.NAME_STOP))
    return f"list_distinct([n FOR n IN [lower(w) FOR w IN regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(w, '[A-Z][a-z]{{2,}}')] IF n NOT IN ({out})])"


def claim_type(c: str) -> str:
    m, quote = matchable(c), found(c, rules.QUOTED)
    return (
        f"(CASE WHEN {quote} AND {found(m, rules.INFERENCE)} THEN 'MIXED' WHEN {found(m, rules.GLOSS)} THEN 'MIXED' "
        f"WHEN {quote} THEN 'QUOTE' WHEN {found(m, rules.INFERENCE)} THEN 'INFERENCE' ELSE 'FACT' END)"
    )


def evidence_role(kind: str, speaker: str, raw: str) -> str:
    m, labels = matchable(raw), ", ".join(map(quoted, rules.CONTEXT_LABELS))
    exhibit = found(m, rules.EXHIBIT_CONTEXT)
    return f"""(CASE WHEN {kind} = 'QUESTION_BLOCK' OR {speaker} = 'Q' THEN 'contextual'
      WHEN {kind} = 'ANSWER_BLOCK' OR {speaker} = 'A' THEN 'substantive'
      WHEN {kind} = 'DECLARATION_PARAGRAPH' THEN 'substantive'
      WHEN {kind} = 'DECLARATION_BLOCK' THEN CASE WHEN {found(m, rules.DECLARATION_CONTEXT)} THEN 'contextual' ELSE 'substantive' END
      WHEN {kind} = 'EXHIBIT_LABELED_BLOCK' THEN CASE WHEN lower(trim({speaker})) IN ({labels}) OR {exhibit} THEN 'contextual' ELSE 'substantive' END
      WHEN {kind} IN ('EXHIBIT_PAGE_BLOCK', 'EXHIBIT_TEXT_BLOCK') THEN CASE WHEN {exhibit} THEN 'contextual' ELSE 'substantive' END
      WHEN {kind} = 'UNANCHORED_TEXT' THEN 'contextual' ELSE 'neutral' END)"""


def multiple_predicates(m: str) -> str:
    t, verbs = all_tokens(m), ", ".join(map(quoted, rules.VERBS))
    return f"(list_contains({t}, 'and') AND len([v FOR v IN {t} IF v IN ({verbs}) OR ends_with(v, 'ed')]) >= 2)"
