"""Assertions cut into narrow claims, each with its subject.

A text is read once, into the places of its words and verbs, and its signs (commas, semicolons
and ``and``) outside quotation marks. Whether a stretch of it is a clause, or can begin one, is
then asked of these places: where the first verb from here on is, whether a word follows
it. So a sign costs a few look-ups, not the rest of the text; and where the words behind it can't
begin a clause, as behind most, no places are looked for. A cut is made where what is to
the left is a clause by itself and what is to the right can begin one; a clause that begins
with its verb gets the subject of the one before. The plain splitter takes the signs one kind
after the other, the structured one all together, and knows headings, quotations and
reporting phrases besides.

Spark reads a table's texts as Arrow batches, one text at a time; nothing is shuffled. Claim types are columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import accumulate, compress, count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules, text

# --- fixed values: verbs (besides words in -ed), those that need an object, words before nouns, pronouns, adverbs ---
VERBS = (
    "is", "are", "was", "were", "be", "been", "am", "said", "told", "knew", "signed", "approved", "admitted", "caused", "emailed",
    "received", "sent", "observed", "saw", "testified", "explained", "wrote", "argued", "asserted", "contended", "maintained", "ordered",
    "failed", "did", "had", "has", "have", "understood", "intended", "reviewed", "circulated", "met", "resigned", "opened", "closed", "paid",
    "spoke", "agreed",
)
TRANSITIVE = ("signed", "approved", "reviewed", "emailed", "received", "sent", "observed", "ordered", "circulated", "opened", "closed")
PARTICIPLES = ("related", "alleged", "revised", "attached", "written", "pending", "underlying")
PRONOUNS = ("he", "she", "they", "it", "we", "i", "you")
ADVERBS = ("later", "then", "thereafter", "subsequently", "promptly", "immediately", "also")
BEFORE = ("after", "before", "during", "following", "upon")
WITHIN = ("in", "on", "at", "by", "from", "within")
OPENERS = ("which", "suggesting", "showing", "meaning", "therefore", "thus", "so")
# --- fixed values: patterns ---
COORDINATOR = r"(?:and|but)\s+"
ADVERBIAL = rf"(?:{'|'.join(ADVERBS)})\b[\s,]*"
TEMPORAL = rf"(?:{'|'.join(BEFORE)})\b[^,]{{0,80}},\s*"
CONTEXTUAL = rf"(?:{'|'.join(WITHIN)})\b[^,]{{0,80}},\s*"
OPENER = rf"\s*(?:{'|'.join(OPENERS)})\b"
GLOSSED = r"\b(?:suggest(?:s|ed|ing)?|show(?:s|ed|ing)?|demonstrat(?:es|ed|ing)?|impl(?:ies|ied|y))\b"
MIXED = rf",{OPENER}"
LABEL = r"^\s*[A-Z][A-Za-z0-9 /&()#._-]{1,24}:\s*[^.?!\n]{0,80}\s*$"
REPORTING = (
    r"(?:[A-Z][A-Za-z']+(?:\s+[A-Z][A-Za-z']+){0,2}|(?:the|this)\s+(?:email|exhibit|letter|memo|message|document|record))\s+"
    r"(?:states?|stated|shows?|showed|reflects?|reflected|indicates?|indicated|notes?|noted|says?|said|wrote|argued|contended|asserted|maintained)\s+(?:that\s+)?"
)
FOLLOWERS = ("later", "then", "thereafter", "except", "but not")
FOLLOWING = rf"\b(?:{'|'.join(FOLLOWERS)})\b"

_FLAGS = re.ASCII | re.IGNORECASE
_QUOTES = re.compile('["“”]')
_STRAIGHT, _QUOTATION = re.compile(r'"[^"\n]+"'), re.compile(r'"[^"\n]+"|“[^”\n]+”')
_WORD, _REST, _TOKEN = re.compile(r"\b[\w']+\b"), re.compile(r"[\w']*"), re.compile(f"({rules.TOKEN})")
_COORDINATOR, _OPENER, _MIXED = (re.compile(p, _FLAGS) for p in (COORDINATOR, OPENER, MIXED))
_REPORTING = re.compile(rf"(?:{REPORTING}[ ,]*(?=[^ ,]))+", _FLAGS)
_SPACE = " \t\n\v\f\r"
_HEAD = 1_000  # characters in which what stands before a clause is looked for, behind a subject


@dataclass(frozen=True, eq=False)
class Wording:
    """What a splitter takes for verbs and subjects."""

    structured: bool
    verbs: frozenset[str]
    transitive: frozenset[str]
    pronouns: frozenset[str]
    longest_subject: int
    lead: re.Pattern
    ahead: re.Pattern  # a word that may stand before a clause, or open a gloss
    reach: int  # words after the first in which a clause's verb is

    def is_verb(self, word: str) -> bool:
        return word in self.verbs or word.endswith("ed")

    def first_is_verb(self, words: list[str]) -> bool:
        return bool(words) and words[0] not in PARTICIPLES and self.is_verb(words[0])

    def could_name(self, word: str) -> bool:
        return word.lower() in self.pronouns or word[:1].isupper()


def _wording(structured: bool, verbs=(), transitive=(), pronouns=(), longest_subject=4) -> Wording:
    kinds = (ADVERBIAL, TEMPORAL, *((CONTEXTUAL,) if structured else ()))
    lead = re.compile(rf"(?:(?:{'|'.join(kinds)})[ ,]*)+", _FLAGS)
    ahead = re.compile(rf"(?:{'|'.join(('and', 'but', *ADVERBS, *BEFORE, *((*WITHIN, *OPENERS) if structured else ())))})\b", _FLAGS)
    return Wording(structured, frozenset(VERBS + verbs), frozenset(TRANSITIVE + transitive), frozenset(PRONOUNS + pronouns), longest_subject, lead, ahead, 3 if structured else 2)


PLAIN = _wording(False)
STRUCTURED = _wording(
    True, ("forwarded", "moved", "compelled", "reflects", "indicates", "notes", "suggests", "shows"), ("forwarded", "moved", "compelled"), ("which", "who", "that"), 6
)


#: what is asked again of the text at hand, and of its pieces, is kept until others come
once = lru_cache(maxsize=16)


class Verbs(dict):
    """Whether a word is a verb, told once a word; what is known is forgotten when it is too much."""

    def __init__(self, w: Wording):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> bool:
        if len(self) >= 100_000:
            self.clear()
        self[word] = told = self.w.is_verb(word.lower())
        return told


class Starts(dict):
    """Whether a clause can begin with a word: NEVER, MAYBE if a verb is near (a name), or LIKELY (a verb, or what stands before a clause)."""

    NEVER, MAYBE, LIKELY = 0, 1, 2

    def __init__(self, w: Wording):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        likely = self.w.is_verb(word.lower()) or self.w.ahead.match(word)
        self[word] = told = self.LIKELY if likely else self.MAYBE if self.w.could_name(word) else self.NEVER
        return told


KNOWN = {w.structured: Verbs(w) for w in (PLAIN, STRUCTURED)}
STARTS = {w.structured: Starts(w) for w in (PLAIN, STRUCTURED)}


class Places:
    """The tokens of a text: where they begin, what they are, and the next verb from each."""

    def __init__(self, content: str, w: Wording):
        parts = _TOKEN.split(content)  # tokens, and what is between them
        self.starts = list(accumulate(map(len, parts)))[:-1:2]
        self.words = parts[1::2]
        self.verbs = list(compress(count(), map(KNOWN[w.structured].__getitem__, self.words)))

    def next_verb(self, i: int) -> int:
        at = bisect_left(self.verbs, i)
        return self.verbs[at] if at < len(self.verbs) else len(self.words)

    def between(self, a: int, b: int) -> tuple[int, int]:
        return bisect_left(self.starts, a), bisect_left(self.starts, b)


class Clauses:
    """A text, and what can be said about stretches of it, each given by where it begins and ends.

    ``before`` are words put ahead of a stretch, a subject, as a string; "" for none."""

    def __init__(self, content: str, w: Wording):
        self.content, self.w = content, w

    @cached_property
    def tokens(self) -> Places:
        # character for character: İ alone has two in lower case, and no other form matters to tokens
        lower = self.content.replace("İ", "_").lower()
        return Places(lower, self.w)

    def trim(self, a: int, b: int, chars: str = " ,") -> tuple[int, int]:
        while a < b and self.content[a] in chars:
            a += 1
        while a < b and self.content[b - 1] in chars:
            b -= 1
        return a, b

    def after_lead(self, a: int, b: int) -> tuple[int, int]:
        a, b = self.trim(a, b)
        found = self.w.lead.match(self.content, a, b)
        return self.trim(found.end(), b) if found else (a, b)

    def behind(self, before: str, a: int, b: int) -> tuple[list[str], int]:
        """What is left of ``before`` and where the stretch begins, both without a lead."""
        joined = f"{before} {self.content[a : min(b, a + _HEAD)]}"
        at = len(joined) - len(joined.lstrip(" ,"))
        found = self.w.lead.match(joined, at)
        at = found.end() if found else at
        over = at - len(before) - 1
        return _TOKEN.findall(before[at:].lower()) if over < 0 else [], a + max(over, 0)

    def opens_gloss(self, a: int, b: int) -> bool:
        return _OPENER.match(self.content, a, b) is not None

    def predicate(self, before: list[str], a: int, b: int, least: int) -> bool:
        """Whether ``before`` and the tokens from a to b, ``least`` or more, have a verb, and one that stands alone or has a word behind it."""
        i, j = self.tokens.between(a, b)
        size = len(before) + j - i
        ahead = next((k for k, x in enumerate(before) if self.w.is_verb(x)), None)
        if ahead is not None:
            at, verb = ahead, before[ahead]
        else:
            v = self.tokens.next_verb(i)
            if v >= j:
                return False
            at, verb = len(before) + v - i, self.tokens.words[v]
        return size >= least and (at + 1 < size or verb not in self.w.transitive)

    def complete(self, before: str, a: int, b: int) -> bool:
        """Whether a stretch stands by itself."""
        w = self.w
        if w.structured:
            gloss = _OPENER.match(before) is not None if before else self.opens_gloss(a, b)
            if gloss:
                i, j = self.tokens.between(a, b)
                own = _TOKEN.findall(before.lower())
                return len(own) + j - i >= 2 and (self.tokens.next_verb(i) < j or any(map(w.is_verb, own)))
            if before:
                return self.predicate(*self.behind(before, a, b), b, 2)
            return self.predicate([], *self.after_lead(a, b), 2)
        own = _TOKEN.findall(before.lower())
        i, j = self.tokens.between(a, b)
        if len(own) + j - i < 4:
            few = own + self.tokens.words[i:j]
            if len(few) < 2 or w.is_verb(few[0]) or not w.is_verb(few[1]):
                return False
        return self.predicate(own, a, b, 1)

    def names_subject(self, a: int, b: int, reach: int) -> bool:
        """Whether a pronoun or a capital comes first, and a verb soon after."""
        first, *more = self.first_words(a, b, 1 + reach) or [""]
        return self.w.could_name(first) and any(map(KNOWN[self.w.structured].__getitem__, more))

    def first_words(self, a: int, b: int, n: int) -> list[str]:
        if self.content[a - 1 : a].isalnum():  # within a word, which began before
            a = _REST.match(self.content, a, b).end()
        return [m.group() for m in islice(_WORD.finditer(self.content, a, b), n)]

    def verb_first(self, a: int, b: int) -> bool:
        return self.w.first_is_verb([x.lower() for x in self.first_words(a, b, 1)])

    def without_coordinator(self, a: int, b: int) -> tuple[int, int]:
        a, b = self.trim(a, b)
        found = _COORDINATOR.match(self.content, a, b)
        return self.trim(found.end() if found else a, b, _SPACE)

    def can_begin(self, a: int, b: int, subject: str | None) -> bool:
        """Whether a clause can begin here, given the subject so far."""
        a, b = self.without_coordinator(a, b)
        c, d = self.after_lead(a, b)
        first = a if self.w.structured else c
        if self.content[first : first + 1] in ('"', "“") and c < d:
            return False
        verb_first = self.verb_first(c, d)
        if self.w.structured:
            return a < b and (self.opens_gloss(a, b) or self.names_subject(c, d, 3) or (verb_first and subject is not None))
        return subject is not None if verb_first else self.names_subject(c, d, 2)

    def wants_subject(self, a: int, b: int) -> bool:
        c, d = self.after_lead(a, b)
        if not self.w.structured:
            i, j = self.tokens.between(c, d)
            return self.w.first_is_verb(self.tokens.words[i : min(j, i + 1)])
        return not self.opens_gloss(a, b) and self.verb_first(c, d) and not self.names_subject(c, d, 3)

    def with_subject(self, a: int, b: int, subject: str | None, carry: bool) -> tuple[str, int, int]:
        a, b = self.without_coordinator(a, b)
        return subject if carry and subject is not None and self.wants_subject(a, b) else "", a, b

    def has_verb(self, subject: str | None) -> bool:
        return subject is not None and any(map(self.w.is_verb, _TOKEN.findall(subject.lower())))

    def told(self, before: str, a: int, b: int) -> str:
        return f"{before} {self.content[a:b]}" if before else self.content[a:b]

    def splits(self, left: tuple[int, int], right: tuple[int, int], subject: str | None) -> bool:
        if left[0] >= left[1] or right[0] >= right[1]:
            return False
        if self.tokens.next_verb(self.tokens.between(*right)[0]) == len(self.tokens.words) and not self.opens_gloss(*right) and not self.has_verb(subject):
            return False
        gloss = self.w.structured and self.opens_gloss(*right)
        if not gloss and not self.can_begin(*right, subject):  # what fails most often comes first
            return False
        carry = self.w.structured and subject is not None and self.wants_subject(*left)
        if not self.complete(*self.with_subject(*left, subject, carry)):
            return False
        return gloss or self.complete(*self.with_subject(*right, subject, True))


clauses = once(Clauses)


def may_begin(content: str, at: int, w: Wording) -> bool:
    """False where ``can_begin`` is for any subject: the first words neither begin a clause nor stand before one."""
    first = _WORD.search(content, at)
    start = STARTS[w.structured][first.group()] if first else Starts.NEVER
    if start != Starts.MAYBE:
        return start == Starts.LIKELY
    known = KNOWN[w.structured]
    return any(known[m.group()] for m in islice(_WORD.finditer(content, first.end()), w.reach))


@once
def subject_of(content: str, w: Wording) -> str | None:
    """The words before the first verb, if they are few and begin with a pronoun or a capital."""
    if w.structured:
        content = content.strip(" ,")
        lead = w.lead.match(content)
        content = content[lead.end() :].strip(" ,") if lead else content
    before: list[str] = []
    known = KNOWN[w.structured]
    for m in _WORD.finditer(content):
        word = m.group()
        if known[word]:
            break
        if not before and not w.could_name(word):
            return None
        if len(before) == w.longest_subject and not (w.structured and any(x.lower() in ADVERBS for x in (*before[1:], word))):
            return None  # too many, wherever the verb is
        before.append(word)
    else:
        return None
    if w.structured:
        before = before[: next((i for i, x in enumerate(before) if i and x.lower() in ADVERBS), len(before))]
    return " ".join(before) if 1 <= len(before) <= w.longest_subject and w.could_name(before[0]) else None


def own_subject(content: str, w: Wording) -> str | None:
    """The subject behind reporting phrases, else the text's."""
    return subject_of(without_reporting(content), w) or subject_of(content, w)


@once
def without_reporting(content: str) -> str:
    content = content.strip(" ,")
    found = _REPORTING.match(content)
    return content[found.end() :] if found else content


@once
def outside(content: str) -> str:
    """content with quotation marks and what they enclose blanked, character for character."""
    parts = _QUOTES.split(content)
    return "_".join("_" * len(p) if i % 2 else p for i, p in enumerate(parts))


def cut(content: str, signs: re.Pattern, subject: str | None, w: Wording) -> list[str]:
    """The pieces at the signs outside quotation marks where both sides are clauses; content alone if there are none."""
    found = [m.span() for m in signs.finditer(outside(content))]
    if not found and not w.structured:
        return [content.strip(" ,")]
    c = clauses(content, w)
    if not found:
        return [c.told(*c.with_subject(0, len(content), subject, True))]
    parts: list[str] = []
    start = 0
    for end, after in found:
        if not may_begin(content, after, w):
            continue
        left = c.trim(start, end)
        if not c.splits(left, c.trim(after, len(content)), subject):
            continue
        done = c.told(*c.with_subject(*left, subject, start > 0))
        parts.append(done)
        start = after
        if w.structured and not _OPENER.match(done):
            subject = own_subject(done, w) or subject
    last = c.with_subject(start, len(content), subject, start > 0)
    return [*parts, c.told(*last)] if parts and c.complete(*last) else [content.strip(" ,")]


def quotations(content: str) -> Iterator[re.Match]:
    return (_QUOTATION if "”" in content else _STRAIGHT).finditer(content)


def at_quotation(content: str, then: Callable[[str, str], bool]) -> list[str]:
    """content cut behind its first quotation where then(quoted, trailing) holds, else alone."""
    found = next(quotations(content), None)
    quoted, rest = (content[: found.end()].strip(" ,"), content[found.end() :].strip(" ,")) if found else ("", "")
    return [quoted, rest] if quoted and rest and then(quoted, rest) else [content]


_SEMICOLON, _AND, _COMMA, _ALL = re.compile(r"\s*;\s*", re.ASCII), re.compile(" (?i:and) ", re.ASCII), re.compile(","), re.compile(";|,| (?i:and) ", re.ASCII)


def glosses(_: str, rest: str) -> bool:
    """Whether what follows a quotation says what it shows."""
    return bool(_OPENER.match(rest) or re.search(GLOSSED, rest.lower()))


def outer_subject(quoted: str, w: Wording) -> str | None:
    """The subject ahead of a quotation, else the one of the whole."""
    return subject_of(re.split('["“]', quoted, maxsplit=1)[0].strip(" ,"), w) or subject_of(quoted, w)


def plain_parts(content: str) -> Iterator[str]:
    """Hard texts as ``guarded_parts``; others at semicolons, behind a quotation with a gloss, at ``and``, then at commas."""
    if (guarded := guarded_parts(content)) is not None:
        yield from guarded
        return
    pieces = [p for x in (_SEMICOLON.split(content) if ";" in content else [content]) if (p := x.strip(" ,"))]
    for p in pieces:
        for q in at_quotation(p, glosses):
            for r in cut(q, _AND, subject_of(q, PLAIN), PLAIN):
                yield from cut(r, _COMMA, subject_of(r, PLAIN), PLAIN)


def told_parts(content: str, subject: str | None) -> list[str]:
    """At commas, then at ``and``, with the subject behind reporting phrases, else the one given."""
    first = own_subject(content, PLAIN) or subject
    return [p for part in cut(content.strip(" ,"), _COMMA, first, PLAIN) for p in cut(part, _AND, own_subject(part, PLAIN) or subject or first, PLAIN)]


def guarded_parts(content: str) -> list[str] | None:
    """The plain splitter's way with a heading, a gloss of several clauses, a reporting phrase or a chain of verbs; None for other texts.

    The choice between the splitters sends such texts to the structured one; this is for those that ask for the plain one."""

    def gloss_parts(t: str) -> list[str]:
        parts = at_quotation(t, glosses)
        if len(parts) == 1:
            return []
        behind = told_parts(parts[1], outer_subject(parts[0], PLAIN))
        return [parts[0], *behind] if len(behind) > 1 else []

    lead, rest = first_sentence(content)
    heading = is_label(lead, PLAIN)
    found = gloss_parts(content.strip(_SPACE))
    if not (heading or found or reports(content, quoted=False) or chained(content)):
        return None
    t = (rest if heading and rest.strip(_SPACE) else content).strip(_SPACE)
    return gloss_parts(t) or told_parts(t, None)


@once
def signs_of(content: str) -> int:
    text = outside(content)
    return text.count(",") + text.lower().count(" and ")


def reports(content: str, quoted: bool = True) -> bool:
    """A reporting phrase ahead of two signs or more; with quotations, or only without."""
    return signs_of(content) >= 2 and without_reporting(content) != content.strip(" ,") and (quoted or not has_quotation(content))


@once
def chained(content: str) -> bool:
    """Four verbs or more and three signs."""
    return signs_of(content) >= 3 and sum(map(KNOWN[False].__getitem__, _TOKEN.findall(content.lower()))) >= 4


def has_quotation(content: str) -> bool:
    return any(m.group()[1:-1].strip() for m in quotations(content))


@once
def first_sentence(content: str) -> tuple[str, str]:
    """Up to the first end of a sentence outside quotation marks, and what follows it; empty where there is none."""
    end = re.search("[.?!]", outside(content))
    return (content[: end.start()], content[end.end() :]) if end else ("", "")


def is_label(lead: str, w: Wording = STRUCTURED) -> bool:
    """Whether a first sentence is a heading rather than a clause."""
    lead = lead.strip(" ,")
    if not lead or re.search(LABEL, lead, re.ASCII) is None:
        return False
    c = clauses(lead, w)
    return not (c.complete("", 0, len(lead)) if w.structured else c.predicate([], 0, len(lead), 1))


def structured_parts(content: str) -> list[str]:
    """Without a heading, behind a quotation, then at all signs, with the subject behind reporting phrases."""
    w = STRUCTURED
    lead, rest = first_sentence(content)
    t = (rest if rest.strip(_SPACE) and is_label(lead) else content).strip(_SPACE)
    subject = own_subject(t, w)
    lower = t.lower()
    if next(quotations(t), None) is None and _MIXED.search(t) and " and later " not in lower and " and then " not in lower:
        return [t.strip(" ,")]

    def goes_on(quoted: str, rest: str) -> bool:
        return bool(_OPENER.match(rest)) or clauses(rest, w).can_begin(0, len(rest), subject or outer_subject(quoted, w))

    parts = at_quotation(t.strip(" ,"), goes_on)
    if len(parts) > 1:
        return [parts[0], *cut(parts[1], _ALL, outer_subject(parts[0], w) or subject, w)]
    return cut(parts[0].strip(" ,"), _ALL, subject, w)


def follows(content: str) -> bool:
    """A word that says that something came later, or was excepted."""
    spaced = " ".join(content.lower().split())
    return any(x in spaced for x in FOLLOWERS) and re.search(FOLLOWING, spaced) is not None


def strategy_of(content: str) -> str:
    """structured for texts of the harder kinds, else plain."""
    signs = signs_of(content)
    hard = (
        is_label(first_sentence(content)[0])
        or (signs >= 1 and has_quotation(content))
        or reports(content)
        or chained(content)
        or (signs >= 1 and follows(content))
    )
    return "structured" if hard else "plain"


def claims_of(content: str, mode: str = "auto") -> tuple[str, list[str]]:
    strategy = strategy_of(content) if mode == "auto" else mode
    parts = structured_parts(content) if strategy == "structured" else plain_parts(content)
    return strategy, [p for x in parts if (p := x.strip(" ,"))] or [content.strip(_SPACE)]


def narrow_claims(assertions: DataFrame, mode: str = "auto") -> DataFrame:
    """assertion_id, strategy, seq, claim, claim_type: the claims of each assertion (assertion_id, text) in order.

    mode: auto, plain or structured. A null or blank text has no claims."""
    rows = assertions.select("assertion_id", "text")  # blank texts are left out below: a filter here would make the texts a second time
    kind = rows.schema["assertion_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((at, t) for at, t in enumerate(batch.column("text").to_pylist()) if t and t.strip(_SPACE))
            found = [(at, strategy, i, p) for at, t in texts for strategy, parts in [claims_of(t, mode)] for i, p in enumerate(parts, 1)]
            if found:
                at, strategies, places, parts = zip(*found)
                ids = batch.column("assertion_id").take(pa.array(at, pa.int64()))
                columns = [ids, pa.array(strategies), pa.array(places, pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["assertion_id", "strategy", "seq", "claim"])

    told = rows.mapInArrow(split, f"assertion_id {kind}, strategy string, seq int, claim string")
    return told.withColumn("claim_type", text.claim_type(F.col("claim")))
