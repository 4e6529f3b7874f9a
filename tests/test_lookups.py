import re
import time

from claimloom.operators import authority
from claimloom.operators import lookups as jobs

from claimloom.operators import lookups


def test_citations_with_places_and_propositions(spark):
    text = "It was so. See Roe v. Poe, 12 F.3d 345 (1999) held that no. 5 stands. Then Doe v. Foe, 1 U.S. 2, 3 (1801) came"
    other = "é Roe v. Poe, 1 U.S. 2 (1800)! Doe v. Foe, 3 U.S. 4 and 5.5 v. x? no. End"
    df = spark.createDataFrame([(1, text), (2, None), (3, "x v. y"), (4, other), (5, "none here")], "doc_id long, text string")
    got = [tuple(r) for r in lookups.citation_pairs(df).orderBy("doc_id", "start").collect()]
    at = lambda t, part: (t.index(part), t.index(part) + len(part))
    want = [
        (1, "See Roe v. Poe, 12 F.3d 345 (1999)", *at(text, "See Roe v. Poe, 12 F.3d 345 (1999)"), "See Roe v. Poe, 12 F.3d 345 (1999) held that no. 5 stands."),
        (1, "Then Doe v. Foe, 1 U.S. 2, 3 (1801)", *at(text, "Then Doe v. Foe, 1 U.S. 2, 3 (1801)"), "Then Doe v. Foe, 1 U.S. 2, 3 (1801) came"),
        (4, "Roe v. Poe, 1 U.S. 2 (1800)", *at(other, "Roe v. Poe, 1 U.S. 2 (1800)"), "é Roe v. Poe, 1 U.S. 2 (1800)!"),
        (4, "Doe v. Foe, 3 U.S. 4", *at(other, "Doe v. Foe, 3 U.S. 4"), "Doe v. Foe, 3 U.S. 4 and 5.5 v. x? no."),
    ]
    assert got == want


def sentences_by_hand(text):
    """By walking from each citation to both sides, a character at a time."""

    def ends(i):
        if text[i] not in ".?!" or (i > 0 and text[i - 1] in "vV"):
            return False
        rest = text[i + 1 :].lstrip(" \t\n\r\f\v")
        return not rest or rest[0].isupper()

    spans = []
    for m in re.finditer(authority.CITATION, text):
        raw, start = m.group(0), m.start()
        lines = raw.split("\n")
        named = [i for i, line in enumerate(lines) if " v. " in line + ("\n" if i < len(lines) - 1 else "")]
        if named:
            head = "".join(line + "\n" for line in lines[: named[0]])
            raw, start = raw[len(head) :], start + len(head)
        cite = " ".join(raw.split()).strip(" ,.;:")
        spans.append((cite, start, start + len(cite)))
    out = []
    for k, (cite, start, end) in enumerate(spans):
        limit = spans[k + 1][1] if k + 1 < len(spans) else len(text)
        begin = next((i + 1 for i in range(start - 1, -1, -1) if ends(i)), 0)
        finish = next((i + 1 for i in range(end, limit) if ends(i)), limit)
        out.append((cite, start, end, text[begin:finish].strip()))
    return out


def pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {i: [] for i in range(len(texts))}
    for r in jobs.citation_pairs(df).orderBy("doc_id", "start").collect():
        rows[r["doc_id"]].append(tuple(r)[1:])
    return rows


def test_propositions_by_hand(spark):
    cites = ["Oak v. Elm, 12 F.3d 345 (2d Cir. 1999)", "Ash Corp. v. Fir, 7 U.S. 88", "Yew v.  Box, 3 Rep. 4, 5-6", "Bay\nPine v. Fig, 1 A. 2"]
    joints = ["", " ", ". ", ". then ", ". Then ", "! ", "?\n", " v. ", " so it was. And more", "; ", ".\n\n", " é. É ", " ends.", "V. Z "]
    texts = [None, "", "No citation v. here.", "v."]
    for i in range(120):
        parts = [joints[(i * 7 + k * (3 + i // 14)) % len(joints)] + cites[(i + k * k) % len(cites)] for k in range(1 + i % 4)]
        texts.append("".join(parts) + joints[i % len(joints)])
    got = pairs(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == (sentences_by_hand(t) if t else []), t


def test_many_citations_in_one_text(spark):
    """Ten thousand take seconds, not hours."""
    text = " ".join(f"Rule {i} was set in Oak{i} v. Elm, {1 + i % 900} F.3d {i} (2d Cir. 1999). It holds" for i in range(10_000))
    pairs(spark, [text[:50_000]])
    began = time.time()
    got = pairs(spark, [text])[0]
    assert len(got) == 10_000 and time.time() - began < 60
    assert got[1][3] == "It holds Rule 1 was set in Oak1 v. Elm, 2 F.3d 1 (2d Cir. 1999)."
