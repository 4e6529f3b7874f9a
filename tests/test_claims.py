import random
import time

import pytest

from claimloom.functions import text
from claimloom.operators import claims
from claimloom.plans import splitting

#: each states one rule: a text, the splitter it goes to, its claims
CASES = [
    # two verbs of one subject
    ("Mara opened the sluice and paid the diver.", "plain", ["Mara opened the sluice", "Mara paid the diver."]),
    ("We saw smoke, heard nothing.", "plain", ["We saw smoke, heard nothing."]),
    ("Old Ivo Kern met the crew, closed the hatch.", "plain", ["Old Ivo Kern met the crew", "Old Ivo Kern closed the hatch."]),
    # a subject of five words is too long to carry
    ("Most Of The River Wardens resigned and opened a kiosk.", "plain", ["Most Of The River Wardens resigned and opened a kiosk."]),
    # a clause that names its own subject keeps it
    ("It rained and Mara was soaked.", "plain", ["It rained", "Mara was soaked."]),
    ("Mara was soaked and it was dark.", "plain", ["Mara was soaked", "it was dark."]),
    # nouns that are joined, verbs that share an object, participles before nouns
    ("The tide table lists salt and sand.", "plain", ["The tide table lists salt and sand."]),
    ("Ivo opened and closed the hatch.", "plain", ["Ivo opened and closed the hatch."]),
    ("Ivo circulated the chart and revised soundings.", "plain", ["Ivo circulated the chart and revised soundings."]),
    # semicolons always part, whatever is on their sides
    ("Rain; wind ; ; hail", "plain", ["Rain", "wind", "hail"]),
    # adverbs and what points back send a text to the structured splitter
    ("Mara sent a raft, but not the long one.", "structured", ["Mara sent a raft, but not the long one."]),
    ("Mara sent a raft and thereafter met Ivo.", "structured", ["Mara sent a raft", "Mara thereafter met Ivo."]),
    ("Mara sent a raft, then met Ivo and paid him.", "structured", ["Mara sent a raft", "Mara then met Ivo", "Mara paid him."]),
    # what comes before the clause isn't its subject
    ("In the third week, Ivo opened the lock and then resigned.", "structured", ["In the third week, Ivo opened the lock", "Ivo then resigned."]),
    # a heading goes, a clause before a full stop doesn't
    ("Weather Note: Gale. Ivo closed the lock, paid the pilot.", "structured", ["Ivo closed the lock", "Ivo paid the pilot."]),
    ("Ivo agreed. Mara was late, then went.", "structured", ["Ivo agreed. Mara was late, then went."]),
    # quotations stay whole, and what follows goes on with the speaker
    ('Ivo said, "it leaks, and I knew it," and then opened the lock.', "structured", ['Ivo said, "it leaks, and I knew it,"', "Ivo then opened the lock."]),
    ('Ivo said, "it leaks," which shows that he knew.', "structured", ['Ivo said, "it leaks,"', "which shows that he knew."]),
    ("Ivo said “no, never” to the crew.", "plain", ["Ivo said “no, never” to the crew."]),
    # the subject behind a reporting phrase
    ("This memo states Ivo closed the lock, paid the pilot, and resigned.", "structured", ["This memo states Ivo closed the lock", "Ivo paid the pilot", "Ivo resigned."]),
    # a gloss is left on
    ("Ivo closed the lock, therefore the barge was late.", "plain", ["Ivo closed the lock, therefore the barge was late."]),
    # nothing to cut
    (" ,, ", "plain", [",,"]),
    ("Salt, sand, and no verb", "plain", ["Salt, sand, and no verb"]),
    ('An open "quotation, and Ivo resigned and Mara agreed', "plain", ['An open "quotation, and Ivo resigned and Mara agreed']),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)] + [(900, None), (901, ""), (902, " \n")], "assertion_id long, text string")
    rows = {}
    for r in claims.narrow_claims(df).orderBy("assertion_id", "seq").collect():
        rows.setdefault(r["assertion_id"], []).append(r)
    return rows


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][0][:40])
def test_claims_of(found, i):
    _, strategy, want = CASES[i]
    assert [r["claim"] for r in found[i]] == want
    assert {r["strategy"] for r in found[i]} == {strategy}
    assert [r["seq"] for r in found[i]] == list(range(1, len(want) + 1))


def test_types_and_blank_texts(spark, found):
    rows = [r for x in found.values() for r in x]
    df = spark.createDataFrame([(i, r["claim"]) for i, r in enumerate(rows)], "i int, claim string")
    types = [r["t"] for r in df.select("i", text.claim_type(df["claim"]).alias("t")).orderBy("i").collect()]
    assert [r["claim_type"] for r in rows] == types and {"FACT", "QUOTE"} <= set(types)
    assert not {900, 901, 902} & set(found)


def test_modes_and_ids_of_any_type(spark):
    harder = "Weather Note: Gale. Ivo closed the lock, then paid the pilot."
    df = spark.createDataFrame([("a:1", harder, 7)], "assertion_id string, text string, claim int")
    got = {mode: [r["claim"] for r in claims.narrow_claims(df, mode).orderBy("seq").collect()] for mode in ("plain", "structured", "auto")}
    assert got["structured"] == got["auto"] == got["plain"] == ["Ivo closed the lock", "Ivo then paid the pilot."]
    assert claims.narrow_claims(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ['"it leaks {i}," and Ivo{i} signed the log{i}, ', "salt{i}, ", "Ivo{i} met Mara{i}, ", "“ "], ids=["quotations", "commas", "clauses", "open"])
def test_long_texts_cost_in_proportion(piece):
    cost = []
    for n in (1_000, 10_000):
        content = "".join(piece.format(i=i) for i in range(n))
        began = time.process_time()
        parts = claims.claims_of(content)[1]
        cost.append(time.process_time() - began)
        assert "".join(parts).count("Ivo") == content.count("Ivo")
    assert cost[1] < 40 * cost[0] + 1


#: texts that the choice gives to the structured splitter, and what the plain one makes of them when asked for
PLAIN_CASES = [
    # a heading goes; alone it stays
    ("Weather Note: Gale. Ivo closed the lock, paid the pilot.", ["Ivo closed the lock", "Ivo paid the pilot."]),
    ("Weather Note: Gale.", ["Weather Note: Gale."]),
    # a gloss of two clauses is cut, one of a single clause is not
    ('Ivo wrote, "it leaks," which shows that Kern knew it and Mara resigned.', ['Ivo wrote, "it leaks,"', "which shows that Kern knew it", "Mara resigned."]),
    ('Ivo wrote, "it leaks," which shows that Kern knew it.', ['Ivo wrote, "it leaks,"', "which shows that Kern knew it."]),
    # what follows a quotation without a gloss is left on, signs or not
    ('Ivo wrote, "it leaks," to Mara, Kern.', ['Ivo wrote, "it leaks," to Mara, Kern.']),
    # the subject behind a reporting phrase
    ("This memo states Ivo closed the lock, paid the pilot, and resigned.", ["This memo states Ivo closed the lock", "Ivo paid the pilot", "Ivo resigned."]),
    # a chain of verbs: at commas first; a piece of three words that begins with its verb is no clause to cut behind
    ("Mara met Ivo, closed the lock, paid the pilot, and resigned.", ["Mara met Ivo", "Mara closed the lock, paid the pilot", "Mara resigned."]),
    # semicolons part other texts only
    ("Mara met Ivo; it rained", ["Mara met Ivo", "it rained"]),
]


@pytest.mark.parametrize("content,want", PLAIN_CASES, ids=lambda x: str(x)[:40])
def test_plain_when_asked_for(content, want):
    assert claims.claims_of(content, "plain") == ("plain", want)


def test_lines_are_dealt_evenly_and_their_words_found_once(spark, sf):
    """However few row groups a file has; and a text that is made of columns is made once, not again to see if it is blank."""
    plan = splitting.u1(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("regexp_extract_all(line") == 1


def test_blank_texts_and_small_letters(spark):
    rows = [("a", None), ("b", ""), ("c", " \t\n\v\f\r"), ("d", " "), ("e", "İ signed it and she approved it")]
    found = claims.narrow_claims(spark.createDataFrame(rows, "assertion_id string, text string")).collect()
    assert {r["assertion_id"] for r in found} == {"d", "e"}
    assert claims.Clauses("İİ Σ ΑΣ K signed", claims.PLAIN).tokens.starts == [8, 10]


def test_signs_with_no_clause_behind_them_are_passed_over(monkeypatch):
    """Most signs are followed by words that can't begin a clause; the stretches around them aren't looked at, nor is a text without others."""
    asked, made = [], []
    splits, places = claims.Clauses.splits, claims.Places.__init__
    monkeypatch.setattr(claims.Clauses, "splits", lambda self, *a: asked.append(a) or splits(self, *a))
    monkeypatch.setattr(claims.Places, "__init__", lambda self, *a: made.append(a) or places(self, *a))
    of = "Mara opened the hatch, the sluice and the lid, all of them, Old Kern Ivo Lund too"
    assert claims.claims_of(of) == ("plain", [of]) and not asked and not made
    assert claims.claims_of(f"{of}, and she paid the diver in full, of course")[1] == [of, "she paid the diver in full, of course"]
    assert len(asked) == 1


def test_what_is_passed_over_is_no_place_to_cut(monkeypatch):
    pick = random.Random(5).choice
    words = "Mara she Which which so then thené then'tis later and but Not , ; : . \" “ ” said paid opened is isé related créed attached in At on, after İvo don't 'tis x_is the pump Log".split()
    odd = ["".join(pick(words) + pick((" ", " ", ", ", " and ", "; ", "")) for _ in range(25)) for _ in range(3000)]
    got = [claims.claims_of(x, mode) for x in odd for mode in ("plain", "structured")]
    assert sum(len(found) > 1 for _, found in got) > 1000
    monkeypatch.setattr(claims, "may_begin", lambda *a: True)
    assert got == [claims.claims_of(x, mode) for x in odd for mode in ("plain", "structured")]


def test_a_word_that_a_lead_ends_in_is_not_begun_anew():
    assert claims.Clauses("x, then'tis Log was", claims.STRUCTURED).first_words(7, 19, 2) == ["Log", "was"]
    assert claims.Clauses("x, then 'tis Log", claims.STRUCTURED).first_words(7, 16, 2) == ["tis", "Log"]
