import random
import zlib
from collections import Counter

import numpy as np

from claimloom.llm import language_id as li
from claimloom.llm._shared import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    wrong = [r["doc_id"] for r in out if r["lang_pred"] != r["lang"]]
    print(len(out), wrong)
    assert len(wrong) <= 0.02 * len(out)


def test_edges(spark):
    words = {"aa": "the thing that was there ", "bb": "der die das und nicht "}
    rows = [(i, text * 3, lang, "x") for i in range(60) for lang, text in words.items() for i in (2 * i + (lang == "bb"),)]
    rows += [(500, None, "aa", ""), (501, "", "aa", ""), (502, "12 !!", "bb", ""), (503, "qqqq zzzz", None, ""), (None, "the thing", "aa", ""), (504, "das und nicht", None, "")]
    rows += [(505, "the thing that was " * 20000, None, "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {}
    for r in li.language_id(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert got[503][0]["lang_pred"] == "aa" and got[503][0]["score"] == 0
    assert got[None][0]["lang_pred"] == "aa" and got[None][0]["held_out"] is False
    assert got[504][0]["lang_pred"] == "bb" and got[504][0]["score"] > 0.9
    assert [r["lang_pred"] for r in got[505]] == ["aa", "aa"]
    assert li.language_id(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.language_id(df.withColumn("lang", df.score)).collect() if r["doc_id"] == 500} == {"und"}


def test_many_languages_and_the_filter_holds_what_went_in():
    rng = np.random.default_rng(1)
    languages = [f"l{i:03}" for i in range(70)]
    grams = rng.integers(-(2**62), 2**62, 70 * 50)
    filters = li.build(languages, [(int(g), i // 50) for i, g in enumerate(grams)])
    hits = filters.hits(grams.view(np.uint64), np.arange(0, 70 * 50 + 1, 50))
    assert (np.diag(hits) == 50).all() and hits.sum() < 70 * 50 * 1.01


def test_a_language_of_one_long_document(spark):
    rng = np.random.default_rng(7)
    ids = [r["id"] for r in spark.range(100).filter(~li.held_out(li.F.col("id"))).limit(4).collect()]
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), 7)) for _ in range(n))
    rows = [(ids[0], words("abcdefg", 400), "xx"), *[(i, "tuv utv vtu", "yy") for i in ids[1:]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = li.learn(docs, top=100)
    assert filters.languages == ["xx", "yy"]
    assert filters.decide([rows[0][1], rows[1][1]])[0] == ["xx", "yy"]


def grams(text):
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [s[i : i + 4] for i in range(len(s) - 3) if s[i + 1].isalpha() and s[i + 2].isalpha()]


def test_against_a_count_by_hand(spark):
    """Counts, shares, the choice of n-grams and the decision, without filters or hashes."""
    rng = random.Random(6)
    syllables = {"aa": ["the", "and", "ing", "sh", "ou"], "bb": ["der", "sch", "und", "ei", "ou"], "cc": ["que", "les", "tion", "ou", "sh"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 25))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if i % 5 else None))
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    n = Counter(lang for _, lang in learned)
    docs = Counter((lang, g) for t, lang in learned for g in set(grams(t)))
    share = {k: v / n[k[0]] for k, v in docs.items() if v >= min(3, max(1, n[k[0]] / 100))}
    most = {}
    for (_, g), x in share.items():
        most[g] = max(x, most.get(g, 0))
    kept = {lang: {g for (k, g), x in share.items() if k == lang and x >= 0.3 * most[g]} for lang in sorted(n)}
    got = {r["doc_id"]: r for r in li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, text, _ in rows:
        hits = {lang: sum(g in own for g in grams(text)) for lang, own in kept.items()}
        best, rival = sorted(hits.values(), reverse=True)[:2]
        assert got[i]["lang_pred"] == next(lang for lang in sorted(hits) if hits[lang] == best)
        assert abs(got[i]["score"] - (best / (best + rival) if best else 0)) < 1e-6
