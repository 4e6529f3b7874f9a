import hashlib
import re

import pytest
from pyspark.sql import functions as F

from claimloom.llm import fill_in_middle as fim
from claimloom.llm._shared import table
from tests.oracle import compare


def brute(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < spm_rate
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text), out


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é\n\U0001f600ß\n", "with <P> inside\nx", "<S>", "<M>\n", "< P>\n<p>\nP>\n<S",
    "ends with <\nS>\n<\nP>", "\r\n\r\n x", "S>a\nM>b\nP>c<", "q" * 300 + "\n" + "é" * 500, "\n".join(f"line {i}" for i in range(200)),
]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 15])
def test_same_as_by_hand(spark, size):
    rows = [(100 * j + i, t, "clash") for j in range(4) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "x"), (7, "a\nb\nc", "x"), (7, "a\nb\nc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(5, F.col("doc_id"))
    got = sorted((tuple(r) for r in fim.transformed(df, size=size).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    got = {tuple(r) for r in fim.transformed(df, rate=40, spm_rate=10).collect()}
    assert got == {brute(i, "a\nb\nc\nd", 40, 10) for i in range(300)}


def test_pieces_are_small_and_ordered(spark):
    df = spark.createDataFrame([(3, "é" * 50_000 + "\n" + "word \n" * 20_000)], "doc_id long, text string")
    found = fim.pieces(df, size=1000).collect()
    assert all(len(r["data"]) <= 1003 for r in found) and [r["at"] for r in found] == list(range(len(found))) and len(found) > 200
    for r in found:
        r["data"].decode()
    assert tuple(fim.transformed(df, size=1000).first()) == brute(3, "é" * 50_000 + "\n" + "word \n" * 20_000)


def test_one_shuffle(spark, sf):
    plan = fim.transformed(table(spark, sf, "documents"), with_text=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query(spark, sf):
    assert compare(spark, sf, lambda s, d: fim.transformed(table(s, d, "documents"), with_text=False), fim.oracle()) is None
    assert fim.transformed(table(spark, sf, "documents").limit(0)).count() == 0
