import random
import re

import duckdb
from pyspark.sql import functions as F

from claimloom.functions import rules, text
from claimloom.operators import graph
from claimloom.plans import evidence


def edges_by_hand(rows):
    """Every pair of a draft, both ways, by the rules; rows: draft, id, text, with the types that Spark found."""
    claims = []
    for draft, i, content, kind in rows:
        normal = " ".join(content.lower().split())
        tokens = {t for t in re.findall(rules.TOKEN, normal)} - set(rules.GRAPH_STOP)
        if tokens:
            claims.append((draft, i, normal, kind, bool(tokens & set(rules.NEGATIONS)), tokens - set(rules.NEGATIONS)))
    out = set()
    for d, i, n, k, neg, core in claims:
        for e, j, m, h, other, rest in claims:
            if d != e or i == j:
                continue
            if n == m:
                out.add((d, i, j, "duplicate_of"))
                continue
            both, least = len(core & rest), min(len(core), len(rest))
            if neg != other and least >= 2 and both / least >= 0.8:
                out.add((d, i, j, "contradicts"))
                continue
            if both and len(core) >= len(rest) + 2 and both == len(rest):
                out.add((d, i, j, "depends_on"))
            if both and k in ("FACT", "QUOTE", "MIXED") and h in ("INFERENCE", "MIXED") and both / len(rest) >= 0.6:
                out.add((d, i, j, "supports"))
    return out


def test_same_as_every_pair(spark):
    rng = random.Random(8)
    words = ["pier", "tide", "salt", "crane", "rope", "lamp", "fog", "wharf", "not", "therefore", "the", "never"]
    rows = [(i % 3, i, " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(1, 6)))) for i in range(150)]
    rows += [(0, 900, "PIER  tide"), (0, 901, "pier tide"), (1, 902, ""), (1, 903, "the"), (1, 904, 'He saw "fog"')]
    df = spark.createDataFrame(rows, "draft_id long, claim_id long, text string")
    typed = {r["claim_id"]: r["type"] for r in graph.prepared(df).collect()}
    want = edges_by_hand([(*r, typed.get(r[1])) for r in rows])
    got = [tuple(r)[:4] for r in graph.claim_edges(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[3] for r in want} == {"duplicate_of", "contradicts", "depends_on", "supports"}


def test_a_large_draft_meets_few_pairs(spark):
    """10,000 claims that share a word: pairs grow with the rare words that they share."""
    content = F.concat(F.lit("the pier "), *[F.concat(F.lit(f" w{k}"), (F.hash("id", F.lit(k)) % 5000).cast("string")) for k in range(6)])
    claims = spark.range(10_000).select(F.lit(1).alias("draft_id"), F.col("id").alias("claim_id"), content.alias("text"))
    found = graph.candidates(graph.classes(graph.prepared(claims))).count()
    assert 0 < found < 100_000 < 10_000 * 9_999 / 2


def test_query_has_all_relations(spark, sf):
    found = evidence.j14(spark, sf).groupBy("relation").count().collect()
    assert {r["relation"] for r in found} >= {"duplicate_of", "contradicts", "depends_on", "supports"} and all(r["count"] > 1 for r in found)


def test_capitals_of_single_characters(spark, tmp_path):
    """A claim in capitals equals the claim, also with letters that full upper case makes several of."""
    said = "Die Straße am Fluß. Der Weg \ufb01el ab, \u1f80 \u0149 \u01f0. Groß ist das Maß. Weiß und süß auf der Straße"
    spark.createDataFrame([(1, said), (2, said.replace("Fluß", "Meer"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r for r in evidence.j14(spark, str(tmp_path)).collect() if r["relation"] == "duplicate_of"]
    assert {(103, -104), (203, -204)} <= {(r["source_id"], r["target_id"]) for r in found}
    rows = spark.createDataFrame([(c,) for c in rules.EXPANDED + "abcäéß"], "text string").select("text", text.capitals(F.col("text")).alias("up")).collect()
    assert all(duckdb.execute("SELECT upper(?)", [r["text"]]).fetchone()[0] == r["up"] for r in rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(map(tuple, evidence.j14(spark, str(tmp_path)).collect())) == sorted(db.execute(evidence.J14).fetchall())
