"""The claim graph: duplicate, contradiction, dependency and support edges within a draft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules, text


#: tenths of the smaller core that each relation needs, at least
LEAST_SHARE = 6


def prepared(claims: DataFrame) -> DataFrame:
    normal = text.matchable(F.col("text"))
    rows = claims.select("draft_id", "claim_id", normal.alias("normal"), text.claim_type(F.col("text")).alias("type"), text.tokens(normal, rules.GRAPH_STOP).alias("tokens"))
    negations = text.words(rules.NEGATIONS)
    return rows.filter(F.size("tokens") > 0).select(
        "draft_id", "claim_id", "normal", "type", F.arrays_overlap("tokens", negations).alias("negated"), F.array_except("tokens", negations).alias("core")
    )


def classes(rows: DataFrame) -> DataFrame:
    """draft_id, normal, type, class_id (the first claim's), negated, core: a row for all equal claims of a draft, of prepared() rows."""
    return rows.groupBy("draft_id", "normal", "type").agg(F.min("claim_id").alias("class_id"), F.first("negated").alias("negated"), F.first("core").alias("core"))


def candidates(rows: DataFrame) -> DataFrame:
    """l_id, r_id: the pairs of classes of a draft that can share LEAST_SHARE of the smaller one's core.

    Of n tokens those that are rarest in the draft are the prefix, as many as leave fewer than the share
    needed: a pair that shares enough shares one of the smaller one's prefix. So a token
    that most claims have is looked up for those claims alone that have no rarer ones."""
    tokens = rows.select("draft_id", "class_id", F.size("core").alias("n"), F.explode("core").alias("token"))
    common = tokens.groupBy("draft_id", "token").agg(F.count("*").alias("held"))
    ordered = tokens.join(common, ["draft_id", "token"]).groupBy("draft_id", "class_id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("rarest"))
    needed = F.expr(f"({LEAST_SHARE} * n + 9) div 10").cast("int")
    prefix = ordered.select("draft_id", "class_id", "n", F.explode(F.slice("rarest", F.lit(1), F.col("n") - needed + 1)).alias("x"))
    a, b = prefix.select("draft_id", "class_id", "n", "x.token").alias("a"), tokens.alias("b")
    smaller = F.expr("a.n < b.n OR a.n = b.n AND a.class_id < b.class_id")
    met = a.join(b, (F.col("a.draft_id") == F.col("b.draft_id")) & (F.col("a.token") == F.col("b.token")) & smaller)
    return met.select("a.draft_id", F.col("a.class_id").alias("l_id"), F.col("b.class_id").alias("r_id")).distinct()


def class_edges(rows: DataFrame) -> DataFrame:
    """draft_id, source_id, target_id, relation, confidence between classes, duplicates left out.

    Every relation needs 0.6 or more of the smaller core in common, so pairs are candidates()."""
    side = lambda s: rows.select(
        F.col("draft_id"), *[F.col(c).alias(f"{s}_{n}") for c, n in (("class_id", "id"), ("type", "type"), ("negated", "neg"), ("normal", "normal"), ("core", "core"))], F.size("core").alias(f"{s}_n")
    )
    pairs = candidates(rows).join(side("l"), ["draft_id", "l_id"]).join(side("r"), ["draft_id", "r_id"]).filter("l_normal != r_normal")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("l_core", "r_core")))
    contradicts = F.expr("l_neg != r_neg AND least(l_n, r_n) >= 2 AND both / least(l_n, r_n) >= 0.8")
    fact, inferred = "IN ('FACT', 'QUOTE', 'MIXED')", "IN ('INFERENCE', 'MIXED')"
    edge = lambda test, source, target, relation, confidence: F.when(
        test, F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
    )
    plain = ~F.col("contradicts")
    found = pairs.withColumn("contradicts", contradicts).withColumn("e", F.array(
        edge(F.col("contradicts"), "l_id", "r_id", "contradicts", 0.91), edge(F.col("contradicts"), "r_id", "l_id", "contradicts", 0.91),
        edge(plain & F.expr("l_n >= r_n + 2 AND both = r_n"), "l_id", "r_id", "depends_on", 0.73),
        edge(plain & F.expr("r_n >= l_n + 2 AND both = l_n"), "r_id", "l_id", "depends_on", 0.73),
        edge(plain & F.expr(f"l_type {fact} AND r_type {inferred} AND both / r_n >= 0.6"), "l_id", "r_id", "supports", 0.68),
        edge(plain & F.expr(f"r_type {fact} AND l_type {inferred} AND both / l_n >= 0.6"), "r_id", "l_id", "supports", 0.68),
    ))
    return found.select("draft_id", F.explode("e").alias("e")).filter("e IS NOT NULL").select("draft_id", "e.*")


def claim_edges(claims: DataFrame) -> DataFrame:
    """draft_id, source_id, target_id, relation, confidence.

    claims: draft_id, claim_id (their order), text. Equal claims are compared as one, and
    what holds of a class is told of each of its claims at the end."""
    each = prepared(claims)
    rows = classes(each)
    members = each.join(rows.select("draft_id", "normal", "type", "class_id"), ["draft_id", "normal", "type"])
    end = lambda name: members.select("draft_id", F.col("class_id").alias(name), F.col("claim_id").alias(f"{name}_claim"))
    others = class_edges(rows).join(end("source_id"), ["draft_id", "source_id"]).join(end("target_id"), ["draft_id", "target_id"])
    others = others.select("draft_id", F.col("source_id_claim").alias("source_id"), F.col("target_id_claim").alias("target_id"), "relation", "confidence")
    x, y = each.alias("x"), each.alias("y")
    same = x.join(y, F.expr("x.draft_id = y.draft_id AND x.normal = y.normal AND x.claim_id != y.claim_id"))
    same = same.select("x.draft_id", F.col("x.claim_id").alias("source_id"), F.col("y.claim_id").alias("target_id"), F.lit("duplicate_of").alias("relation"), F.lit(1.0).alias("confidence"))
    return same.unionByName(others)
