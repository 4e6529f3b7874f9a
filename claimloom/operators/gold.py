"""Results against the gold, case by case: what kind of mismatch each has, and reports by suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: suites, and what can differ in each, in order; a case on one side only is missing or unexpected
KINDS = {
    "extraction": ("extraction_text_mismatch", "claim_type_mismatch"),
    "verification_heuristics": ("missing_heuristic_flags", "unexpected_heuristic_flags", "verdict_mismatch"),
    "verification_provider": ("verdict_mismatch", "primary_anchor_mismatch", "support_role_mismatch", "support_anchor_order_mismatch"),
}


def _sides(gold: DataFrame, actual: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Both sides by case: the gold's columns as given, the others as actual_<name>."""
    theirs = actual.select("case", F.lit(True).alias("_there"), *[F.col(c).alias(f"actual_{c}") for c in columns])
    return gold.select("case", "category", F.lit(True).alias("_expected"), *columns).join(theirs, "case", "full")


def _result(rows: DataFrame, suite: str, tests: list[Column], details: Column) -> DataFrame:
    both = F.col("_expected") & F.col("_there")
    kinds = F.array_compact(F.array(*[F.when(both & t, k) for t, k in zip(tests, KINDS[suite])]))
    one = F.when(F.col("_there").isNull(), F.array(F.lit("missing_case"))).when(F.col("_expected").isNull(), F.array(F.lit("unexpected_case"))).otherwise(kinds)
    return rows.select(F.lit(suite).alias("suite"), "case", "category", one.alias("kinds"), F.when(F.size(one) > 0, details).alias("details"))


def _differ(c: str) -> Column:
    return ~F.col(c).eqNullSafe(F.col(f"actual_{c}"))


def _listed(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit("none"))


def without(a: Column, b: Column) -> Column:
    """a's entries beyond those that b has, repeats counted, in a's order: of three in a and one in b the last two are left."""
    nth = lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y.eqNullSafe(x))).alias("n")))
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.transform(F.filter(nth(a), lambda e: F.size(F.filter(b, lambda y: y.eqNullSafe(e["x"]))) < e["n"]), lambda e: e["x"])


def extraction(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """gold: case, category, texts, types; actual: case, texts, types (arrays in order). Gives suite, case, category, kinds, details (null where a case passes)."""
    rows = _sides(gold, actual, ("texts", "types"))
    details = F.concat(F.lit("lacks ["), _listed(without(F.col("texts"), F.col("actual_texts"))), F.lit("], adds ["), _listed(without(F.col("actual_texts"), F.col("texts"))), F.lit("]"))
    return _result(rows, "extraction", [_differ("texts"), _differ("types")], details)


def heuristics(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """gold: case, category, flags, verdict; actual: case, flags, verdict; flags compare as sets."""
    rows = _sides(gold, actual, ("flags", "verdict"))
    none = F.array().cast("array<string>")
    own, theirs = F.coalesce("flags", none), F.coalesce("actual_flags", none)
    lacks, adds = F.array_sort(F.array_except(own, theirs)), F.array_sort(F.array_except(theirs, own))
    said = F.concat(F.lit("lacks ["), _listed(lacks), F.lit("], adds ["), _listed(adds), F.lit("], "), F.coalesce("verdict", F.lit("none")), F.lit(" became "), F.coalesce("actual_verdict", F.lit("none")))
    return _result(rows, "verification_heuristics", [F.size(lacks) > 0, F.size(adds) > 0, _differ("verdict")], said)


def provider(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Both: case, verdict, primary_anchor, roles, anchors (arrays in order), the gold with its category."""
    rows = _sides(gold, actual, ("verdict", "primary_anchor", "roles", "anchors"))
    pair = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(" became "), F.coalesce(F.col(f"actual_{c}").cast("string"), F.lit("none")))
    return _result(rows, "verification_provider", [_differ(c) for c in ("verdict", "primary_anchor", "roles", "anchors")], F.concat_ws("; ", pair("verdict"), pair("primary_anchor")))


def suites(results: DataFrame) -> DataFrame:
    """suite, category, cases, passed, failed; cases that the gold doesn't have are under a null category."""
    return results.groupBy("suite", "category").agg(F.count("*").alias("cases"), F.count_if(F.size("kinds") == 0).alias("passed"), F.count_if(F.size("kinds") > 0).alias("failed"))


def failures(results: DataFrame) -> DataFrame:
    """suite, category, kind, failures: a case counts once for each kind that it has."""
    return results.select("suite", "category", F.explode("kinds").alias("kind")).groupBy("suite", "category", "kind").agg(F.count("*").alias("failures"))
