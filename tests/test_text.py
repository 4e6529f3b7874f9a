import pytest
from pyspark.sql import functions as F

from claimloom.functions import rules, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "claim, kind",
    [
        ("The door was open.", "FACT"), ("It was open because he left.", "INFERENCE"), ('She said "leave now".', "QUOTE"),
        ('She said "leave" and therefore knew.', "MIXED"), ("He left, which proves little.", "MIXED"), (None, "FACT"), ("", "FACT"),
    ],
)
def test_claim_types(spark, claim, kind):
    assert one(spark, text.claim_type(F.col("t")), t=claim) == kind


def test_claim_types_need_no_collapsed_text(spark):
    """The text is put in lower case once, and no white space is replaced for the patterns, which take any."""
    for said, kind in (("He SHOULD\u00a0have \n known it", "INFERENCE"), ("It leaks,\u2003\tWhich is odd", "MIXED"), ("It rained but \u0085 Thus dry", "MIXED"), ('"a" shoulder have known', "QUOTE")):
        assert one(spark, text.claim_type(F.col("t")), t=said) == kind
    plan = spark.createDataFrame([("a",)], "t string").select(text.claim_type(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_unicode_space_and_word_boundaries(spark):
    assert one(spark, text.matchable(F.col("t")), t=" A\u0085 b \n") == "a b"
    assert one(spark, text.names(F.col("t")), t="Réreer Morgan May Rerê") == ["morgan"]


def test_overlap_is_directed_and_null_safe(spark):
    tokens = lambda c: text.tokens(text.matchable(F.col(c)), rules.SUGGEST_STOP)
    assert one(spark, text.overlap(tokens("a"), tokens("b")), a="the red door", b="a red car and a door key") == 1.0
    assert one(spark, text.overlap(tokens("b"), tokens("a")), a="the red door", b="a red car and a door key") == 0.5
    assert one(spark, text.overlap(tokens("a"), tokens("b")), a="the", b="door") == 0.0


def test_quoted_phrases_match_across_punctuation(spark):
    assert one(spark, text.quoted_phrases(F.col("t")), t='He wrote "Stop, now" and “ go ” and "" x') == ["stop, now", "go"]
    assert one(spark, text.phrase_found(F.col("p"), F.col("t")), p="stop, now", t="please stop now.") is True
    assert one(spark, text.phrase_found(F.col("p"), F.col("t")), p="stop now", t="please stop it now.") is False


def test_knowledge_markers_hit_inside_words(spark):
    assert one(spark, text.mentions(F.col("t"), rules.KNOWLEDGE), t="he was unaware") is True
