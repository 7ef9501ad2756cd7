from corpusloom.functions import text as tx
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()[0]


def test_tokens(spark):
    assert one(spark, "The model uses convolutional compression with high ratio", lambda t: F.size(tx.with_bigrams(tx.bare_tokens(t)))) == 15
    assert one(spark, "The Model-X uses", lambda t: tx.with_bigrams(tx.bare_tokens(t))) == ["the", "modelx", "uses", "the_modelx", "modelx_uses"]
    assert one(spark, "", lambda t: tx.with_bigrams(tx.bare_tokens(t))) == []
    assert one(spark, "  été, 16x !! a_b ", tx.bare_tokens) == ["été", "16x", "a_b"]


def test_normalisation(spark):
    cases = [
        ("The original ﬁle contains ﬂexible text", "The original file contains flexible text"),
        ("Text with various​spaces", "Text with variousspaces"),
        ("re-\n search", "research"),
        ("This is normal text without issues", "This is normal text without issues"),
    ]
    for given, want in cases:
        always = given.startswith("re-")
        assert one(spark, given, lambda t: tx.normalize_for_rag(t, always)) == want  # noqa: B023
    given = "The ﬁrst ﬂoor oﬃce has ﬀ and ﬃ ligatures"
    assert one(spark, given, tx.sanitize_pdf_text) == "The first floor office has ff and ffi ligatures"
    assert one(spark, given, tx.ligature_count) == 5
    once = one(spark, cases[0][0], tx.normalize_for_rag)
    assert one(spark, once, tx.normalize_for_rag) == once


def test_redaction(spark):
    assert one(spark, "a.b@ex.org 555-123-4567", tx.redact_pii) == "[EMAIL_REDACTED] [PHONE_REDACTED]"


def test_jaccard(spark):
    pair = spark.createDataFrame([("Le chat mange la souris", "La souris mange le fromage"), ("", ""), ("a", "")], "a string, b string")
    got = [r[0] for r in pair.select(tx.jaccard_words(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 6) for x in got] == [0.666667, 1.0, 0.0]


def test_condense_and_sentences(spark):
    long = "One sentence here. " * 5 + "and a rest without end that goes on"
    assert one(spark, long, lambda t: tx.condense(t, 60)) == ("One sentence here. " * 3).strip()
    assert one(spark, "short", lambda t: tx.condense(t, 60)) == "short"
    assert one(spark, "word " * 30, lambda t: tx.condense(t, 22)).endswith("...")
    assert one(spark, "Too short. This one is long enough to be kept here! x", lambda t: tx.key_sentences(t, 2)) == ["This one is long enough to be kept here"]


def test_gated_patterns_match_alike(spark):
    """The look ahead changes no count, also where letters have odd cases."""
    import pytest
    from corpusloom.functions import classify

    with pytest.raises(ValueError):
        classify.gated("", r"(\w+|ab)")
    texts = ["ſection ARTICLE articleſ", "SAſ Inc. İnc. FY 2020", "P/E Ratio, p/e ratio", "ARRÊTÉS xarrêté arrêté", "Résumé Exécutif BÉNÉFICE NET", "ſtatutory articles L. 5", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lists = [(classify.ANY_CASE, p) for p in (classify.BUSINESS_SECTIONS, classify.BUSINESS_METRICS, classify.COMPANIES, classify.FISCAL, classify.LEGAL_CLAUSES)] + [("(?iU)", p) for p in classify.STRONG_LEGAL]
    for flags, p in lists:
        assert df.where(F.regexp_count("t", F.lit(flags + p)) != F.regexp_count("t", F.lit(classify.gated(flags, p)))).count() == 0
