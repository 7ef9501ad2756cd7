import math

import pytest
from corpusloom.functions import classify, numeric, vectors
from corpusloom.operators import bm25, rerank, scoring
from pyspark.sql import functions as F

DOCS = [
    (1, "neural network uses convolutional compression architecture"), (2, "vision model uses parallel computation method"),
    (3, "another document about transformers and attention"),
]


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()[0]


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string")
    queries = spark.createDataFrame([(1, "neural compression architecture")], "query_id long, query string")
    terms = bm25.query_terms(queries)
    index = bm25.build_index(docs, terms)
    assert index.mean_length == 11.0 and index.rows == 3
    rows = bm25.bm25(terms, index).collect()
    assert [(r.doc_id, round(r.sparse, 6)) for r in rows] == [(1, round(4 * math.log(2.5 / 1.5 + 1), 6))]


def test_keyword_boost(spark):
    docs = spark.createDataFrame([
        (1, "The neural network uses advanced compression in its architecture"), (2, "a neural thing"), (3, "other"), (4, "words"), (5, "entirely"),
    ], "doc_id long, content string")
    queries = spark.createDataFrame([(1, "neural compression architecture")], "query_id long, query string")
    terms = bm25.query_terms(queries)
    usable = bm25.boost_tokens(terms, bm25.build_index(docs, terms))
    rows = bm25.keyword_boost(usable, bm25.containing(usable, docs)).collect()
    assert {r.doc_id: round(r.keyword, 6) for r in rows} == {1: 0.575094, 2: 0.175094}


def test_containing_matches_inside_words(spark):
    docs = spark.createDataFrame([(1, "Supercompression é"), (2, "press on"), (3, None)], "doc_id long, content string")
    tokens = spark.createDataFrame([("press",), ("é",), ("on",), ("xyz",)], "token string")
    assert {(r.token, r.doc_id) for r in bm25.containing(tokens, docs).collect()} == {("press", 1), ("press", 2), ("é", 1), ("on", 1), ("on", 2)}


def test_normalisation_and_fusion(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.2, 0.5, 0.8, 0.3])] + [(2, 0, 0.7)], "query_id int, i int, s double")
    # query 1 has all four candidates, query 2 one of four: the others count as 0
    ranges = scoring.score_ranges(rows, ["s"], 4)
    scaled = scoring.min_max(F.col("s"), F.col("low_s"), F.col("high_s"))
    got = {(r.query_id, r.i): (round(r.m, 6), r.mean_s, r.deviation_s) for r in rows.join(ranges, "query_id").withColumn("m", scaled).collect()}
    assert [got[1, i][0] for i in range(4)] == [0.0, 0.5, 1.0, 0.166667] and got[2, 0][0] == 1.0
    assert got[1, 0][1:] == pytest.approx((0.45, 0.05**0.5 * 1.0246951), rel=1e-5) and got[2, 0][1] == 0.7 / 4
    pairs = spark.createDataFrame([(1, 1, 0.7, 0.9, 0.8), (1, 2, 0.3, 0.1, 0.0)], "query_id int, doc_id int, dense double, sparse double, keyword double")
    ranges = scoring.score_ranges(pairs, scoring.NAMES, 2)
    assert {r.doc_id: round(r.hybrid, 6) for r in scoring.hybrid_scores(pairs, ranges).collect()} == {1: 1.0, 2: 0.0}
    # exact phrases weigh sparse scores by a half
    third = spark.createDataFrame([(1, 3, 0.3, 0.9, 0.0)], pairs.schema)
    intents = spark.createDataFrame([(1, "ExactPhrase")], "query_id int, intent string")
    assert {r.doc_id: round(r.hybrid, 6) for r in scoring.hybrid_scores(pairs.union(third), ranges, intents).collect()} == {1: 1.0, 2: 0.0, 3: 0.5}


def test_similar_pairs(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [2.0, 0.0])]
    points = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 5.0])], "query_id long, embedding array<double>")
    want = {(9, 1): 1.0, (9, 2): 0.6, (9, 6): 1.0, (8, 2): 0.8}
    for most in (vectors.SENT_QUERIES, 1):
        monkeypatch.setattr(vectors, "SENT_QUERIES", most)
        got = {(r.query_id, r.doc_id): r.score for r in vectors.similar_pairs(asked, points).collect()}
        assert got == {(q, d): pytest.approx(want.get((q, d), 0.0)) for q in (8, 9) for d in range(1, 7)}
        best = scoring.top_k(vectors.similar_pairs(asked, points, 2), 2).collect()
        assert sorted((r.query_id, r.rank, r.doc_id) for r in best) == [(8, 1, 2), (8, 2, 1), (9, 1, 1), (9, 2, 6)]


@pytest.mark.parametrize(("query", "kind"), [
    ("DeepEncoder c'est quoi ?", "TextAtomic"), ("95.1%", "DigitAtomic"), ("DeepEncoder avec conv 16x et SAM dans l'encodeur", "DigitAtomic"),
    ("précision de décodage à compression inférieur à 10x", "DigitCombined"), ("Quel niveau de précision à 10x compression ?", "DigitCombined"),
])
def test_query_kind(spark, query, kind):
    assert col(spark, query, numeric.query_kind) == kind


@pytest.mark.parametrize(("query", "want"), [
    ("précision inférieur à 10x", [("less", 10.0, 10.0, "x")]), ("< 10x", [("less", 10.0, 10.0, "x")]), ("entre 5x et 10x", [("between", 5.0, 10.0, "x")]),
    ("10x compression", [("exact", 10.0, 10.0, "x")]), ("nothing", []),
])
def test_constraints(spark, query, want):
    assert [tuple(c) for c in col(spark, query, numeric.constraints)] == want


def test_values_and_matches(spark):
    chunk = "Tokens 600–700: 96.5% at 10.5× compression, 98.5% at 6.7×"
    assert [(v.value, v.unit) for v in col(spark, chunk, numeric.values)] == [(96.5, "%"), (98.5, "%"), (10.5, "x"), (6.7, "x")]
    pairs = [("< 10x", chunk, True), ("> 95%", chunk, True), ("10x", "10.4x", True), ("10x", "10.5x", False), ("10x", "10%", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "q string, c string")
    got = [r[0] for r in df.select(numeric.has_match(F.col("c"), numeric.constraints(F.col("q")))).collect()]
    assert got == [p[2] for p in pairs]


def test_section_prior(spark):
    rows = [
        ("Smith et al. (2020). arxiv:2010.12345. doi:10.1234/test. https://example.com", "Document Text", True, None),
        ("The room may be part of a library with furniture and shelves dedicated to books", "Document Text", True, None),
        ("Figure 3: Model", "Figure Caption", True, None), ("Abstract: In this paper we propose a novel approach...", "Document Text", False, 0.15),
        ("Table 3 shows benchmark results on OmniDocBench...", "Table", False, -0.15),
        ("We compare against Qwen, OLMOCR, InternVL, and MinerU...", "Document Text", False, -0.20),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "c string, s string")
    got = df.select(rerank.is_contaminated(F.col("c"), F.col("s")), rerank.section_prior(F.col("c"), F.col("s"))).collect()
    for r, (_, _, dropped, prior) in zip(got, rows, strict=True):
        assert r[0] == dropped and (prior is None or abs(r[1] - prior) < 1e-9)


def test_query_aware(spark):
    rows = [("Table 3: benchmark results", 0.99, 0.495), ("We propose to leverage visual compression", 0.85, 0.825), ("Abstract: Our goal is to compress text", 0.80, 0.90)]
    df = spark.createDataFrame(rows, "c string, s double, w double")
    for r in df.withColumn("got", rerank.query_aware_score(F.col("s"), F.lit("what is the goal"), F.col("c"), 0.5)).collect():
        assert abs(r.got - r.w) < 1e-6


def test_mmr(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0, 0.0]), (1, 2, 0.8, [0.9, 0.1, 0.0]), (1, 3, 0.7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, [1.0, 0.0, 0.0]) for r in rows], "query_id long, doc_id long, score double, embedding array<double>, query_embedding array<double>")
    assert [r.doc_id for r in rerank.mmr(df, 2, 0.3).orderBy("place").collect()] == [1, 3]
    assert rerank.mmr(df, 9, 0.5).count() == 3


def test_collapse(spark):
    rows = [(1, 1, 0.5, 1, "a b c d"), (1, 2, 0.9, 2, "a b c d"), (1, 3, 0.4, 3, "x y z")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int, content string")
    assert [(r.doc_id, r.place) for r in rerank.collapse_near_duplicates(df).orderBy("place").collect()] == [(2, 1), (3, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0], [1.0, 1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_classification(spark):
    years = {"FY 2023": 2023, "Fiscal Year 2022": 2022, "Year Ended December 31, 2021": 2021, "Annual Report 2024": 2024, "none": None}
    for text, year in years.items():
        assert col(spark, text, classify.fiscal_year) == year
    numbers = {"1,234": 1234.0, "1,234.56": 1234.56, "1.234,56": 1234.56, "1.234": 1234.0, "2.1": 2.1}
    for text, value in numbers.items():
        assert col(spark, text, classify.financial_number) == value
    facts = col(spark, "Revenue increased to $2.1 billion and EBITDA of $450 million", lambda t: classify.kpis(t, F.lit(2023)))
    assert [(k.name, k.value, k.currency, k.period) for k in facts] == [("Revenue", 2.1e9, "USD", "2023"), ("EBITDA", 4.5e8, "USD", "2023")]
    intents = {"revenue financial performance": "Business", "research methodology analysis": "Academic", "legal administrative procedure": "Legal", "hello world": "General"}
    for text, intent in intents.items():
        assert col(spark, text, classify.domain_intent) == intent
    assert col(spark, "x", lambda t: scoring.intelligent_boost(F.lit(0.5), F.lit("Business"), F.lit("Business"), t)) == 0.75
