from corpusloom.operators import answers, layout, sessions
from corpusloom.plans import ingest, queries_ranking, retrieval
from pyspark.sql import functions as F


def test_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "First sentence. Second one! " * 300, "en"), (2, "", "en"), (3, None, "fr"), (4, "kurz", "de")], "doc_id long, text string, lang string")
    rows = ingest.ingest(docs).collect()
    assert {r.doc_id for r in rows} == {1, 4} and len({r.chunk_id for r in rows}) == len(rows)
    assert all(len(r.content.split()) <= 400 and len(r.embedding) == 64 for r in rows)
    ingest.write_collection(ingest.ingest(docs), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("group_id = 'default'").count() == len(rows)
    assert {r.doc_id: r.chunks for r in ingest.document_metadata(ingest.ingest(docs)).collect()}[4] == 1


def test_vector_search_filters_after_the_top(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.doc_id for r in retrieval.vector_search(asked, points, k=2).orderBy("rank").collect()] == [1, 2]
    assert [r.doc_id for r in retrieval.vector_search(asked, points, k=2, min_score=0.9).collect()] == [1]


def test_context_and_answers(spark):
    rows = [(1, "comment ça marche", 1, 0.9, "A long enough sentence that explains it. Short.", "doc", None, 1.0), (1, "comment ça marche", 2, 0.2, "x" * 600, "doc", 3, 0.5)]
    ranked = spark.createDataFrame(rows, "query_id long, query string, rank int, score double, content string, label string, page int, confidence double")
    context = retrieval.answer_context(ranked).first()
    assert context.sources == 2 and context.context.startswith("### Source 1 - doc (Page ?, Confidence: 90%)") and context.context.endswith("x" * 500 + "...")
    answer = answers.extractive_answer(ranked).first()
    footer = "\n*Réponse générée à partir de 1 sections du document (confiance: haute)*"
    assert answer.form == "explanation" and answer.sources == 1
    assert answer.answer == answers.HEADINGS["explanation"] + "A long enough sentence that explains it. Short.\n\n" + footer
    weak = answers.extractive_answer(ranked.withColumn("score", F.lit(0.1))).first()
    assert weak.answer == answers.TOO_WEAK and weak.sources == 0
    known = answers.knowledge_context(ranked.withColumns({"source_file": F.lit(None).cast("string"), "category": F.lit("Mixed")}), "Réponds.").first()
    assert "### [Source 1] Score: 90.00%\nCatégorie: Mixed\n" in known.context and known.context.endswith("---\n\nRéponds.") and len(known.previews[1]) == 303
    assert abs(retrieval.response_confidence(ranked).first().confidence - (0.9 + 0.1) / 1.1) < 1e-9


def test_sessions(spark):
    docs = spark.createDataFrame([(1, "Eins. Zwei.", "de"), (2, " ", "de")], "doc_id long, text string, lang string")
    opened = sessions.open_sessions(ingest.ingest(docs), F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit(1.0))
    row = opened.first()
    assert opened.count() == 1 and (row.doc_id, row.chunks, row.embedded, row.confidence) == (1, 1, 1, 1.0)
    now = F.lit("2024-01-01 10:30:00").cast("timestamp")
    assert sessions.list_sessions(opened, now).first().age_s == 1800
    assert sessions.get_sessions(opened, opened.select("session_id"), now).count() == 1
    assert sessions.get_sessions(opened, opened.select("session_id"), F.lit("2024-01-01 11:30:01").cast("timestamp")).count() == 0
    assert sessions.close_sessions(opened, opened.select("session_id")).count() == 0


def test_approximate_search_finds_nine_in_ten(spark, small):
    found = queries_ranking.approximate_search(spark, small).collect()
    assert len(found) == 25 and sum(r.recall for r in found) / len(found) >= 0.9


def test_approximate_hits_are_exact_scores(spark, small):
    """Each hit has its exact cosine, fifty vectors a query are compared, and nine in ten of the true hits are found."""
    import numpy as np

    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    hits = queries_ranking.approximate_hits(spark, small).collect()
    assert all(abs(h.score - float(unit[h.query_id] @ unit[h.doc_id])) < 2e-6 for h in hits)
    true = {q: sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:10] for q in unit if q % 20 == 0}
    found = sum(h.doc_id in true[h.query_id] for h in hits)
    assert len(hits) == 10 * len(true) and found >= 0.9 * len(hits)


def test_codes_of_odd_vectors(spark):
    from corpusloom.operators import ann

    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [3.0, 3.0]), (None, [1.0, 1.0])], "doc_id long, embedding array<double>")
    fit = points.where("size(embedding) = 2")
    book = ann.fit_codebook(fit, parts=1)
    asked = spark.createDataFrame([(1, [2.0, 2.0]), (2, None), (3, [1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.doc_id) for r in ann.approximate_search(asked, points, ann.encode(points, book), book, k=1).collect()] == [(1, 5)]
    nothing = ann.fit_codebook(points.limit(0))
    assert ann.encode(points, nothing).count() == 0


def test_numeric_queries_put_matches_first(spark):
    docs = spark.createDataFrame([(1, "accuracy of 97% on tests"), (2, "accuracy accuracy accuracy accuracy 80%"), (3, "nothing")], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "accuracy > 95%")], "query_id long, query string")
    rows = retrieval.hybrid_search(asked, docs, k=3).orderBy("rank").collect()
    assert rows[0].doc_id == 1 and rows[0].has_match and rows[0].query_kind == "DigitCombined" and not rows[1].has_match


def test_vectors_meet_in_bounded_matrices(spark, monkeypatch):
    """A task holds no more scores at once than ``CELLS``, and copies of a vector rank by id."""
    import numpy as np
    from corpusloom.functions import vectors

    sizes, real = [], np.zeros
    rng = np.random.default_rng(1)
    x = [(n, rng.integers(-1, 2, 3).astype(float).tolist()) for n in range(150)] + [(150, [0.0, 0.0, 0.0]), (151, None), (152, [1.0])]
    points = spark.createDataFrame(x[::-1], "doc_id long, embedding array<double>").coalesce(1)
    asked = points.withColumnRenamed("doc_id", "query_id")
    whole = {(r.query_id, r.doc_id): r.score for r in vectors.similar_pairs(asked, points).collect()}
    monkeypatch.setattr(vectors, "CELLS", 700)
    ids = sorted({d for _, d in whole})
    found = retrieval.vector_search(asked, points, k=7).collect()
    for q in ids:
        want = sorted(ids, key=lambda d: (-round(whole[q, d], 9), d))[:7]
        assert [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want

    # the function itself, as a task runs it
    def zeros(shape, *args, **kw):
        sizes.append(int(np.prod(shape)))
        return real(shape, *args, **kw)

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    run = vectors._similar_to(asked.collect(), Frame(), 7)
    monkeypatch.setattr(np, "zeros", zeros)
    batches = points.toArrow().to_batches()
    out = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert max(sizes) <= 700 and {r["query_id"] for r in out} == set(ids)


def test_sessions_do_not_classify(spark, small):
    """Sessions take no category, so none is computed for them, and they are the same without."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).cache()
    at = F.lit("2024-01-01").cast("timestamp")
    without, with_ = (sorted(map(tuple, sessions.open_sessions(ingest.ingest(docs, classified=c), at, F.lit(0.8)).collect())) for c in (False, True))
    assert without == with_ and without


def test_pages_of_boxes_in_small_batches(spark):
    """Pages lie in batches with others and go on in the next; no page is a call of its own, and no name or page need be there."""
    rows = [(d, p, float(60 * (i % 3)), float(200 * (i // 6) + 20 * (i // 3 % 2)), 50.0, 12.0, None if i == 4 else f"w{i}") for d in (1, 2, None) for p in (0, 1, None) for i in range(12)]
    boxes = spark.createDataFrame(rows, "doc_id long, page int, x double, y double, width double, height double, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = layout.regions(boxes)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = ("w0 w1 w2 w3  w5", "w6 w7 w8 w9 w10 w11")
    assert got == {(d, p, n, t, 6, 3, 0.0, 200.0 * n, 170.0, 32.0) for d in (1, 2, None) for p in (0, 1, None) for n, t in enumerate(texts)}


def test_only_hits_are_classified(spark):
    """The filter on categories is not moved to the table of all texts."""
    from corpusloom.plans import retrieval

    texts = spark.createDataFrame([(n, "revenue and profit of the fiscal year" if n % 2 else "words") for n in range(40)], "doc_id long, content string")
    hits = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.4)], "query_id long, doc_id long, score double").withColumns({"document_id": F.lit("x"), "confidence": F.lit(None).cast("double")})
    found = retrieval.hit_metadata(hits.join(texts, "doc_id"), categories=["Business", "Academic", "Legal", "Technical", "Mixed"])
    assert sorted((r.doc_id, r.confidence) for r in found.collect()) == [(3, 0.85), (4, 0.85)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
