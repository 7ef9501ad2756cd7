from corpusloom.operators import bm25, search_engine
from corpusloom.plans import queries_ranking
from pyspark.sql import functions as F


def test_what_is_stored_needs_no_exchange(spark, small, monkeypatch):
    plans = []
    real = search_engine.stored
    monkeypatch.setattr(search_engine, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    found = queries_ranking.fielded_search(spark, small)
    # tables of so few bytes are dealt to the cores by number; nothing is dealt by words, ids or pairs
    assert plans and not any("hashpartitioning" in p or "Join" in p for p in plans)
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()


def test_scores_of_lines(spark, monkeypatch):
    monkeypatch.setattr(search_engine, "ENTRIES", 3)
    texts = ["A Title\nab abc ab\n\n the end", "", None, "abab " * 50 + " ab", "  \n ", "outlook ab|ab|ab|ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    terms = ["a", "ab", "end", "zz"]
    lines = search_engine.line_words(F.coalesce("content", F.lit("")))
    rows = search_engine.line_scores(docs.select("doc_id", lines.alias("lines")), terms).collect()
    told = {r.doc_id: r.lines for r in docs.select("doc_id", lines.alias("lines")).collect()}
    for r in rows:
        want = {}
        for line in told[r.doc_id]:
            own = line.words.split()
            for n, t in enumerate(terms):
                if tf := sum(t in w for w in own):
                    want[n] = want.get(n, 0) + line.weight * tf * 2.2 / (tf + bm25.K1 * (0.25 + 0.75 * len(own) / 1000)) * 2
        assert dict(zip(r.at, [round(x, 9) for x in r.fielded], strict=True)) == {n: round(x, 9) for n, x in want.items()}
