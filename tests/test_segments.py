from datetime import datetime, timedelta

from corpusloom.operators import chunking, collections, figures, layout, spans
from corpusloom.sources import files, web
from corpusloom.streaming import guards
from pyspark.sql import functions as F


def test_sentence_chunks():
    text = " ".join(f"w{i}a w{i}b w{i}c." for i in range(10))
    chunks = list(chunking.sentence_chunks(text, 8, 2))
    assert chunks[0] == "w0a w0b w0c. w1a w1b w1c" and chunks[1].startswith("w1b w1c. w2a")
    assert not list(chunking.sentence_chunks("  ")) and all(len(c.split()) <= 8 for c in chunks)


def test_paragraph_and_byte_chunks():
    assert list(chunking.paragraph_chunks("a b c d e\n\nf", 2, 1)) == ["a b", "c d", "e", "f"]
    assert list(chunking.paragraph_chunks("a b\n\nc", 2, 1)) == ["a b", "b\n\nc", "c"]
    assert list(chunking.byte_chunks("é" * 10, 384)) == []
    parts = list(chunking.byte_chunks("é" * 30 + "\n\n" + "b" * 50 + "\n\n" + "c" * 50, 100, 5))
    assert parts[0] == "é" * 30 and all(parts)


def test_character_chunks():
    text = "word " * 1000
    pieces = list(chunking.character_chunks(text, 100, 0.12))
    assert all(text[a:b] == p for p, a, b in pieces) and pieces[-1][2] == len(text) and pieces[0][2] == 400
    assert list(chunking.character_chunks("short")) == [("short", 0, 5)]


def test_sections():
    body = "Some sentence of a section. " * 100
    text = f"preamble\nIntroduction\n{body}\n2.1 Method\n{body}"
    found = chunking.sections(text, "academic")
    assert [(t, n) for t, n, _ in found] == [("Introduction", 1), ("Method", 2)]
    assert "preamble" not in "".join(c for _, _, c in found)
    assert [s[0] for s in chunking.sections("Introduction\nx\nMethod\ny", "academic")] == ["Introduction + Method"]
    assert all(chunking.section_chunks(text, "academic"))
    assert chunking.dynamic_overlap(chunking.PROFILES["academic"]) == 64 / 500


def test_pages_and_fallbacks():
    assert chunking.pages("a\fb\f ") == ["a", "b"] and chunking.pages("a\n\n\nb") == ["a", "b"]
    long = ("é" * 99 + "\n") * 200
    assert "".join(chunking.pages(long)) == long and len(chunking.pages(long)) > 5
    assert chunking.with_fallbacks("text", []) == [("text", 0.8)] and chunking.with_fallbacks(" ", []) == [("EXTRACTION FAILED", 0.0)]


def test_captions(spark):
    text = "Figure 1: First\nsome\nTable 1: Rows\nGraphique 2: Trois\nTableau 2: Quatre"
    row = spark.createDataFrame([(text,)], "t string").select(figures.captions(F.col("t")).alias("c")).first()
    assert [(c.figure_id, c.caption) for c in row.c] == [
        ("Figure 1", "Figure 1: First"), ("Graph 2", "Graph 2: Trois"), ("Table 1", "Table 1: Rows"), ("Table 2", "Table 2: Quatre"),
    ]


def test_spans(spark):
    s = spark.createDataFrame([(1, 1, 0, 30), (1, 2, 20, 50), (1, 3, 60, 80), (1, 4, 900, 3000)], "doc_id long, span_id long, char_start int, char_end int")
    r = spark.createDataFrame([(1, 1, 15, 35), (1, 2, 65, 75), (1, 3, 90, 100), (1, 4, 1000, 2900), (1, 5, 9, 9)], "doc_id long, range_id long, lo int, hi int")
    got = [(x.range_id, x.span_id) for x in spans.overlapping(s, r).orderBy("range_id", "span_id").collect()]
    assert got == [(1, 1), (1, 2), (2, 3), (4, 4)]
    p = spark.createDataFrame([(1, 1, 25), (1, 2, 55), (1, 3, 2999)], "doc_id long, pos_id long, pos int")
    assert {(x.pos_id, x.span_id) for x in spans.at_position(s, p).collect()} == {(1, 1), (3, 4)}


def test_regions(spark):
    boxes = [(1, 0, 0.0, 0.0, 50.0, 10.0, "A"), (1, 0, 60.0, 0.0, 50.0, 10.0, "B"), (1, 0, 0.0, 200.0, 50.0, 10.0, "C")]
    df = spark.createDataFrame(boxes, "doc_id long, page int, x double, y double, width double, height double, content string")
    rows = layout.regions(df).orderBy("region").collect()
    assert [(r.content, r.boxes) for r in rows] == [("A B", 2), ("C", 1)]


def test_rate_limit(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(seconds=i), i) for i in range(11)] + [(1, start + timedelta(seconds=61), 11), (2, start, 12)]
    got = {r.id: r.accepted for r in guards.rate_limited(spark.createDataFrame(rows, "client long, ts timestamp, id long")).collect()}
    assert [got[i] for i in range(13)] == [True] * 10 + [False, True, True]


def test_web(spark):
    page = web.extract_page("<html><title>T</title><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script></html>")
    assert page[6] == [{"headers": ["a", "b"], "rows": [["1", "2"]], "row_count": 1, "column_count": 2}] and "x" not in page[1]
    urls = {"https://x.org/p?utm_source=z&id=1&ref=q#top": "https://x.org/p?id=1#top", "https://x.org/#1": "https://x.org/", "http://a/b": "http://a/b"}
    for given, want in urls.items():
        assert spark.createDataFrame([(given,)], "u string").select(web.normalize_url(F.col("u"))).first()[0] == want


def test_captures(spark):
    df = spark.createDataFrame([("u|t|b||7|true|false",), ("too|few",)], "r string").select(files.dom_capture(F.col("r")).alias("c"))
    first, second = [r.c for r in df.collect()]
    assert first.words == 7 and first.frames and first.selection is None and second is None
    tsv = "h\n" + "\t".join(["5", "1", "1", "1", "1", "1", "10", "20", "30", "40", "90", "word"]) + "\n" + "\t".join(["5"] * 10 + ["10", "low"])
    boxes = spark.createDataFrame([(tsv,)], "t string").select(files.ocr_boxes(F.col("t")).alias("b")).first().b
    assert [(b.text, b.confidence, b.x) for b in boxes] == [("word", 0.9, 10)]


def test_collections(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n int")
    assert sorted((r.k, r.v) for r in collections.upsert(old, new, "k", "n").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in collections.insert_absent(old, new, "k").collect())[:2] == [(1, "a"), (2, "b")]


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
