from corpusloom.operators import blocks
from pyspark.sql import functions as F


def kinds(text):
    return [(k, c) for k, c, *_ in blocks.layout(text)]


def test_kinds_of_blocks():
    assert kinds("INTRODUCTION TO IT\nplain words go here and on\nand on they go") == [("Header", "INTRODUCTION TO IT"), ("Text", "plain words go here and on and on they go")]
    assert kinds("Name: a value") == [("KeyValue", "Name: a value")] and kinds("paid 12 € on it") == [("Amount", "paid 12 € on it")]
    kind, content = kinds("a | b | c\nx | y | z")[0]
    assert kind == "Table" and content == "📋 **Table Data**\n\n| a | b | c\nx | y | z |\n|---|---|---|---|---|\n"
    kind, content = kinds("- one thing\n- another thing\n- a third")[0]
    assert kind == "List" and content == "📝 **Structured List**\n\n  - one thing\n- another thing\n- a third\n"
    kind, content = kinds("Figure 3: Compression and accuracy\n96.5% 93.8% at 600-700")[0]
    assert kind == "Figure" and "📈 **Performance Data:**\n  • Point 1: 96.5%\n  • Point 2: 93.8%\n" in content and "📏 **Data Ranges:**\n  • 600-700\n" in content


def test_paragraphs():
    assert kinds("some words that are parted by a hy-\nphen here") == [("Text", "some words that are parted by a hyphen here")]
    assert [c for _, c in kinds("first paragraph ends here.\nAnother sentence that is long enough to stand alone")] == [
        "first paragraph ends here.", "Another sentence that is long enough to stand alone",
    ]
    assert [c for _, c in kinds("one\n\ntwo")] == ["one", "two"]
    long = "\n".join(f"line number {n} of words" for n in range(45))
    assert [len(c.split("line")) - 1 for _, c in kinds(long)] == [20, 20, 5]


def test_layout_runs_down_the_page(spark):
    rows = list(blocks.layout("TITLE\n\nwords of a text"))
    (_, _, y0, h0, w0, c0), (_, _, y1, h1, w1, c1) = rows
    assert (y0, h0, w0, c0) == (40.0, 36.0, 580.0, 0.95) and (y1, h1, w1, c1) == (40 + 36 + 40 + 20, 30.0, 560.0, 0.9)
    df = spark.createDataFrame([(1, "TITLE"), (2, None), (3, ""), (4, "\n\n")], "doc_id long, text string")
    assert [(r.doc_id, r.kind, r.x) for r in blocks.document_blocks(df).collect()] == [(1, "Header", 10.0)]


def test_table_spans_against_a_plain_reading():
    assert blocks.table_span(["plain", "", "plain", "plain", "a | b", "c | d"]) == 0  # four lines without columns end the look
    assert blocks.table_span(["a | b", "plain", "c | d"]) == 3 and blocks.table_span(["a | b"]) == 0
    assert blocks.list_span(["1. a", "x", "2. b"]) == 3 and blocks.list_span(["Introduction ... 1", "x"]) == 2
    assert blocks.figure_span(["Figure", "x" * 201, "100%"]) == 0 and blocks.figure_span(["Figure", "100%"]) == 2


def test_type_names(spark):
    df = spark.createDataFrame([("Title",), ("IMAGE",), ("money",), ("what",)], "t string")
    assert [r[0] for r in df.select(blocks.block_type(F.col("t"))).collect()] == ["Header", "Figure", "Amount", "Text"]
