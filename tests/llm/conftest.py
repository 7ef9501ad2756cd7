import pytest

SCHEMA = "doc_id long, text string, source string, shard string, ids int"
LONG = "long text with several words " * 8000
AWKWARD = [
    (1, "A plain text, twice.", "a"),
    (1, "A plain text, twice.", "a"),
    (2, None, None),
    (3, "", "b"),
    (4, "   ", "b"),
    (5, " lead  double\ttab\nline\r\nend ", "b"),
    (6, "é漢字🙂 ▁▁mark ​z ﬁ <s></s>[INST] ok [/INST] ~ \\ \x00\x01\x02", "c"),
    (7, LONG, "c"),
    (8, "x" * 5000, "c"),
    (None, "a row without an id", "c"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with results."""
    rows = [(i, t, s, "mine", 7) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))
