from array import array

from corpusloom.llm.sentencepiece_codec import WordTable, encode_decode, processor


def packed(ids):
    return array("I", ids).tobytes()


def test_equals_the_library(awkward, tokenizer_path):
    path = tokenizer_path("piece_bpe_32k.model")
    model = processor(path)
    rows = encode_decode(awkward, path).collect()
    texts = sorted(repr((r.doc_id, r.text)) for r in awkward.collect())
    assert len(rows) == len(texts) == 11
    expected = {}
    for r in awkward.collect():
        ids = [model.bos_id(), *model.encode(r.text or ""), model.eos_id()]
        expected.setdefault(r.doc_id, []).append((packed(ids), len(ids), model.decode(ids)))
    for r in rows:
        assert (bytes(r.ids), r.n_tokens, r.decoded) in expected[r.doc_id]


def test_null_is_empty_and_empty_table(spark, empty, tokenizer_path):
    path = tokenizer_path("piece_bpe_32k.model")
    assert encode_decode(empty, path).count() == 0
    row = encode_decode(spark.createDataFrame([(1, None)], "doc_id long, text string"), path).first()
    assert (bytes(row.ids), row.n_tokens, row.decoded) == (packed([1, 2]), 2, "")


def test_a_full_table_starts_anew(tokenizer_path):
    path = tokenizer_path("piece_bpe_32k.model")
    table, model = WordTable(path, limit=5), processor(path)
    assert table.splits
    for text in ("one two three four", "five six seven one", "one two one two", "a " * 50):
        assert table.encode(text) == packed([1, *model.encode(text), 2])
        assert len(table.table) <= 5 + len(set(text.split()))
