import hashlib
import random
import re

import pytest
from corpusloom.llm import imatch as im

SCHEMA = "doc_id long, text string, next_text string, own string"


def brute(rows):
    """The whole operator in plain Python."""
    docs = sorted(((-(10**19) if i is None else i), t or "") for i, t in rows)
    cut = lambda t: re.split(r"[\x20\x09-\x0D]+", t.lower())
    counts = {}
    for _, t in docs:
        for w in set(cut(t)) - {""}:
            counts[w] = counts.get(w, 0) + 1
    low, high = max(2, -(-len(docs) * 2 // 1000)), max(2, len(docs) * 2 // 100)
    lexicon = {w for w, n in counts.items() if low <= n <= high}

    def signatures(t):
        terms = sorted(set(cut(t)) & lexicon, key=lambda w: w.encode())
        if not terms:
            return ["=" + hashlib.md5(" ".join(cut(t)).encode()).hexdigest()[:8]] * (1 + im.SUBSETS * len(im.RATES))
        value = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in terms}
        out, shift = [terms], 0
        for rate in im.RATES:
            out += [[w for w in terms if (value[w] >> shift) % rate == k] for k in range(im.SUBSETS)]
            shift += rate.bit_length() - 1
        return [hashlib.md5(" ".join(p).encode()).hexdigest()[:8] if p else "-" for p in out]

    found = []
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        found.append((None if i == -(10**19) else i, t, edited, signatures(t), signatures(edited), signatures(following)))
    return found


def as_list(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.edited, list(r.own), list(r.changed), list(r.following)) for r in df.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"wörd{n}" for n in range(600)]
    out = [(i * 7 if i % 3 else i + 10**6, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return out + [(5, None), (6, ""), (7, "Rare once"), (None, "no id"), (None, None), (8, out[0][1]), out[1], (9, "one  two\tthree")]


@pytest.mark.parametrize("sent", [im.SENT_TERMS, 0])
def test_against_brute_force(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(im, "RANGE_ROWS", 10)
    monkeypatch.setattr(im, "CUTS", 4)
    monkeypatch.setattr(im, "SENT_TERMS", sent)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    want = sorted((i is not None, i or 0, *x) for i, *x in brute(rows))
    assert as_list(im.fingerprint_edits(df)) == want


def test_small_tables(spark, empty):
    assert im.fingerprint_edits(empty).count() == 0
    for own in ([(1, "only one here now")], [(None, None)], [(3, "a a b"), (3, "a a b")], [(2, "x" * 9), (1, "yz")]):
        df = spark.createDataFrame(own, "doc_id long, text string")
        assert as_list(im.fingerprint_edits(df)) == sorted((i is not None, i or 0, *x) for i, *x in brute(own))


def test_likeness_tells_edits_from_strangers(spark, small):
    from pyspark.sql import functions as F

    told = im.fingerprint_edits(spark.read.parquet(f"{small}/documents.parquet"))
    near = told.select(F.avg(im.likeness(F.col("own"), F.col("changed"))), F.avg(im.likeness(F.col("own"), F.col("following")))).first()
    assert near[0] > 0.3 and near[1] < 0.1


@pytest.mark.parametrize("few", [im.LITERAL_ROWS, 0])
def test_clustered_ids_make_even_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(im, "LITERAL_ROWS", few)
    monkeypatch.setattr(im, "RANGE_ROWS", 50)
    monkeypatch.setattr(im, "CUTS", 5)
    ids = [*range(1000), *range(10**12, 10**12 + 1000), *[10**17 + 10**14 * k for k in range(30)]]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sizes = [r["count"] for r in im.id_ranges(df).groupBy("_range").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 120 and len(sizes) >= 30
    order = [r.doc_id for r in im.id_ranges(df).orderBy("_range", "doc_id").collect()]
    assert order == sorted(ids)
