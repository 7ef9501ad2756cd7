"""The index on Arrow batches, its upkeep by segments, and top lists, against plain Python."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from corpusloom.operators import bm25, pair_blocks, segments, term_batches
from pyspark.sql import functions as F

WORDS = ["a", "b", "ab", "a_b", "b_a", "c", "a_", "abc", "aa_b"]


def test_counts_and_insides():
    rng = random.Random(1)
    for _ in range(200):
        terms = sorted(set(rng.sample([*WORDS, "a_a", "b_c", "a_b_a", "ab_c", "a_a_b"], rng.randint(0, 8))))
        rows = [[rng.choice(WORDS) for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 6))]
        got = term_batches.TermTable(terms).counts(pa.array([["zz"], *rows], pa.list_(pa.string()))[1:])
        want = []
        for i, r in enumerate(rows):
            single, pairs = Counter(r), Counter(f"{x}_{y}" for x, y in zip(r, r[1:], strict=False))
            want += [(i, n, single[x] + pairs[x], single[x]) for n, x in enumerate(terms) if single[x] + pairs[x]]
        assert sorted(zip(*[x.tolist() for x in got], strict=True)) == want
        texts = ["\t ".join(r) for r in rows]
        got = term_batches.Inside(terms).of_texts(pa.array([None, *texts]))
        assert sorted(zip(*[x.tolist() for x in got], strict=True)) == [(i + 1, n) for i, x in enumerate(texts) for n, y in enumerate(terms) if y in x]


def brute_bm25(docs, queries):
    """Scores of all pairs that share a word or a pair."""
    def tokens(text):
        words = (text or "").lower().split()
        return words + [f"{x}_{y}" for x, y in zip(words, words[1:], strict=False)]

    held = {d: Counter(tokens(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in held.values()) / max(len(held), 1)
    df = Counter(t for c in held.values() for t in c)
    out = {}
    for q, text in queries:
        for d, c in held.items():
            parts = [
                n * math.log((len(held) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                for t, n in Counter(tokens(text)).items() if t in c
            ]
            if parts:
                out[q, d] = pytest.approx(sum(parts))
    return out


def scores(df):
    return {(r.query_id, r.doc_id): r.sparse for r in df.collect()}


def sample(rng, n):
    return [(i, " ".join(rng.choice(["red", "green", "blue", "fish", "bird", "sea", "sky"]) for _ in range(rng.randint(0, 9)))) for i in range(n)]


QUERIES = [(1, "red fish sea"), (2, "sky sky bird"), (3, "none"), (4, None)]


def test_scores_with_sent_and_joined_terms(spark, monkeypatch):
    docs = [*sample(random.Random(2), 60), (60, None)]
    table = spark.createDataFrame(docs, "doc_id long, content string").repartition(3)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    terms = bm25.query_terms(asked)
    want = brute_bm25(docs, QUERIES)
    for most in (1_000_000, 2):
        monkeypatch.setattr(bm25, "SENT_TERMS", most)
        index = bm25.build_index(table, terms)
        assert (index.held is None) == (most == 2) and scores(bm25.bm25(terms, index)) == want
    monkeypatch.setattr(pair_blocks, "CELLS", 8)
    monkeypatch.setattr(bm25, "SENT_TERMS", 1000)
    assert scores(bm25.bm25(terms, bm25.build_index(table, terms))) == want
    nothing = bm25.build_index(table.limit(0), terms)
    assert nothing.rows == 0 and scores(bm25.bm25(terms, nothing)) == {}


def test_segments_equal_a_rebuild(spark):
    """Upserts, deletes and merges at random: scores, frequencies and lengths are those of an index of the texts that are left."""
    rng = random.Random(4)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    terms = bm25.query_terms(asked)
    index, held = segments.SegmentedIndex.empty(spark), {}
    assert scores(bm25.bm25(terms, index.index(terms))) == {}
    for turn in range(7):
        if turn in (2, 5):
            gone = rng.sample(range(30), 8)
            index = index.delete(spark.createDataFrame([(g,) for g in [*gone, 999]], "doc_id long"))
            held = {d: t for d, t in held.items() if d not in gone}
        else:
            new = dict(rng.sample(sample(rng, 30), 6 if turn else 20))
            rows = [*new.items(), next(iter(new.items())), (None, "red fish")]
            index = index.upsert(spark.createDataFrame(rows, "doc_id long, content string"))
            held |= new
        if turn in (3, 6):
            plain = bm25.build_index(spark.createDataFrame(list(held.items()), "doc_id long, content string"))
            assert {r.term: (r.df, r.du) for r in index.frequencies().collect()} == {r.term: (r.df, r.du) for r in plain.frequencies.collect()}
            assert (index.rows, round(index.length / index.rows, 9)) == (plain.rows, round(plain.mean_length, 9))
            assert scores(bm25.bm25(terms, index.index(terms))) == brute_bm25(list(held.items()), QUERIES)
    small = index.merged(2)
    assert len(small.segments) <= len(index.segments) <= 3 and scores(bm25.bm25(terms, small.index(terms))) == brute_bm25(list(held.items()), QUERIES)
    # what is searched lies in the index's own folder
    assert all(f.startswith(f"file:{index.folder}".replace("file:file:", "file:")) or index.folder in f for f in small.index(terms).postings.inputFiles())
    assert small.upsert(spark.createDataFrame([], "doc_id long, content string")) == small


def test_bounded_lists_and_what_they_read(spark):
    from corpusloom.operators import block_max, scoring

    rng = random.Random(12)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join([rng.choice(common) for _ in range(rng.randint(1, 20))] + [rng.choice(rare) for _ in range(rng.randint(0, 6))])) for i in range(1500)]
    docs += [(i + 2000, docs[i][1]) for i in range(0, 200, 7)]
    asked = [(n, " ".join([rng.choice(rare), rng.choice(rare), rng.choice(common)])) for n in range(12)] + [(12, "w1 w1 w2"), (13, "unknown")]
    table, queries = spark.createDataFrame(docs, "doc_id long, content string"), spark.createDataFrame(asked, "query_id long, query string")
    terms = bm25.query_terms(queries)
    index = bm25.build_index(table, terms)
    want = scoring.top_k(bm25.bm25(terms, index).withColumnRenamed("sparse", "score"), 10)
    found, share = block_max.top_k(terms, block_max.build(index, 16))
    key = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(found) == key(want) and len(key(want)) >= 120
    read = share.agg(F.sum("read"), F.sum("postings")).first()
    assert 0 < read[0] < 0.6 * read[1]


def test_scores_of_segments_are_sums_within_rows(spark):
    """The index of segments has a row for each document, as that of texts has, so no pair of a term and a query is exchanged."""
    rng = random.Random(21)
    docs = [*sample(rng, 60), (60, None), (61, "a_b red fish a b"), (62, "...")]
    index = segments.SegmentedIndex.empty(spark).upsert(spark.createDataFrame([(i, "old red") for i in range(0, 60, 3)] + [(99, "sky")], "doc_id long, content string"))
    index = index.upsert(spark.createDataFrame(docs, "doc_id long, content string")).delete(spark.createDataFrame([(99,)], "doc_id long"))
    queries = [*QUERIES, (5, "a b"), (6, "a_b")]
    terms = bm25.query_terms(spark.createDataFrame(queries, "query_id long, query string"))
    held = index.index(terms)
    assert held.held is not None and 0 < held.held.count() <= len(docs)
    bare = [(i, t if t != "..." else "") for i, t in docs]
    assert scores(bm25.bm25(terms, held)) == brute_bm25(bare, queries)


def test_best_pairs_hold_the_lists(spark):
    """Each task tells no more than its best, and the lists are those of all pairs, with many ties, a null id and a null text."""
    from corpusloom.operators import scoring

    rng = random.Random(4)
    docs = [*sample(rng, 400), (None, "red fish"), (900, None)]
    table = spark.createDataFrame(docs, "doc_id long, content string").repartition(3)
    terms = bm25.query_terms(spark.createDataFrame(QUERIES, "query_id long, query string"))
    index = bm25.build_index(table, terms)
    pairs = bm25.best_pairs(terms, index, 5)
    key = lambda df: sorted((r.query_id, r.rank, r.doc_id or -1, round(r.score, 9)) for r in df.collect())
    want = key(scoring.top_k(bm25.bm25(terms, index).withColumnRenamed("sparse", "score"), 5))
    assert key(scoring.top_k(pairs, 5)) == want and len(want) == 10
    assert pairs.count() <= 10 * index.held.rdd.getNumPartitions() < bm25.bm25(terms, index).count()


def test_bounded_lists_write_no_pairs(spark, monkeypatch):
    """What is stored has a row a document at most, and no row for a query and a range; a null id and copies take their places, and joins give the same."""
    from corpusloom.operators import block_max, scoring

    written, plain = [], block_max.stored
    monkeypatch.setattr(block_max, "stored", lambda df, name: (out := plain(df, name), written.append(out.count()))[0])
    rng = random.Random(8)
    docs = [*sample(rng, 300), (None, "red fish"), (900, None), (901, "red fish sea"), (902, "red fish sea")]
    terms = bm25.query_terms(spark.createDataFrame(QUERIES, "query_id long, query string"))
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id long, content string"), terms)
    key = lambda df: sorted((r.query_id, r.rank, r.doc_id or -1, round(r.score, 9)) for r in df.collect())
    want = key(scoring.top_k(bm25.bm25(terms, index).withColumnRenamed("sparse", "score"), 7))
    blocks = block_max.build(index, 4)
    found, share = block_max.top_k(terms, blocks, 7)
    assert key(found) == want and len(want) == 14 and sum(written) <= len(docs)
    joined, all_ = block_max._joined_top_k(terms.where("query_id = 1"), blocks, 7)
    told = {r.query_id: r.postings for r in share.collect()}
    assert [x for x in key(joined) if x[2] >= 0] == [x for x in want if x[0] == 1 and x[2] >= 0] and sorted(told) == [1, 2]
