from math import comb

import numpy as np
from corpusloom.llm import hypergeometric_shuffle as hs
from corpusloom.llm import queries


def whole(counts, sizes, seed):
    matrix = hs.Matrix(np.concatenate([[0], np.cumsum(counts)]), sizes, seed)
    return np.array([matrix.row(b) for b in range(len(counts))])


def test_matrix_sums():
    rng = np.random.default_rng(0)
    for seed in range(20):
        counts = rng.integers(0, 50, 9)
        sizes = hs.exact_sizes(int(counts.sum()), 7)
        m = whole(counts, sizes, seed)
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
    big = np.array([3 * 10**12, 10**12, 5])
    m = whole(big, hs.exact_sizes(int(big.sum()), 3), 1)
    assert (m.sum(axis=1) == big).all() and (m.sum(axis=0) == hs.exact_sizes(int(big.sum()), 3)).all() and m[:2].min() > 0


def chi_square(seen, chances, n):
    keep = chances * n >= 5
    rest = max(n * (1 - chances[keep].sum()), 1e-9)
    return (((seen[keep] - n * chances[keep]) ** 2) / (n * chances[keep])).sum() + (seen[~keep].sum() - rest) ** 2 / max(rest, 1), keep.sum()


def test_draws_follow_the_distribution():
    """Both ways of drawing one number, and cells of the matrix, against the exact chances."""
    n, good, bad, taken = 20_000, 30, 50, 22
    exact = np.array([comb(good, k) * comb(bad, taken - k) / comb(good + bad, taken) for k in range(taken + 1)])
    for large in (hs.LARGE, 0):
        rng = np.random.default_rng(7)
        seen = np.bincount([hs.hypergeometric(rng, good, bad, taken, large) for _ in range(n)], minlength=taken + 1)
        value, cells = chi_square(seen, exact, n)
        assert value < cells + 5 * (2 * cells) ** 0.5
    counts, sizes, n = np.array([6, 9, 5, 10]), np.array([8, 8, 7, 7]), 4000
    drawn = np.array([whole(counts, sizes, seed) for seed in range(n)])
    for b in range(4):
        for s in range(4):
            exact = np.array([comb(int(sizes[s]), k) * comb(30 - int(sizes[s]), int(counts[b]) - k) / comb(30, int(counts[b])) for k in range(int(counts[b]) + 1)])
            value, cells = chi_square(np.bincount(drawn[:, b, s], minlength=len(exact))[: len(exact)], exact, n)
            assert value < cells + 6 * (2 * cells) ** 0.5, (b, s)


def test_large_populations_have_the_right_moments():
    rng, good, bad, taken = np.random.default_rng(3), 4 * 10**11, 6 * 10**11, 10**9
    x = np.array([hs.hypergeometric(rng, good, bad, taken) for _ in range(4000)], dtype=float)
    mean, deviation = taken * 0.4, (taken * 0.24 * (1 - taken / (good + bad))) ** 0.5
    assert abs(x.mean() - mean) < 5 * deviation / 4000**0.5 and 0.95 < x.std() / deviation < 1.05


def test_each_order_is_as_likely(spark):
    """A shard's slots hold each row equally often over many seeds."""
    df = spark.range(6).selectExpr("id doc_id")
    seen = np.zeros((6, 6), dtype=int)
    for seed in range(60):
        for r in hs.shuffle_into_shards(df, 2, seed=seed).collect():
            seen[r.doc_id, r.shard * 3 + r.slot] += 1
    assert seen.sum() == 360 and ((seen - 10) ** 2 / 10).sum() < 25 + 5 * 50**0.5


def test_shards(spark, awkward, empty):
    out = hs.shuffle_into_shards(awkward, 4, seed=1)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "source", "ids", "shard", "slot"] and len(rows) == 11
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = hs.shuffle_into_shards(awkward.repartition(5), 4, seed=1).collect()
    key = lambda r: (r.doc_id or -1, r.text or "", r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert hs.shuffle_into_shards(empty, 4).count() == 0


def test_names_of_helpers_are_carried(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)], "h long, _H long, block long, rank long, part long, Shard long, SLOT long")
    out = hs.shuffle_into_shards(df, 2)
    assert out.columns == ["h", "_H", "block", "rank", "part", "shard", "slot"] and out.first()[:5] == (1, 2, 3, 4, 5)


def test_many_rows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(hs, "PART_ROWS", 100)
    monkeypatch.setattr(hs, "BLOCK_ROWS", 300)
    monkeypatch.setattr(hs, "EQUAL_ROWS", 500)
    df = spark.range(5003).selectExpr("if(id % 3 = 0, -1, id) doc_id", "if(id % 3 = 0, 'same', string(id)) text")
    rows = hs.shuffle_into_shards(df, 4, seed=3).collect()
    assert sorted(r.doc_id for r in rows) == sorted(-1 if i % 3 == 0 else i for i in range(5003))
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (1250, 1251)
        same = [r.slot for r in rows if r.shard == s and r.doc_id == -1]
        assert 340 < len(same) < 500 and 520 < np.mean(same) < 730  # equal rows are spread over shards and slots
    at = np.array([(r.doc_id, r.slot) for r in rows if r.shard == 0 and r.doc_id >= 0])
    assert abs(np.corrcoef(at.T)[0, 1]) < 0.15


def test_query(spark, small):
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op6_sharding(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode()), "rows", None) for r in rows)
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(queries.SHARDS)}
    assert all(v == list(range(len(v))) for v in by.values()) and len({len(v) for v in by.values()}) <= 2
