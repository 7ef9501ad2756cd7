import json
import random

import numpy as np
from corpusloom.llm import mixture_pack as mp
from corpusloom.llm import queries
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


def test_ids_equal_the_library(tokenizer_path):
    path = tokenizer_path("byte_bpe_50k.json")
    own, library = mp.DocumentIds(path), Tokenizer.from_file(path)
    assert own.fast is not None
    assert own.encode("<|endoftext|>") == np.array([50256], dtype=own.kind).tobytes()
    rng = random.Random(0)
    alphabet = "ab Z'st \n\t\r 09.é漢🙂 ​\x1c\x85<|>_"
    texts = ["", " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "it's we'll", "x" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.encode(t), dtype=own.kind).tolist() == library.encode(t, add_special_tokens=False).ids, json.dumps(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 40))
def test_deal(quotas, size):
    total = sum(quotas)
    sizes = np.diff([*range(0, total, size), total])
    out = mp.deal(np.array(quotas), sizes)
    assert (out[-1] == quotas).all() and (np.diff(out, axis=0) >= 0).all()
    assert (out.sum(axis=1) == np.concatenate([[0], np.cumsum(sizes)])).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6).filter(sum))
def test_serve(quotas):
    sizes = np.diff([*range(0, sum(quotas), 500), sum(quotas)]).tolist()
    pieces = mp.serve(quotas, sizes, 64)
    taken = np.zeros((len(sizes), 500), dtype=int)
    for q, own in zip(quotas, pieces, strict=True):
        at = 0
        for start, window, offset, length in own:
            assert start == at and length > 0
            taken[window, offset : offset + length] += 1
            at += length
        assert at == q
    assert all((taken[w, :n] == 1).all() and (taken[w, n:] == 0).all() for w, n in enumerate(sizes))


def test_a_deep_tree_places_each_token_once():
    totals = [1200, 1, 0, 333, 777]
    deals = mp.Mixture(totals, window=16, fan=3, least=4)
    assert deals.depth > 3
    seen, counts = set(), np.zeros((deals.windows, len(totals)), dtype=int)
    for queue, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(37, total - at)
            for window, offset, length in mp.Mixture(totals, window=16, fan=3, least=4).pieces(queue, at, n):
                new = {(window, o) for o in range(offset, offset + length)}
                assert not new & seen
                seen |= new
                counts[window, queue] += length
            at += n
    assert len(seen) == sum(totals)
    # deficits stay small: after any number of windows each queue has had its share
    drift = np.abs(np.cumsum(counts, axis=0) - np.outer(np.minimum(np.arange(1, deals.windows + 1) * 16, sum(totals)), np.array(totals) / sum(totals)))
    assert drift.max() < 40


def test_pack(awkward, empty, tokenizer_path, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = mp.pack(awkward, path, window=512).collect()
    library = Tokenizer.from_file(path)
    want = {}
    for r in awkward.collect():
        want.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [1])
    ids = {}
    for r in sorted(rows, key=lambda r: r.start):
        part = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(part) == r.length
        ids.setdefault((r.doc_id, r.doc_tokens), []).extend(part)
    for (doc, n), got in ids.items():
        same = [w for w in want[doc] if len(w) == n]
        assert sorted(got) == sorted(t for w in same for t in w)
    assert sum(map(len, ids.values())) == sum(len(w) for ws in want.values() for w in ws)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for k in sorted(windows):
        at = 0
        for offset, length in sorted(windows[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(windows) == list(range(len(windows))) and set(sizes[:-1]) <= {512} and 0 < sizes[-1] <= 512
    assert mp.pack(empty, path).count() == 0


def test_more_sources_than_queues(spark, tokenizer_path, monkeypatch):
    monkeypatch.setattr(mp, "MOST_QUEUES", 3)
    df = spark.createDataFrame([(i, "word " * (i + 1), f"s{i % 7}") for i in range(50)], "doc_id long, text string, source string")
    rows = mp.pack(df, tokenizer_path("byte_bpe_50k.json"), window=64).collect()
    assert {r.doc_id for r in rows} == set(range(50))
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def drift(counts, window):
    """How far any source is from its share after any number of windows, in tokens."""
    done = np.cumsum(counts, axis=0)
    return np.abs(done - np.outer(np.minimum(np.arange(1, len(counts) + 1) * window, counts.sum()), counts.sum(axis=0) / counts.sum())).max()


def test_sources_beyond_the_queues_keep_their_shares(spark, tokenizer_path, monkeypatch):
    monkeypatch.setattr(mp, "MOST_QUEUES", 3)
    df = spark.createDataFrame([(i, "word " * 60, f"s{i // 100}") for i in range(1200)], "doc_id long, text string, source string")
    rows = mp.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    counts = np.zeros((1 + max(r.sequence_id for r in rows), 12), dtype=int)
    for r in rows:
        counts[r.sequence_id, r.doc_id // 100] += r.length
    assert (counts.sum(axis=1)[:-1] == 2048).all() and drift(counts, 2048) < 2048


def test_many_sources_place_each_token_once():
    rng = np.random.default_rng(1)
    totals = np.sort(rng.integers(0, 3000, 150))[::-1].copy()
    deals, seen = mp.Sources(totals, 512, 4), np.zeros(int(totals.sum()), dtype=int)
    counts = np.zeros((deals.mixture.windows, len(totals)), dtype=int)
    for source, total in enumerate(totals.tolist()):
        for at in range(0, total, 100):
            pieces = list(deals.pieces(source, at, min(100, total - at)))
            assert sum(n for _, _, n in pieces) == min(100, total - at)
            for window, offset, n in pieces:
                seen[window * 512 + offset : window * 512 + offset + n] += 1
                counts[window, source] += n
    assert (seen == 1).all() and drift(counts, 512) < 2048


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.sampled_from([0.0, 0.1, 0.25, 0.5, 1.0])), min_size=1, max_size=6))
def test_phases(queues):
    totals, weights = (np.array(x) for x in zip(*queues, strict=True))
    out = mp.phases(totals, weights.astype(float), 100)
    assert (np.sum(out, axis=0) == totals).all() if out else not totals.any()
    assert all((g >= 0).all() and g.sum() % 100 == 0 for g in out[:-1]) and len(out) <= 3 * len(totals) + 2


def test_target_shares():
    totals, shares = np.array([4000, 20000, 9000, 7000, 300]), [0.5, 0.2]
    deals, seen = mp.Targets(totals, shares, 512), np.zeros(int(totals.sum()), dtype=int)
    counts = np.zeros((-(-int(totals.sum()) // 512), 5), dtype=int)
    for source, total in enumerate(totals.tolist()):
        for at in range(0, total, 100):
            for window, offset, n in deals.pieces(source, at, min(100, total - at)):
                seen[window * 512 + offset : window * 512 + offset + n] += 1
                counts[window, source] += n
    assert (seen == 1).all()
    # until the first source runs dry each window has its targets: a half, a fifth, and the others by their sizes
    first = np.cumsum(counts, axis=0)[14] / (15 * 512)
    assert np.abs(first - [0.5, 0.2, 0.3 * 9000 / 16300, 0.3 * 7000 / 16300, 0.3 * 300 / 16300]).max() < 0.04
    # afterwards the second source and the others go on at two to three
    second = (np.cumsum(counts, axis=0)[40] - np.cumsum(counts, axis=0)[16]) / (24 * 512)
    assert abs(second[0]) < 0.01 and abs(second[1] - 0.4) < 0.04


def test_pack_with_shares(spark, tokenizer_path):
    df = spark.createDataFrame([(i, "word " * 60, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    rows = mp.pack(df, tokenizer_path("byte_bpe_50k.json"), 512, {"s1": 0.6, "absent": 0.1}).collect()
    counts = np.zeros((1 + max(r.sequence_id for r in rows), 3), dtype=int)
    for r in rows:
        counts[r.sequence_id, r.doc_id % 3] += r.length
    assert (counts.sum(axis=1)[:-1] == 512).all() and counts.sum() == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert abs(counts[:30, 1].sum() / counts[:30].sum() - 0.6) < 0.03


def test_query(spark, small, tokenizer_path):
    """Every column of the registered query against the unaltered library."""
    import zlib

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op7_packing(spark, small).collect()
    held, windows = {}, {}
    for r in rows:
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, total in [(v, len(want[k])) for k, v in held.items()] + [(v, None) for v in windows.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert total in (None, at) and (total or at <= 2048)
    assert set(held) == set(want) and sorted(windows) == list(range(len(windows)))
