import random

import numpy as np
import pytest
import xxhash
from corpusloom.llm import common
from corpusloom.llm import simhash_blocks as sb


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def brute_components(values, distance):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints(awkward, spark):
    got = {(r.doc_id, r.fp) for r in sb.fingerprints(awkward).collect()}
    assert got == {(r.doc_id, brute_fingerprint(r.text)) for r in awkward.collect()}
    # Spark's own hash of a text is the same function
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def flipped(rng, v, n):
    for b in rng.sample(range(64), n):
        v ^= 1 << b
    return v


def values(seed, n, bits):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v = rng.getrandbits(64)
        out.append(v)
        for _ in range(3):
            v = flipped(rng, v, rng.randint(1, bits))
            out.append(v)
    return sorted({v - (1 << 64) if v >> 63 else v for v in out})


def linked(spark, vs, **kw):
    links = sb.pigeonhole_links(spark.createDataFrame([(v,) for v in vs], "fp long"), **kw)
    found = {r.node: r.root for r in common.connected_components(links).collect()}
    return {v: found.get(v, v) for v in vs}


def test_links_against_brute_force(spark):
    vs = values(1, 30, 5) + [v << 40 for v in range(1, 60, 2)]
    want = brute_components(vs, 3)
    for kw in ({}, {"blocks": 4}, {"hot_group": 6}):
        got = linked(spark, vs, **kw)
        assert {tuple(sorted(v for v in vs if got[v] == r)) for r in set(got.values())} == {tuple(sorted(v for v in vs if want[v] == r)) for r in set(want.values())}


def test_large_groups_are_split(monkeypatch):
    monkeypatch.setattr(sb, "DIRECT", 4)
    vs = np.array([v % 2**64 for v in values(2, 40, 4)], dtype=np.uint64)
    parent = {int(v): int(v) for v in vs}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in sb.group_links(np.unique(vs), 3, list(range(64))):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[find(x)] = find(y)
    want = brute_components([int(v) for v in vs], 3)
    groups = lambda m: {frozenset(v for v in m if m[v] == r) for r in set(m.values())}
    assert groups({v: find(v) for v in parent}) == groups(want)


def test_near_duplicates(spark, awkward, empty):
    rows = sb.near_duplicates(awkward).collect()
    assert len(rows) == 11
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[1] == 1 and of[2] == of[3] == of[4] == 2  # no words: fingerprint zero
    assert {r.component_id for r in rows if r.doc_id is None} == {2, None}
    assert sb.near_duplicates(empty).count() == 0


def test_keep_one(spark, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows, doc = [], 0
    for words in base:
        for copy in range(3):
            own = list(words)
            for at in rng.sample(range(200), copy):  # up to two words changed: similarity over 0.9
                own[at] = word()
            rows.append((doc, " ".join(own), "s"))
            doc += 1
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, rows[0][1], "s"), (0, rows[0][1], "s"), (None, rows[3][1], "s"), (None, "alone", "s")]
    kept = sb.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(0, 90, 3), 1000]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["alone"]
    assert sb.keep_one(empty).count() == 0


def test_repeated_lines_do_not_decide(spark):
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, base = some(12), some(400)
    # two unrelated documents with the same repeated line, and two near copies of which one repeats a line of its own
    texts = [some(100) + line * 30, some(100) + line * 30, base + line, base + line * 60]
    kept = sb.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


def test_pairs_at_the_border(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, want = [], []
    for k in range(240):
        # 300 shingles each, of which 267 or 266 are common: similarity 0.802 or 0.796
        near, words = k % 2 == 0, [word() for _ in range(304)]
        n = 33 if near else 34
        for copy in (words, words[: 304 - n] + [word() for _ in range(n)]):
            texts.append((len(texts), " ".join(copy)))
        want += [2 * k] if near else [2 * k, 2 * k + 1]
    # the fewest shingles that can be as near: four and five
    for k in range(60):
        words = [word() for _ in range(9)]
        want.append(len(texts))
        texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join(words[:8]))]
    kept = sb.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_exact_groups_against_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.zeros(0, dtype=np.uint64), np.array([7], dtype=np.uint64), np.arange(1, 5, dtype=np.uint64), np.arange(1, 6, dtype=np.uint64)]
    for _ in range(12):
        base = rng.choice(400, 40, replace=False)
        sets += [np.unique(np.concatenate([base[: 40 - n], rng.choice(400, n)])).astype(np.uint64) for n in rng.integers(0, 8, 6)]
    label, want = sb.exact_groups(sets), np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if either and 5 * both >= 4 * either:
                want[want == want[j]] = want[i]
    groups = lambda m: {frozenset(np.flatnonzero(m == r).tolist()) for r in set(m.tolist())}
    assert groups(label) == groups(want) and 12 < len(groups(want)) < len(sets)


def test_wide_labels_in_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    x = np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(1 << 20)])
    whole = sb._near_labels(x, 6)
    monkeypatch.setattr(sb, "DIRECT", 16)
    assert (sb._near_labels(x, 6) == whole).all() and len(set(whole.tolist())) == 40


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_kept(texts):
    """The smallest number of each component of texts by the exact similarity of their five-word shingle sets."""
    sets = [set(sb.shingle_hashes(t, 5).tolist()) for t in texts]
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    return sorted(set(low))


def test_crowded_groups_against_brute_force(spark, monkeypatch):
    """Large groups of near copies, copies that drift apart, and unrelated texts around one passage, with small limits."""
    monkeypatch.setattr(sb, "GROUP", 6)
    monkeypatch.setattr(sb, "CHUNK", 5)
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, passage, texts = some(150), some(120), []
    for _ in range(40):
        own = list(base)
        own[rng.randrange(150)] = some(1)[0]
        texts.append(" ".join(own))
    drifting = some(150)
    for _ in range(40):
        drifting = drifting[3:] + some(3)
        texts.append(" ".join(drifting))
    texts += [" ".join(some(12) + passage + some(12)) for _ in range(30)] + [" ".join(some(60) + passage) for _ in range(30)]
    rng.shuffle(texts)
    kept = sb.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With three bits for the first hash, most sets collide; none goes for it."""
    monkeypatch.setattr(sb, "NODE_BITS", 3)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[:20] + [t + " and" for t in texts[20:40]] + ["", "  "]
    kept = sb.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts[:-1])


@pytest.mark.parametrize("depth", [0, 1])
def test_crowds_beyond_the_depth(spark, monkeypatch, depth):
    """Rows of one block, and of several, of which none is near another but for planted pairs, with no further split: tiles find all pairs."""
    monkeypatch.setattr(sb, "GROUP", 8)
    monkeypatch.setattr(sb, "DEPTH", depth)
    rng = np.random.default_rng(depth)
    fps = rng.integers(0, 2**63, (60, sb.LANES), dtype=np.uint64)
    fps[30:40] = fps[:10] ^ np.uint64(5)
    rows = []
    for n, fp in enumerate(fps):
        blocks = [1] if n % 3 == 0 or n >= 50 else [1, 2] if n % 3 == 1 else [1, 2, 3]
        rows.append((n, fp.astype(">u8").tobytes(), blocks))
    sets = spark.createDataFrame(rows, "node long, fp binary, blocks array<long>")
    found = {frozenset((r.a, r.b)) for r in sb.set_links(sets).collect()}
    # a pair that shares one block only and has others besides is met where those lie; these planted pairs share all that the smaller has
    want = {frozenset((n, n + 30)) for n in range(10)}
    assert found == want


def test_one_row_of_equal_ids_stays_whatever_their_order(spark):
    rows = [(1, "one two three four five six", tag) for tag in "yxzx"] + [(2, "One two  three four five six", "a"), (3, None, "b"), (3, "", "c"), (None, None, "d"), (4, "else " * 9, None)]
    schema = "doc_id long, text string, tag string"
    kept = [sorted(map(str, sb.keep_one(spark.createDataFrame(r, schema).repartition(n)).collect())) for n, r in ((1, rows), (3, rows[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_names_of_helpers_are_carried(spark):
    names = ["doc_id", "text", "rid", "id", "hash", "body", "node", "fp", "blocks", "_gone", "_content", "c0", "Node", "a.b", "root"]
    rows = [(i, t, *range(len(names) - 2)) for i, t in enumerate(["a b c d e f", "a b c d e f", None])]
    kept = sb.keep_one(spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names if c != "Node") + ", `Node2` long").toDF(*names))
    assert kept.columns == names and sorted(r[0] for r in kept.collect()) == [0, 2] and kept.first()[2:] == tuple(range(len(names) - 2))


def test_hub_in_components(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, 5000 + i) for i in range(100)]
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 3100 and set(found.values()) == {0}


def test_pairs_whose_fingerprints_are_far_apart(spark):
    """Pairs of similarity 0.8 that differ in 69 to 73 of 256 bits, as these seeds' words do, are linked all the same."""
    texts = []
    for seed in (1427, 1869, 3420, 4666):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    fps = [np.frombuffer(sb.majority_bits(np.unique(sb.shingle_hashes(t, 5)), sb.LANES), dtype=np.uint64) for t in texts]
    assert all(np.bitwise_count(a ^ b).sum() > sb.NEAR_BITS for a, b in zip(fps[::2], fps[1::2], strict=True))
    kept = sb.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts) == [0, 2, 4, 6]


@pytest.mark.parametrize(("group", "direct"), [(3, 4), (4096, 2048)])
def test_links_without_any_proposal(spark, monkeypatch, group, direct):
    """With no components to start from, pairs that meet by rare shingles give all of them, counted and in chunks."""
    monkeypatch.setattr(sb, "GROUP", group)
    monkeypatch.setattr(sb, "DIRECT", direct)
    rng = random.Random(13)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, line, texts = some(90), some(20), []
    for n in (4, 9, 40, 90, 90, 90, 90):
        texts += [" ".join(base[:n])] + [" ".join(base[k:n] + some(rng.randint(0, n // 6))) for k in range(3)]
    texts += [" ".join(some(5) + line + some(2)) for _ in range(12)] + [" ".join(line * k + some(1)) for k in range(1, 4)]
    sets = [np.unique(sb.shingle_hashes(t, 5)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    held = spark.createDataFrame([(n, len(s), sb.parity_map(s)) for n, s in enumerate(sets)], "node long, size int, map binary")
    links = sb.missed_links(rows, held, spark.createDataFrame([], "node long, root long"), 5)
    found = {r.node: r.root for r in common.connected_components(links).collect()}
    own, want = [found.get(n, n) for n in range(len(sets))], list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                x, y = sorted((want[i], want[j]))
                want = [x if v == y else v for v in want]
    assert own == want and len(set(own)) < len(own) - 15


def test_a_crowd_of_pairs_gives_few_links(spark, monkeypatch):
    """Copies of a crowded key that all pass the maps: a tile writes links that span them, and not its pairs."""
    monkeypatch.setattr(sb, "DIRECT", 4)
    written, plain = {}, sb.stored

    def stored(df, name):
        out = plain(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(sb, "stored", stored)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    texts = [" ".join(base[:-1] + [f"last{n}"]) for n in range(60)]
    sets = [np.unique(sb.shingle_hashes(t, 5)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    held = spark.createDataFrame([(n, len(s), sb.parity_map(s)) for n, s in enumerate(sets)], "node long, size int, map binary")
    links = sb.missed_links(rows, held, spark.createDataFrame([], "node long, root long"), 5)
    assert {r.root for r in common.connected_components(links).collect()} == {0}
    assert written["pairs"] < 2 * len(texts)  # 1,770 pairs


def test_small_tables_of_components_lie_in_few_partitions(spark):
    """Each partition of a step is files of its own, so a chain of 40 links is not kept in 64 of them."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        roots = common.connected_components(spark.createDataFrame([(n, n + 1) for n in range(40)] + [(90, 91), (90, 91), (7, 7)], "a long, b long"))
        assert {(r.node, r.root) for r in roots.collect()} == {(n, 0) for n in range(41)} | {(90, 90), (91, 90)}
        assert roots.rdd.getNumPartitions() <= 2 * common.LEAST_PARTS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
