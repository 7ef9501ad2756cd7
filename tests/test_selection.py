"""Bins of spans, order statistics of groups and regions of pages, against plain Python."""

import random

import numpy as np
from corpusloom.operators import collections, layout, selection, spans
from pyspark.sql import functions as F


def test_spans_of_all_lengths(spark):
    rng = random.Random(3)

    def some(n, most):
        out = []
        for i in range(n):
            size = int(2 ** rng.uniform(0, most))
            a = rng.randrange(0, 5000)
            out.append((rng.choice([1, 2]), i, a, a + size))
        return out

    held = [*some(120, 13), (1, 900, 0, 10**7), (1, 901, 64, 64), (2, 902, 0, 1)]
    asked = [*some(80, 12), (1, 700, 5, 5), (2, 701, 0, 64), (1, 702, 63, 65), (1, 703, 0, 1 << 30)]
    a = spark.createDataFrame(held, "doc_id long, span_id long, char_start long, char_end long")
    b = spark.createDataFrame(asked, "doc_id long, range_id long, lo long, hi long")
    want = sorted((r, s) for d, s, x, y in held for e, r, lo, hi in asked if d == e and hi > lo and x < hi and y > lo)
    assert sorted(map(tuple, spans.overlapping(a, b).collect())) == want
    # a span stands in one or two bins of its own level
    assert spans.binned(a, "char_start", "char_end", [], False).count() <= 2 * len(held)
    at = spark.createDataFrame([(d, i, p) for i, (d, p) in enumerate([(1, 0), (1, 64), (2, 0), (2, 3000), (1, 99_999), (3, 1)])], "doc_id long, pos_id long, pos long")
    first = {}
    for d, i, p in at.collect():
        inside = sorted((x, s) for e, s, x, y in held if e == d and x <= p < y)
        if inside:
            first[i] = inside[0][1]
    assert {r.pos_id: r.span_id for r in spans.at_position(a, at).collect()} == first


def test_percentiles_of_any_group(spark):
    rng = random.Random(8)
    groups = {"one": [3.5], "two": [1.0, 2.0], "four": [4.0, 1.0, 3.0, 2.0], "ties": [7.0] * 500 + [8.0] * 3, "many": [rng.gauss(0, 9) for _ in range(20_000)], "none": [None], None: [1.0, 5.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r for r in collections.latency_summary(rows, "g", "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g == "none":
            assert got[g].p50 is None
            continue
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert abs(got[g][name] - np.percentile(vs, p)) < 1e-9, (g, name)


def test_newest_of_large_and_small_groups(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.choice([rng.randrange(10**6), 5])) for i in range(6000) for c in ("a", "b") if c == "a" or i < 40] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "cache string, key long, t long")
    for most in (0, 1, 30, 2000, 10_000):
        got = sorted(map(tuple, selection.newest(df, "cache", "t", "key", F.lit(most)).collect()))
        want = sorted(x for c in "abc" for x in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1]))[:most])
        assert got == want


def test_regions_by_links():
    rng = np.random.default_rng(2)
    n = 300
    x, y, w, h = rng.uniform(0, 1500, n), np.sort(rng.uniform(0, 1500, n)), rng.uniform(1, 60, n), rng.uniform(1, 60, n)
    near = (np.maximum(x[:, None] - (x + w)[None], x[None] - (x + w)[:, None]) < layout.GAP) & (np.maximum(y[:, None] - (y + h)[None], y[None] - (y + h)[:, None]) < layout.GAP)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None], n).min(axis=1)
        if (new == label).all():
            break
        label = new
    old = layout.TILE, layout.OTHERS
    try:
        for layout.TILE, layout.OTHERS in ((7, 11), old):
            assert (layout._components(x, y, w, h) == label).all() and 3 < len(set(label.tolist())) < n
    finally:
        layout.TILE, layout.OTHERS = old
    # a large page: no matrix of all its boxes
    n = 100_000
    many = layout._components(np.tile(np.arange(100) * 60.0, n // 100), np.repeat(np.arange(n // 100) * 50.0, 100), np.full(n, 20.0), np.full(n, 10.0))
    assert len(np.unique(many)) == n


def test_ties_do_not_depend_on_the_order(spark):
    rows = [("k", 1, "x"), ("k", 1, "y"), ("k", 0, "z")]
    told = set()
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "key string, n int, v string").coalesce(1)
        told.add((*(r.v for r in collections.upsert(df.limit(0), df, "key", "n").collect()), *(r.v for r in collections.insert_absent(df.limit(0), df, "key").collect()), *(r.v for r in collections.latest_versions(df, "key", "n").collect())))
    assert len(told) == 1
