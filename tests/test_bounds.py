"""What a task holds at once does not grow with its rows."""

import numpy as np
import pandas as pd
from corpusloom import storage
from corpusloom.operators import pair_blocks, term_batches


def test_rows_of_a_batch_are_few_at_a_time():
    pdf = pd.DataFrame({"doc_id": range(1000), "text": "x"})
    parts = list(storage.sliced(iter([pdf, pdf.iloc[:0], pdf.iloc[:3]])))
    assert max(map(len, parts)) <= storage.SLICE_ROWS and [i for p in parts for i in p.doc_id] == [*range(1000), 0, 1, 2]


def test_scans_bound_batches(spark, small):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    storage.scan(spark, f"{small}/documents.parquet")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == storage.BATCH_BYTES


def test_sums_by_bounded_entries(monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted({(int(t), int(q)) for t, q in zip(rng.integers(0, 20, 80), rng.integers(0, 9, 80), strict=True)})
    lookup = pair_blocks.Lookup(20, [(t, q, t + q / 10) for t, q in rows], 1)
    row, term = np.sort(rng.integers(0, 30, 200)), rng.integers(0, 20, 200)
    weight = rng.random(200)
    want, number = np.zeros((30, 9)), np.zeros((30, 9), int)
    for r, t, w in zip(row, term, weight, strict=True):
        for u, q in rows:
            if u == t:
                want[r, q] += w * (t + q / 10)
                number[r, q] += 1
    sizes, real = [], term_batches.expand
    monkeypatch.setattr(term_batches, "ENTRIES", 25)
    monkeypatch.setattr(term_batches, "expand", lambda *a: (sizes.append(int(a[3][a[1]].sum())), real(*a))[1])
    met, got = lookup.sums(row, term, weight, 30, 9)
    assert (met == number).all() and np.allclose(got, want) and max(sizes) <= 25
    assert all((x == 0).all() for x in lookup.sums(row[:0], term[:0], None, 3, 9))
