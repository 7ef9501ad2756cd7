"""Fill-in-the-middle against a per-row version that follows the definition with Python's own regular expressions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import fill_middle as fm
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}


def plain(text, h, rate=100, spm=50, unit="lines"):
    units = re.findall(PATTERNS[unit], text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def drawn(doc_id, seed=7):
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]


TEXT = st.text(st.sampled_from(["a", "\n", " ", "é", "漢", "🙂", "<", "P", "S", ">", "\r", "\x0b"]), max_size=40) | st.sampled_from(["x\n<M>\ny", "<P", ">\n<S>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), min_size=1, max_size=12), st.sampled_from([0, 40, 100]), st.sampled_from(["lines", "words"]))
def test_kernel(rows, rate, unit):
    """Whole batches, sliced ones too; markers that straddle two rows are none."""
    texts, h = [t for t, _ in rows], np.array([x for _, x in rows])
    column = pa.array(["<P", *texts])[1:]
    for a, b, data, bounds in fm._parts(column):
        made = fm.transform(data, bounds, h[a:b], rate, 50, fm.UNITS[unit])
        assert list(zip(*[c.to_pylist() for c in made], strict=True)) == [plain(t, x, rate, 50, unit) for t, x in rows[a:b]]
        form = np.array([["plain", "psm", "spm"].index(x) for x in made[1].to_pylist()])
        for _, _, out, limits in fm._parts(made[4]):
            assert fm.rebuild(out, limits, form).to_pylist() == texts[a:b]


def test_small_kernel_calls(monkeypatch):
    monkeypatch.setattr(fm, "KERNEL_BYTES", 5)
    texts = ["", "ab\nc", "", "a text longer than a call\n" * 3, "\n", ""]
    seen = [(a, b) for a, b, _, _ in fm._parts(pa.array(texts))]
    assert [a for a, _ in seen[1:]] == [b for _, b in seen[:-1]] and (seen[0][0], seen[-1][1]) == (0, len(texts))


def test_table(spark, awkward, empty):
    rows = fm.restore(fm.fill_in_middle(awkward)).collect()
    source = awkward.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *plain(r.text or "", drawn(r.doc_id)), r.text or "") for r in source)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows)
    assert repr(got) == repr(want)
    assert fm.restore(fm.fill_in_middle(empty)).collect() == []


def test_names_that_clash(spark):
    wide = spark.createDataFrame([(7, 3, "one\ntwo\n", "x", "h")], "h0 int, doc_id long, text string, `Text` string, o string")
    row = fm.fill_in_middle(wide).first()
    assert (row.doc_id, row.output) == (3, plain("one\ntwo\n", drawn(3))[4])
    made = spark.createDataFrame([("psm", "<P>a<S>c<M>b", "old", 1), (None, None, "old", 2), ("plain", "<P>", None, None)], "form string, output string, `Restored` string, f int")
    back = fm.restore(made)
    assert back.columns == ["form", "output", "f", "restored"] and [r.restored for r in back.orderBy(back.f.asc_nulls_last()).collect()] == ["abc", "", "<P>"]
    with pytest.raises(ValueError):
        fm.rebuild(np.frombuffer(b"<P>ab", np.uint8), np.array([0, 5]), np.array([1]))
