"""The audit against filters applied one after another to plain rows."""

import re
from itertools import permutations

from corpusloom.llm import filter_audit as fa


def brute(docs, labels):
    """``docs``: (doc_id, text, source); every order is run over every document."""
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        }
        told = [x for x in labels if x[0] == d and d is not None]
        rows.append((s or "", flags, any(x[1] == 1 for x in told), any(x[2] == 1 for x in told)))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


TEXTS = [
    "", None, " \t\n", "short and plain", "AB CD", "pay $5", "one two three " * 80, " ".join(f"w{i}" for i in range(250)),
    " ".join(f"w{i}" for i in range(200)) + " #", " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(100)),
    "é" * 49 + "A", "é" * 48 + "A", "Word word\x0bword\x0cword", "A" * 300_000,
]


def test_odd_rows(spark):
    docs = [(n % 17 - 1 if n % 9 else None, TEXTS[n % len(TEXTS)], [None, "", "a", "b"][n % 4]) for n in range(90)]
    docs += [(3, "short and plain", "a")] * 2 + [(2, "short and plain", "b")]
    labels = [(n, n % 2, (n + 1) % 2) for n in range(0, 12)] + [(3, None, None), (4, 1, 1), (4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("'x' AS part", "*", "true AS A", "1 AS digest", "2 AS first")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flags = fa.failures(table)
    assert flags.columns == ["doc_id", "part", "A", "B", "C", "D", "E"] and flags.count() == len(docs)
    rows = fa.audit(fa.labelled(flags, told)).collect()
    assert len(rows) == 3 * 600
    assert result(rows) == brute(docs, labels)


def test_empty(spark, empty):
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.labelled(fa.failures(empty), told)).collect() == []


def test_copies_do_not_share_a_key(spark):
    """A hot text is met by text and id: one row for each id, whatever the number of copies."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'the same text' AS text", "'a' AS source")
    got = {r.E: r["count"] for r in fa.failures(docs).groupBy("E").count().collect()}
    assert got == {False: 1, True: 3999}


def test_steps():
    told = fa.steps()
    assert len(told) == 600 and len({(a, b, c) for _, _, a, b, c in told}) == 80 and all(after == 31 for _, n, _, _, after in told if n == 5)
