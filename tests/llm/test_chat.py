import hashlib

from corpusloom.llm import chat_format as cf

SAID = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a~b ~1 ~0 [TEXT] [ALSO] [END]"), (1, 2, "user", "more"), (1, 3, "assistant", SAID), (1, 4, "assistant", ""),
    (1, 5, "user", None), (1, 6, "assistant", "é漢🙂<s>"), (2, 0, None, None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, None, "user", "first"),
    (None, 0, "user", "no id"), (4, 0, "[ROLE]odd~", "role"), (-1, 0, "user", SAID), (-1, 1, "assistant", SAID),
]


def expected():
    out = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "mine") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    back = cf.parse_formatted(cf.format_conversations(df)).collect()
    want = expected()
    assert {r.conv_id for r in back} == set(want)
    for r in back:
        turns = [(t.role, t.text) for t in r.turns]
        assert turns == want[r.conv_id] and r.n_turns == len(turns)
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        raw = r.formatted.encode()
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in turns)
        for s in r.loss_spans:
            assert not any(c in raw[s.start : s.start + s.length].decode() for c in cf.CONTROL)
        assert r.formatted.count("[ROLE]") == sum(a[0] != b[0] for a, b in zip(turns, [(object(), ""), *turns], strict=False))
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == 1


def test_empty_and_many_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cf.format_conversations(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} [END]") for i in range(3000)]
    r = cf.parse_formatted(cf.format_conversations(spark.createDataFrame(rows, schema))).first()
    told = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
    assert hashlib.sha256(told.encode()).digest() == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).digest()
    assert r.loss_text == "".join(x[3] for x in rows if x[2] == "assistant")
