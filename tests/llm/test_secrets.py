import random
import re

import pytest
from corpusloom.llm import secret_index as si
from pyspark.sql import functions as F

HEX = "0123456789abcdef" * 2
TEXTS = [
    "PassWord = 'abc123/+x' and token:abc then secret=token:abcdefgh", f"key AKIA{'B' * 16} AKIA{'C' * 15} x{HEX}", "api_key\"  :  \"v4lue-._\" apikey=aaaaaa",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-a", "eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8, "AIza" + "q" * 35,
    "sk_live_" + "1" * 16, "http://me:pw@host/ ftp://a:b@c", "\x01\x02 passwd=\x01secret=abcdef", "é漢🙂 token=zzzzzz é", None, "", "ſecret=abcdefg toKen=abcdefg",
    "token=" + "a" * 50_000, f"password={HEX}", "secrettoken==abcdef",
]


def brute(text):
    out = []
    for n, r in enumerate(si.RULES):
        for m in re.finditer(r.pattern, text or "", re.IGNORECASE | re.ASCII if r.any_case else re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_queries_of_rules():
    by = {r.kind: si.trigram_query(r) for r in si.RULES}
    assert by["hex"] is None and by["access"] == frozenset([frozenset(["aki", "kia"])])
    assert frozenset(["tok", "oke", "ken"]) in by["assign"] and frozenset(["sec", "ecr", "cre", "ret"]) in by["assign"]
    assert all(c for k, q in by.items() if q is not None for c in q)
    for r in si.RULES:
        query = by[r.kind]
        for t in filter(None, TEXTS):
            if query is not None and any(m[1] == si.RULES.index(r) for m in brute(t)):
                assert any(all(g in t.lower() for g in c) for c in query)


@pytest.mark.parametrize("pattern", ["ab(cd|ef)+gh", "a?bcd?e", "(abc|abd)x*y{2}", "[a-c]de[fg]", "x|abc", "a.c", "(?:abc)?def"])
def test_clauses_hold_for_matches(pattern):
    rng = random.Random(0)
    query = si.trigram_query(si.Rule("k", pattern))
    for _ in range(3000):
        t = "".join(rng.choice("abcdefghxy") for _ in range(12))
        if re.search(pattern, t) and query is not None:
            assert any(all(g in t for g in c) for c in query), (pattern, t, query)


def test_against_brute_force(spark, empty):
    rng = random.Random(1)
    bits = ["password", "token", "secret", "api_key", "=", ":", " ", "'", '"', "abcdef", "x", HEX, "AKIA", "ABCDEFGH12345678", "\n", "é", "_live_", "sk", "ghp_"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    rows = [(i, t, "mine", "mine") for i, t in enumerate(texts)] + [(0, texts[0], "mine", "mine"), (None, texts[1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string, row string").repartition(3)
    found = si.find_secrets(df)
    assert found.columns == ["doc_id", "text", "row", "secrets"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.secrets] == brute(r.text), r.text
    assert si.find_secrets(empty).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = si.find_secrets(df).select("text", "secrets", si.redact(F.col("text"), F.col("secrets")).alias("clean")).collect()
    for r in rows:
        want, at = "", 0
        for start, _, stop in brute(r.text):
            if start >= at:
                want += r.text[at:start] + "[REDACTED]"
            at = max(at, stop)
        assert r.clean == (None if r.text is None else want + r.text[at:])
    again = si.find_secrets(spark.createDataFrame([(1, r.clean) for r in rows], "doc_id long, text string"))
    assert not any(s.n in (1, 3, 4, 5) for r in again.collect() for s in r.secrets)


def cleaned(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = si.find_secrets(df).orderBy("doc_id").select("text", "secrets", si.redact(F.col("text"), F.col("secrets")).alias("clean")).collect()
    for r in found:
        assert [tuple(s) for s in r.secrets] == brute(r.text), r.text
    return [r.clean for r in found]


def test_whole_private_keys_go(spark):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("ABCDxyz0189+/") for _ in range(n))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = [line(64) for _ in range(25)] + [line(30) + "=="]
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    long = "\n".join(line(64) for _ in range(3000))
    texts = [
        "a - b\n" + "\n".join([begin, *body, end]) + "\nafter - it", "\r\n".join([begin, *body, end]), begin + "\n" + fields + "\n".join([*body, end]), " ".join([begin, *body, end]),
        '"' + "\\n".join([begin, *body, end]) + '"', f"{begin}\n{long}\n{end}",
        "\n".join([begin, *body]) + "\nafter, it", "\n".join([begin, *body[:-1], "abc"]) + "\nafter it", "\n".join([begin, *body[:-1]]), f"{begin}\n{long}", begin + "\n" + fields + "\n".join(body),
        f"{begin} is how a key begins.", f"{begin}\n{body[0]}\n{end}\nprose here\n{begin}\n{body[1]}\n{end}",
    ]
    R = "[REDACTED]"
    want = [f"a - b\n{R}\nafter - it", R, R, R, f'"{R}"', R, f"{R}\nafter, it", f"{R}after it", R, R, R, f"{R} is how a key begins.", f"{R}\nprose here\n{R}"]
    assert cleaned(spark, texts) == want


def test_long_secrets_go_whole(spark):
    a = "aB3-_" * 5000
    tokens = [
        f"eyJ{a}.eyJ{a}.{a}", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + f".{a}", f"eyJ{a}.eyJ" + "b" * 9 + "." + "c" * 9,
        "ghp_" + "a1" * 9000, "xoxb-" + "1-" * 9000, "sk_live_" + "Z9" * 9000, f"ftp://{a}:p@", f"redis://u:{a}@", f"mysql://{a}:{a}@",
    ]
    assert cleaned(spark, [f"é {t} end" for t in tokens]) == ["é [REDACTED] end"] * len(tokens)
