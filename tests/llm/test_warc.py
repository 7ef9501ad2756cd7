import hashlib
import random
import re

from corpusloom.llm import warc_salvage as ws

SCHEMA = "page_id long, url string, html string, bytes string"
TEXT = "<p>é</p>" * 40
ROWS = [
    (5, "http://a/é?q=1 2", TEXT), (3, None, TEXT), (3, None, TEXT), (9, "u", TEXT), (1, "u", None), (2, "u", ""), (7, "u", "short"), (8, "u", "short"),
    (None, "u", TEXT), (4, "x\r\ny", "WARC/1.1\r\n" * 50), (6, "u", "long " * 100_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "mine") for r in ROWS], SCHEMA).repartition(3)
    back = ws.read_archives(ws.write_archives(ws.mark_revisits(df), archive_bytes=500)).collect()
    assert {r.kind for r in back} == {"record"} and len(back) == len(ROWS)
    for r in back:
        html = next(h for i, _, h in ROWS if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        revisit = html == TEXT and r.page_id in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else html.encode())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ws.read_archives(ws.write_archives(ws.mark_revisits(df))).count() == 0
    none = spark.createDataFrame([("a", None), ("b", b"")], "archive string, bytes binary")
    assert ws.read_archives(none).count() == 0


def records(n, pack):
    body = [f"payload {i} ".encode() * 30 for i in range(n)]
    return body, [pack(ws.record_bytes(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None)) for i, b in enumerate(body)]


def covered(events, data):
    at = 0
    for kind, start, end, *_ in events:
        if kind == "gap" or end > start:
            assert start == at
            at = end
    assert at == len(data)


def test_salvage_after_damage():
    for pack in (ws.member, bytes):
        body, parts = records(6, pack)
        for damage in ("flip", "cut", "junk", "head"):
            bad = {
                "flip": parts[2][: len(parts[2]) // 2] + b"\x00\xff\x00" + parts[2][len(parts[2]) // 2 + 3 :], "cut": parts[2][:40],
                "junk": b"\x1f\x8b\x08 not a member WARC" + parts[2], "head": b"?" + parts[2][1:],
            }[damage]
            data = b"".join(parts[:2]) + bad + b"".join(parts[3:])
            events = list(ws.salvage(data))
            # a record whose head may be damaged comes back too, but is marked
            assert all(e[4].partition(b"\r\n\r\n")[2] == body[2] for e in events if not e[5])
            found = [e[4].partition(b"\r\n\r\n")[2] for e in events if e[0] == "record" and e[5]]
            kept = body if damage == "junk" else body[:2] + body[3:]
            assert found == kept, (pack, damage)
            gaps = [e for e in events if e[0] == "gap"]
            assert len(gaps) == 1 and gaps[0][1] == len(b"".join(parts[:2])) and gaps[0][3]
            covered(events, data)


def payloads(data):
    events = list(ws.salvage(data))
    covered(events, data)
    return [e[4].partition(b"\r\n\r\n")[2] for e in events if e[0] == "record"], [e[1:4] for e in events if e[0] == "gap"]


def test_records_of_a_damaged_member():
    rng = random.Random(0)
    body = [rng.randbytes(4000) for _ in range(8)]
    parts = [ws.record_bytes(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(body)]
    alone = ws.member(ws.record_bytes(9, "http://x/9", b"alone", "", None))
    # a record fails its check: the others of the member are whole
    for bad in (parts[2].replace(body[2], body[2][::-1]), parts[2].replace(b"Content-Length: 4", b"Content-Length: 9"), parts[2][:700], b"?" * 50):
        whole = ws.member(b"".join([*parts[:2], bad, *parts[3:]]))
        found, gaps = payloads(alone + whole + alone)
        assert found == [b"alone", *body[:2], *body[3:], b"alone"]
        assert [g[:2] for g in gaps] == [(len(alone), len(alone) + len(whole))] and gaps[0][2]
    for level in (0, 1):
        whole = ws.member(b"".join(parts), level)
        at = len(ws.member(b"".join(parts[:4]), level))
        # inflating fails: what came before is kept, once
        found, gaps = payloads(whole[: at + 1500] + alone)
        assert found == [*body[:4], b"alone"] and len(gaps) == 1
        found, gaps = payloads(whole[: at + 1500])
        assert found == body[:4] and len(gaps) == 1
        # a byte differs that inflating does not notice: the digest shows where
        hit = whole.find(body[5][:50]) + 10 if level == 0 else 0
        if hit:
            found, gaps = payloads(whole[:hit] + bytes([whole[hit] ^ 1]) + whole[hit + 1 :] + alone)
            assert found == [*body[:5], *body[6:], b"alone"] and len(gaps) == 1
        # only the check of the whole member fails: the damage may be in any head
        assert payloads(whole[:-8] + bytes(8) + alone)[0][-1] == b"alone"


def test_a_wrong_trailer_loses_no_record(spark):
    """One byte of a member's check differs: all records, whose digests hold, come back and are marked."""
    body = [b"%d " % i * 50 for i in range(50)]
    whole = ws.member(b"".join(ws.record_bytes(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(body)))
    alone = ws.member(ws.record_bytes(99, "http://x/99", b"alone", "", None))
    for at in (-8, -5, -3):
        data = whole[:at] + bytes([whole[at] ^ 1]) + whole[len(whole) + at + 1 :] + alone
        rows = ws.read_archives(spark.createDataFrame([("a", data)], "archive string, bytes binary")).collect()
        held = [r for r in rows if r.kind == "record"]
        assert [(r.page_id, bytes(r.payload), r.certain) for r in held] == [(i, b, False) for i, b in enumerate(body)] + [(99, b"alone", True)]
        assert [(r.start_byte, r.end_byte) for r in rows if r.kind == "gap"] == [(0, len(whole))]


def test_a_broken_member_needs_digests():
    parts = [re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", ws.record_bytes(i, "http://x/", b"%d " % i * 50, "", None)) for i in range(3)]
    whole = ws.member(b"".join(parts))
    assert len(list(ws.salvage(whole))) == 3 and payloads(whole[:-8] + bytes(8))[0] == []


def test_end_is_lost_and_all_is_lost():
    body, parts = records(3, ws.member)
    data = b"".join(parts)[:-20]
    events = list(ws.salvage(data))
    assert [e[0] for e in events] == ["record", "record", "gap"]
    covered(events, data)
    assert [e[:3] for e in ws.salvage(b"nothing here")] == [("gap", 0, 12)]


def test_gaps_are_rows(spark, tmp_path):
    _, parts = records(3, ws.member)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1] + parts[2])
    rows = ws.read_archives(ws.archive_files(spark, str(tmp_path))).orderBy("start_byte", "end_byte").collect()
    assert [r.kind for r in rows] == ["record", "gap", "record", "record"]
    assert rows[1].end_byte - rows[1].start_byte == 4 and rows[1].page_id is None and rows[1].reason


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "page %d " % i * 40) for i in range(30)] + [(99, None, None)], "page_id long, url string, html string")
    archives = ws.write_archives(ws.mark_revisits(pages), archive_bytes=500)
    folder = tmp_path / "out"
    rows = ws.write_files(archives, str(folder)).collect()
    assert len(rows) == archives.count() > 3 and sorted(p.name for p in folder.iterdir()) == sorted(r.archive for r in rows)
    assert all((folder / r.archive).stat().st_size == r.size for r in rows)
    assert len(ws.write_files(archives, str(folder)).collect()) == len(rows)  # again: the same files
    back = ws.read_archives(ws.archive_files(spark, str(folder))).collect()
    assert sorted(r.page_id for r in back) == [*range(30), 99] and all(r.kind == "record" for r in back)


def test_digests_of_other_writers():
    import base64
    import hashlib

    for name, digest in (("sha1", hashlib.sha1(b"x")), ("SHA-256", hashlib.sha256(b"x")), ("md5", hashlib.md5(b"x"))):
        for value in (digest.hexdigest(), digest.hexdigest().upper(), base64.b32encode(digest.digest()).decode().rstrip("=")):
            assert ws.digest_holds(f"{name}:{value}", b"x") and not ws.digest_holds(f"{name}:{value}", b"y")
    assert ws.digest_holds("blake9:00", b"x") and ws.digest_holds("", b"x")
