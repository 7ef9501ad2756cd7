import zlib

from corpusloom.sources import pdf


def make(streams, deflate=False, box="[0 0 200 300]"):
    """A file with a page a stream."""
    out, n = b"%PDF-1.4\n", 1
    for s in streams:
        body = zlib.compress(s) if deflate else s
        filtered = b"/Filter /FlateDecode " if deflate else b""
        out += b"%d 0 obj\n<< /Type /Page /MediaBox %s /Contents %d 0 R >>\nendobj\n" % (n, box.encode(), n + 1)
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n" % (n + 1, filtered, len(body)) + body + b"\nendstream\nendobj\n"
        n += 2
    return out + b"9999 0 obj\n<< /Type /Pages >>\nendobj\n%%EOF"


def test_text_operators():
    assert pdf.stream_text(b"BT\n/F1 12 Tf (one) Tj [(tw) -20 (o)] TJ (three) ' 1 2 (four) \" ET (out) Tj") == "one tw o three\nfour\n\n"
    assert pdf.stream_text(rb"BT (a\(b\) (c) \101\n) Tj <48 69> Tj ET % (no) Tj") == "a(b) (c) A\n Hi \n"
    assert pdf.stream_text(b"BT (open") == "" and pdf.stream_text(b"") == ""


def test_files():
    for deflate in (False, True):
        text, sizes = pdf.read_pdf(make([b"BT (page one) Tj ET", b"BT (page two) Tj ET"], deflate))
        assert text == "page one \npage two \n" and sizes == [(200.0, 300.0)] * 2
    assert pdf.read_pdf(b"no file") == ("", []) and pdf.read_pdf(b"%PDF-1.4 cut") == ("", [])
    broken = make([b"BT (x) Tj ET"], True).replace(zlib.compress(b"BT (x) Tj ET")[2:6], b"####")
    assert pdf.read_pdf(broken)[0] == ""


def test_blocks():
    long = "A sentence that is long enough to be a paragraph of its own, as it has more than a hundred bytes in it all."
    blocks = list(pdf.page_blocks(f"Title\n\n{long}\n\n- one\n- two\n\n{long}\n\nrest", [(595.0, 842.0), (595.0, 842.0)]))
    assert [(b[0], b[1]) for b in blocks] == [(1, "Text"), (1, "List"), (2, "Header")]
    assert blocks[0][2] == f"Title {long}" and blocks[0][3:] == (50.0, 50.0, 495.0, 16.0) and blocks[1][4] == 76.0 and blocks[1][6] == 32.0
    assert blocks[1][2] == f"- one\n- two {long}" and list(pdf.page_blocks("", [(1.0, 1.0)])) == []


def test_rows(spark):
    words = b"BT (" + b"word " * 12 + b") Tj ET"
    df = spark.createDataFrame([(1, make([words])), (2, make([b"BT (few) Tj ET"])), (3, None), (4, b"x")], "doc_id long, content binary")
    rows = {r.doc_id: r for r in pdf.pdf_texts(df).collect()}
    assert (rows[1].tokens, rows[1].pages, rows[1].success) == (12, 1, True) and not any(rows[k].success for k in (2, 3, 4)) and rows[3].text == ""
    assert [r.doc_id for r in pdf.extracted(df).collect()] == [1] and sorted(r.doc_id for r in pdf.extracted(df, 1).collect()) == [1, 2]
    assert [(r.doc_id, r.kind, r.confidence) for r in pdf.pdf_blocks(df).where("doc_id = 2").collect()] == [(2, "Header", 0.75)]
