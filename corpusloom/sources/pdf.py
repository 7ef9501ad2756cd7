"""Text of PDF files from their bytes: objects, pages, content streams, and blocks laid out over the pages.

What needs no font tables is read: streams that are plain or deflated, and strings in parentheses or
hexadecimal digits as Latin text. Encrypted files and object streams give no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words from which a text counts as extracted.
LEAST_TOKENS = 10
# Fixed values of the layout: page of A4 in points, margins, line height, space between blocks and above the page's end.
PAGE, MARGIN, LINE, SPACE, END = (595.0, 842.0), 50.0, 16.0, 10.0, 100.0
SHORT, CONFIDENCE = 100, 0.75
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\nendstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """``("text", bytes)`` of strings, ``("mark", bytes)`` of brackets, ``("word", bytes)`` of all else in a content stream."""
    at, n = 0, len(data)
    while at < n:
        c = data[at]
        if c in _SPACE:
            at += 1
        elif c == ord("%"):
            while at < n and data[at] not in b"\r\n":
                at += 1
        elif c == ord("("):
            text, at = _string(data, at + 1)
            yield "text", text
        elif c == ord("<") and data[at + 1 : at + 2] != b"<":
            end = data.find(b">", at)
            end = n if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            yield "text", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            at = end + 1
        elif c in b"[]":
            yield "mark", data[at : at + 1]
            at += 1
        elif c in _DELIMITERS and c != ord("/"):
            at += 1
        else:
            end = at + 1
            while end < n and data[end] not in _SPACE and data[end] not in _DELIMITERS:
                end += 1
            yield "word", data[at:end]
            at = end


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket ends before ``at``, and where the data goes on; inner brackets are balanced."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        if c == ord("\\"):
            digits = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if digits:
                out.append(int(digits[0], 8) & 255)
                at += 1 + len(digits[0])
            else:
                following = data[at + 1 : at + 2]
                out += _ESCAPES.get(following[0], following) if following not in (b"", b"\n", b"\r") else b""
                at += 2
            continue
        depth += (c == ord("(")) - (c == ord(")"))
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def stream_text(data: bytes) -> str:
    """What the text operators of a content stream show: strings with spaces after them, lines after ``'``, ``"`` and text objects."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for kind, value in tokens(data):
        if kind == "text":
            held.append(value.decode("latin-1"))
        elif kind == "word":
            if value == b"BT":
                inside = True
            elif value == b"ET":
                inside = False
                out.append("\n")
            elif inside and value == b"Tj" and held:
                out.append(held[-1] + " ")
            elif inside and value == b"TJ":
                out += [t + " " for t in held]
            elif inside and value in (b"'", b'"') and held:
                out.append(held[-1] + "\n")
            if value[:1].isalpha() or value in (b"'", b'"', b"T*"):
                held = []
    return "".join(out)


def _inflated(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"FlateDecode" not in body[: found.start()]:
        return found[1]
    try:
        return zlib.decompressobj().decompress(found[1])
    except zlib.error:
        return b""


def read_pdf(data: bytes) -> tuple[str, list[tuple[float, float]]]:
    """The text of all pages in order, and their sizes. Bytes that are no PDF have neither."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)} if data.startswith(b"%PDF") else {}
    texts, sizes = [], []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body)
        x0, y0, x1, y1 = (float(v) for v in box.groups()) if box else (0.0, 0.0, *PAGE)
        sizes.append((x1 - x0, y1 - y0))
        named = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        parts = [_inflated(objects.get(int(n), b"")) for n in _REFERENCE.findall(named[1])] if named else []
        texts.append(stream_text(b"\n".join(parts)))
    return "".join(texts), sizes


def page_blocks(text: str, sizes: list[tuple[float, float]]) -> Iterator[tuple[int, str, str, float, float, float, float]]:
    """``(page, kind, content, x, y, width, height)``: paragraphs dealt evenly to the pages, down each page.

    A paragraph of fewer than 100 bytes, or without a sentence's end, goes on in the next one.
    """
    whole: list[str] = []
    held = ""
    for part in (p.strip() for p in text.split("\n\n")):
        if not part:
            continue
        held = f"{held} {part}" if held else part
        if len(part.encode()) >= SHORT and part.endswith((".", "!", "?")):
            whole.append(held)
            held = ""
    whole += [held] if held else []
    each = max(1, -(-len(whole) // max(len(sizes), 1)))
    for page, (width, height) in enumerate(sizes):
        y = MARGIN
        for content in whole[page * each : (page + 1) * each]:
            lines = content.split("\n")
            listed = any(x.lstrip()[:1] in ("•", "-") or x.lstrip()[:1] in tuple("0123456789") for x in lines if x.lstrip())
            kind = "Header" if len(lines) == 1 and len(content.encode()) < SHORT else "List" if listed else "Text"
            tall = min(len(lines) * LINE, height - y - MARGIN)
            yield page + 1, kind, content, MARGIN, y, width - 2 * MARGIN, tall
            y += tall + SPACE
            if y > height - END:
                break


def pdf_texts(files: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """``doc_id, text, tokens, chars, pages, success`` of ``files (doc_id, content binary)``, in bytes of text and words.

    Null or broken contents have an empty text. ``success`` asks for ``least`` words: what is not
    extracted goes on to recognition.
    """

    def run(batches):
        for pdf in batches:
            read = [read_pdf(bytes(c) if c is not None else b"") for c in pdf["content"]]
            words = [len(t.split()) for t, _ in read]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "text": [t for t, _ in read], "tokens": words, "chars": [len(t.encode()) for t, _ in read], "pages": [len(s) for _, s in read],
                "success": [w >= least for w in words],
            })

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, text string, tokens long, chars long, pages int, success boolean")


def extracted(files: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """``doc_id, text`` of the files that have at least so many words."""
    return pdf_texts(files, least).where("success").select("doc_id", "text")


def pdf_blocks(files: DataFrame) -> DataFrame:
    """``doc_id, page, kind, content, x, y, width, height, confidence`` of the files' texts over their pages."""

    def run(batches):
        names = ["doc_id", "page", "kind", "content", "x", "y", "width", "height"]
        for pdf in batches:
            rows = [(key, *block) for key, c in zip(pdf["doc_id"], pdf["content"], strict=True) for block in page_blocks(*read_pdf(bytes(c) if c is not None else b""))]
            yield pd.DataFrame(rows, columns=names).assign(confidence=CONFIDENCE)

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page int, kind string, content string, x double, y double, width double, height double, confidence double")


def pdf_files(spark, path: str) -> DataFrame:
    """``doc_id, path, content`` of PDF files; the id is a hash of the path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
