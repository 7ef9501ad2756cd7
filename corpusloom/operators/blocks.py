"""Blocks of plain text: kinds of lines with a look ahead, whole blocks, their form and a layout of one column.

A document's blocks are found where its row lies, in Arrow batches and without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import sliced

# Words and marks of each kind of block, and the layout's measures.
FIGURE_WORDS = ("Figure", "Chart", "Graph", "Compression", "Performance")
SCALE_WORDS = ("600-700", "0%", "100%", "Vision Tokens", "Edit Distance")
SEPARATORS = ("\t", "  ", " | ", "|")
LIST_STARTS = ("1 ", "2 ", "3 ", "• ", "- ", "1.", "2.")
CONTENTS_WORDS = ("Introduction", "Methodology", "Discussion", "Conclusion", "Related Works")
HEADER_STARTS = ("1 ", "2 ", "3 ", "4 ", "1.", "2.", "3.", "4.")
HEADERS = ("Abstract", "Introduction", "Methodology", "Evaluation", "Discussion", "Conclusion", "Related Works", "Contents")
CONTINUATIONS = ("The", "This", "We")
#: Confidence, factor of the height, width, and space below, by kind.
MEASURES = {
    "Figure": (0.85, 2.5, 580.0, 60.0), "Table": (0.88, 1.8, 580.0, 50.0), "List": (0.92, 1.5, 560.0, 30.0), "Header": (0.95, 1.2, 580.0, 40.0),
    "KeyValue": (0.90, 1.0, 560.0, 30.0), "Amount": (0.93, 1.0, 560.0, 30.0), "Text": (0.90, 1.0, 560.0, 30.0),
}
TYPES = {
    "header": "Header", "title": "Header", "heading": "Header", "paragraph": "Text", "text": "Text", "table": "Table", "figure": "Figure", "image": "Figure",
    "list": "List", "bullet_list": "List", "numbered_list": "List", "keyvalue": "KeyValue", "key_value": "KeyValue", "field": "KeyValue",
    "amount": "Amount", "money": "Amount", "date": "Date",
}
TOP, EMPTY_LINE, LINE, LEAST_HEIGHT, LEFT = 40.0, 20.0, 20.0, 30.0, 10.0
LONG_PARAGRAPH = 20
#: More lines than any block looks at.
LOOK_AHEAD = 40


def _bytes(line: str) -> int:
    return len(line.encode())


def _digits(line: str) -> int:
    return sum(c.isnumeric() for c in line)


def _any(line: str, words: tuple[str, ...]) -> bool:
    return any(w in line for w in words)


def columns(line: str) -> list[str]:
    """The cells of a line under the separator that gives the most; of equals the first."""
    return max(([c.strip() for c in line.split(s) if c.strip()] for s in SEPARATORS), key=len)


def figure_span(lines: list[str]) -> int:
    """How many of the next ten lines are looked at before a long plain one ends them, if they show a chart; else 0."""
    seen = []
    for line in lines[:10]:
        seen.append(line)
        if _bytes(line) > 200 and "%" not in line and "Figure" not in line:
            break
    drawn = any(_any(x, FIGURE_WORDS) for x in seen) and any(_any(x, SCALE_WORDS) for x in seen)
    return len(seen) if drawn or any(x.count("%") >= 2 for x in seen) else 0


def table_span(lines: list[str]) -> int:
    """The next eight lines if two of them have columns; the look ends after four lines, the first three or more of them, without any."""
    first, rows = 0, 0
    for n, line in enumerate(lines[:8], 1):
        if not line:
            continue
        width = len(columns(line))
        if width >= 2:
            first = first or width
            rows += width >= first // 2
        if not rows and n > 3:
            return 0
    return min(len(lines), 8) if rows >= 2 else 0


def list_span(lines: list[str]) -> int:
    """The next six lines if two are numbered or marked, or two look like a table of contents."""
    seen = [x for x in lines[:6] if x]
    marked = sum(x.startswith(LIST_STARTS) for x in seen)
    contents = sum((x.count(".") >= 3) + _any(x, CONTENTS_WORDS) for x in seen)
    return min(len(lines), 6) if marked >= 2 or contents >= 2 else 0


def is_header(line: str) -> bool:
    capitals = sum(c.isupper() for c in line) / max(_bytes(line), 1)
    return (_bytes(line) < 80 and capitals > 0.5) or line.startswith(HEADER_STARTS) or line in HEADERS


def is_key_value(line: str) -> bool:
    return line.count(": ") == 1 and _bytes(line) < 150


def is_amount(line: str) -> bool:
    dated = _any(line, ("2024", "2025")) or ("/" in line and _digits(line) >= 4)
    return (_any(line, ("$", "€", "£")) or dated) and _bytes(line) < 100


def kind_of(lines: list[str]) -> tuple[str, int]:
    """The kind of the block that begins with the first line, and how many lines were looked at for it."""
    for kind, span in (("Figure", figure_span), ("Table", table_span), ("List", list_span)):
        if n := span(lines):
            return kind, n
    for kind, test in (("Header", is_header), ("KeyValue", is_key_value), ("Amount", is_amount)):
        if test(lines[0]):
            return kind, 1
    return "Text", 1


def _breaks(line: str, before: str) -> bool:
    """Whether a paragraph ends before the line."""
    if (line[:1].isnumeric() and "." in line and _bytes(line) < 50) or is_header(line) or _any(line, ("Figure", "Table", "Chart")):
        return True
    return before.endswith((".", ":")) and line[:1].isupper() and not line.startswith(CONTINUATIONS) and _bytes(line) > 30


def _joined(lines: list[str]) -> str:
    """Lines of a paragraph by spaces; a word that a hyphen parts is put together."""
    out = ""
    for n, line in enumerate(lines):
        if n and lines[n - 1].endswith("-") and not line.startswith("-"):
            out = out[:-1]
        elif n and not line.startswith("-"):
            out += " "
        out += line
    return out


def take(lines: list[str], kind: str, span: int) -> tuple[str, int]:
    """The content of the block, and how many lines it has used."""
    kept: list[str] = []
    used = 0
    if kind == "Text":
        for n, line in enumerate(lines):
            if line and n and _breaks(line, lines[n - 1]):
                break
            used += 1
            if not line:
                break
            kept.append(line)
            if len(kept) == LONG_PARAGRAPH:
                break
        return _joined(kept), used
    if kind == "Table":
        for line in lines[: span + 10]:
            if line and (is_header(line) or "Figure" in line):
                break
            used += 1
            if line or kept:
                kept.append(line)
        return "\n".join(kept), used
    if kind == "Figure":
        inside = False
        for n, line in enumerate(lines[: span + 15]):
            if line:
                if n and is_header(line):
                    break
                data = "%" in line or ("-" in line and _digits(line) >= 3) or _any(line, ("Vision Tokens", "Figure"))
                if not data and (_bytes(line) > 100 if inside else not _any(line, ("Compression", "Performance"))):
                    break
                inside = inside or data
                kept.append(line)
            used += 1
        return " ".join(kept), used
    if kind == "List":
        for line in lines[: span + 8]:
            if line:
                if not (line[0].isnumeric() or line[0] in "•-") and ("." not in line or _bytes(line) > 100):
                    break
                kept.append(line)
            used += 1
        return "\n".join(kept), used
    return lines[0], 1


def formed(kind: str, content: str) -> str:
    """The content in its form: data of figures, tables and lists under headings."""
    if kind == "Figure":
        return _figure(content)
    if kind == "Table":
        cells = columns(content)
        if len(cells) < 2:
            return f"📋 **Table Data**\n\n• {content}\n"
        return f"📋 **Table Data**\n\n| {' | '.join(cells)} |\n|{'---|' * len(cells)}\n"
    if kind == "List":
        contents = content.count(".") >= 3 or _any(content, ("Introduction", "Methodology"))
        marked = content[:1].isnumeric() or content.startswith(("• ", "- "))
        return f"{'📚 **Table of Contents**' if contents else '📝 **Structured List**'}\n\n  {'' if marked else '• '}{content}\n"
    return content


def _figure(content: str) -> str:
    parts = []
    words = content.split()
    if _any(content, ("Figure", "Chart")):
        parts.append(f"📊 **{content}**\n\n")
    shares = [w for w in words if "%" in w]
    if content.count("%") >= 2 and shares:
        parts.append("📈 **Performance Data:**\n" + "".join(f"  • Point {n}: {w}\n" for n, w in enumerate(shares, 1)) + "\n")
    ranges = [w for w in words if "-" in w and _digits(w)]
    if "-" in content and _digits(content) >= 4 and ranges:
        parts.append("📏 **Data Ranges:**\n" + "".join(f"  • {w}\n" for w in ranges) + "\n")
    if _any(content, ("Vision Tokens", "Edit Distance", "Compression")):
        parts.append(f"⚡ **Performance Metrics:**\n  • {content}\n\n")
    out = "".join(parts)
    return out if _bytes(out) >= 50 else f"📊 **Figure/Chart Data**\n\n{content}"


def layout(text: str) -> Iterator[tuple]:
    """``(kind, content, y, height, width, confidence)`` of each block, down one column."""
    lines, y, at = [x.strip() for x in re.split(r"\r?\n", text)], TOP, 0
    if lines and not lines[-1]:
        lines.pop()
    while at < len(lines):
        if not lines[at]:
            at, y = at + 1, y + EMPTY_LINE
            continue
        ahead = lines[at : at + LOOK_AHEAD]
        kind, span = kind_of(ahead)
        content, used = take(ahead, kind, span)
        if not content.strip():
            at += 1
            continue
        content = formed(kind, content)
        confidence, factor, width, space = MEASURES[kind]
        height = max(len(content.removesuffix("\n").split("\n")) * LINE, LEAST_HEIGHT) * factor
        yield kind, content, y, height, width, confidence
        y, at = y + height + space, at + max(used, 1)


def document_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, block, kind, content, x, y, width, height, confidence`` of ``docs (doc_id, text)``; null texts give nothing."""

    def run(batches):
        for pdf in sliced(batches):
            rows = [
                (key, n, kind, content, LEFT, y, width, height, confidence)
                for key, text in zip(pdf["doc_id"], pdf["text"], strict=True)
                if text is not None
                for n, (kind, content, y, height, width, confidence) in enumerate(layout(text))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "kind", "content", "x", "y", "width", "height", "confidence"])

    source = docs.select("doc_id", F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, block int, kind string, content string, x double, y double, width double, height double, confidence double")


def block_type(name):
    """A kind of block by any of its names; Text for others."""
    out = F.lit("Text")
    for word, kind in TYPES.items():
        out = F.when(F.lower(name) == word, kind).otherwise(out)
    return out
