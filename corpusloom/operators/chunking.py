"""Chunkers as pure text functions and the operator that applies one to a table.

A chunker sees one document and yields pieces in order, so a document's chunks are computed where
its row lies, in Arrow batches and without a shuffle. Sizes count words, bytes or characters as each
docstring says.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import sliced


@dataclass(frozen=True)
class Profile:
    """Sizes in tokens of four bytes; ``overlap`` is a share."""

    target: int
    overlap: float
    least: int
    most: int
    balance: float
    k: int


# Profiles, presets and headings.
PROFILES = {
    "academic": Profile(500, 0.15, 150, 800, 0.5, 5),
    "business": Profile(500, 0.15, 200, 1000, 0.6, 6),
    "legal": Profile(600, 0.30, 250, 1200, 0.4, 8),
    "technical": Profile(450, 0.18, 180, 900, 0.5, 5),
    "mixed": Profile(500, 0.18, 180, 900, 0.5, 5),
}
PRESETS = {"precise": (256, 32), "balanced": (384, 48), "large": (512, 64)}
HEADINGS = {
    "academic": r"Abstract|Introduction|Related\s+Works?|Methods?|Methodology|Approach|Experiments?|Evaluation|Results?|Discussion|Conclusion|Future\s+Work|Limitations|Acknowledgments?|References|Appendix|Background",
    "business": r"Executive\s+Summary|Financial\s+(?:Performance|Highlights)|Business\s+Overview|Risk\s+Factors|Management\s+Discussion|Market\s+Analysis|Financial\s+Results|Key\s+Metrics|Shareholder|Governance|Sustainability",
    "legal": r"Article|Clause|Section|Whereas|Therefore|Party|Obligation|Liability|Termination|Definitions|Representations|Warranties",
    "technical": r"Specification|Implementation|Algorithm|API|Interface|Requirements|Architecture|Design|Testing|Deployment",
}
FALSE_HEADINGS = (
    "figure", "table", "image", "result", "input", "output", "clear", "blurry", "crystal", "gundam", "large", "small", "tiny", "vision",
    "text token", "memory", "pipeline",
)
SENTENCE_END = re.compile(r"[.!?]\s+[A-Z]|\n\s*\n|;\s+[A-Z]")
BYTES_A_TOKEN = 4


def n_bytes(text: str) -> int:
    return len(text.encode())


def tail_words(text: str, n: int) -> str:
    words = text.split()
    return " ".join(words[max(0, len(words) - n) :])


def sentence_chunks(text: str, size: int = 384, overlap: int = 48) -> Iterator[str]:
    """Sentences joined by ``". "`` up to ``size`` words; the next chunk begins with the last ``overlap`` words."""
    held, words = "", 0
    for sentence in re.split(r"[.!?]", text):
        own = len(sentence.split())
        if not own:
            continue
        if held and words + own > size:
            yield held
            held = tail_words(held, overlap)
        held = f"{held}. {sentence.strip()}" if held else sentence.strip()
        words = len(held.split())
    if held.strip():
        yield held


def paragraph_chunks(text: str, size: int = 384, overlap: int = 48) -> Iterator[str]:
    """Paragraphs up to ``size`` words; longer ones are cut into slices of ``size`` words; a rest of overlap is a chunk too."""
    held = ""
    for paragraph in text.split("\n\n"):
        words = paragraph.split()
        if len(words) > size:
            if held.strip():
                yield held
                held = ""
            for at in range(0, len(words), size):
                yield " ".join(words[at : at + size])
            continue
        held = f"{held}\n\n{paragraph}" if held else paragraph
        if len(held.split()) >= size:
            yield held
            held = tail_words(held, overlap)
    if held.strip():
        yield held


def character_chunks(text: str, target_tokens: int = 384, overlap: float = 0.12, least: int = 50) -> Iterator[tuple[str, int, int]]:
    """``(text, start, end)`` in characters: windows that end after white space or a full stop among their last 50 characters."""
    total, size = len(text), target_tokens * BYTES_A_TOKEN
    back = int(size * overlap)
    if not text:
        return
    if total < least:
        yield text, 0, total
        return
    start = 0
    while start < total:
        end = min(start + size, total)
        if end < total:
            end = next((i + 1 for i in range(end - 1, max(end - 50, 0) - 1, -1) if text[i].isspace() or text[i] in ".!?"), end)
        piece = text[start:end]
        if n_bytes(piece.strip()) >= least:
            yield piece, start, end
        if end >= total:
            return
        start = max(end - back, start + 1)


def headings(text: str, profile: str) -> list[tuple[str, int, str | None, int, int]]:
    """``(title, level, number, start, end)`` of the lines that are headings of the profile."""
    known = HEADINGS.get(profile, HEADINGS["academic"])
    pattern = re.compile(rf"(?m)^(?:\s*(\d+(?:\.\d+)*)\s*\.?\s*)?({known})\s*$")
    out = []
    for m in pattern.finditer(text):
        low = m[2].lower()
        if len(low) < 3 or sum(c.isalpha() for c in low) < 3 or any(w in low for w in FALSE_HEADINGS):
            continue
        out.append((m[2], m[1].count(".") + 1 if m[1] else 1, m[1], m.start(), m.end()))
    return out


def sections(text: str, profile: str) -> list[tuple[str, int, str]]:
    """``(title, level, content)``: small neighbours are merged in pairs; what stands before the first heading is left out."""
    found = headings(text, profile)
    if not found:
        return [("Document", 1, text)]
    small = PROFILES[profile].least * BYTES_A_TOKEN * 3
    out: list[tuple[str, int, str]] = []
    waiting: tuple[str, int, str] | None = None
    ends = [f[3] for f in found[1:]] + [len(text)]
    for (title, level, _, start, _), end in zip(found, ends, strict=True):
        own = (title, level, text[start:end])
        if n_bytes(own[2]) >= small:
            out += [s for s in (waiting, own) if s]
            waiting = None
        elif waiting:
            out.append((f"{waiting[0]} + {title}", waiting[1], waiting[2] + own[2]))
            waiting = None
        else:
            waiting = own
    return out + ([waiting] if waiting else [])


def dynamic_overlap(profile: Profile) -> float:
    """15 % of the target in tokens, between 20 and 64, as a share, at most the profile's."""
    return min(min(max(round(0.15 * profile.target), 20), 64) / profile.target, profile.overlap)


def pack_section(content: str, profile: Profile) -> Iterator[str]:
    """Short sections whole if they are long enough; others by sentences with an overlap in characters.

    A sentence end takes the capital after it along, which is part of the delimiter.
    """
    target, most = profile.target * BYTES_A_TOKEN, profile.most * BYTES_A_TOKEN
    if n_bytes(content) <= target:
        if n_bytes(content.strip()) >= profile.least * BYTES_A_TOKEN:
            yield content.strip()
        return
    back = int(target * dynamic_overlap(profile))
    held, size = "", 0
    for sentence in map(str.strip, SENTENCE_END.split(content)):
        if not sentence:
            continue
        if held and size + n_bytes(sentence) > target:
            yield held
            held = f"{held[max(0, len(held) - back) :]} {sentence}"
            size = n_bytes(held)
        else:
            held = f"{held} {sentence}" if held else sentence
            size += n_bytes(sentence) + 1
        if size > most:
            yield held
            held, size = "", 0
    if held.strip():
        yield held


def section_chunks(text: str, profile: str = "mixed") -> Iterator[tuple[str, str, int]]:
    """``(content, section, level)``; texts of the mixed profile look for academic headings."""
    for title, level, content in sections(text, profile if profile in PROFILES else "mixed"):
        for chunk in pack_section(content, PROFILES[profile]):
            yield chunk, title, level


def byte_chunks(text: str, size: int = 384, overlap: int = 48) -> Iterator[str]:
    """Paragraphs up to ``size`` bytes with an overlap in bytes, cut at a character; nothing for short texts."""
    if n_bytes(text) <= size:
        return
    held = ""
    for paragraph in text.split("\n\n"):
        if held and n_bytes(held) + n_bytes(paragraph) > size:
            yield held.strip()
            raw = held.encode()
            held = _tail_bytes(raw, overlap) if overlap and len(raw) > overlap else ""
        held = f"{held}\n\n{paragraph}" if held else paragraph
    if held.strip():
        yield held.strip()


def _tail_bytes(raw: bytes, n: int) -> str:
    at = len(raw) - n
    while at > 0 and raw[at] & 0xC0 == 0x80:
        at -= 1
    return raw[at:].decode()


def coarse_chunks(text: str, size: int = 1500) -> Iterator[str]:
    """Blocks between two blank lines, then paragraphs, up to ``size`` bytes."""
    held = ""
    for paragraph in (p for block in text.split("\n\n\n") for p in block.split("\n\n")):
        if held and n_bytes(held) + n_bytes(paragraph) > size:
            yield held.strip()
            held = ""
        held = f"{held}\n\n{paragraph}" if held else paragraph
    if held.strip():
        yield held.strip()


def with_fallbacks(text: str, chunks: list[str], size: int = 384, overlap: int = 48) -> list[tuple[str, float]]:
    """``(content, confidence)`` after the ladder: whole text, simple split, coarse split, emergency chunk."""
    out = [(c, 1.0) for c in chunks]
    if not out and text.strip():
        out = [(text, 0.8)]
    if len(out) == 1 and n_bytes(text) > 2 * size and len(split := list(byte_chunks(text, size, overlap))) > 1:
        out = [(c, 0.8) for c in split]
    if len(out) < 2 and n_bytes(text) > 3000 and (coarse := list(coarse_chunks(text))):
        out = [(c, 0.7) for c in coarse]
    return out or [("EXTRACTION FAILED", 0.0)]


def pages(text: str) -> list[str]:
    """Form feeds; else two to a hundred blocks between two blank lines; else 4000-byte pages that end at a line; else one page."""
    if "\f" in text and (found := [p for p in text.split("\f") if p.strip()]):
        return found
    found = [p for p in re.split(r"\n\s*\n\s*\n", text) if p.strip()]
    if 2 <= len(found) <= 100:
        return found
    raw = text.encode()
    if len(raw) <= 10_000:
        return [text]
    out, at = [], 0
    while at < len(raw):
        end = min(at + 4000, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        line = raw.rfind(b"\n", at, end)
        end = line + 1 if line >= 0 else end
        out.append(raw[at:end].decode())
        at = end
    return out


CHUNKERS: dict[str, Callable[[str], Iterator]] = {
    "sentences": lambda t: ((c, "", 1, None, None) for c in sentence_chunks(t)),
    "paragraphs": lambda t: ((c, "", 1, None, None) for c in paragraph_chunks(t)),
    "characters": lambda t: ((c, "", 1, a, b) for c, a, b in character_chunks(t)),
    "bytes": lambda t: ((c, "", 1, None, None) for c in byte_chunks(t)),
    "coarse": lambda t: ((c, "", 1, None, None) for c in coarse_chunks(t)),
    "pages": lambda t: ((c, "", 1, None, None) for c in pages(t)),
} | {name: (lambda t, name=name: ((c, s, n, None, None) for c, s, n in section_chunks(t, name))) for name in PROFILES}
#: Which chunker a way of extraction takes.
DISPATCH = {"DirectRead": "sentences", "PdfNative": "sentences", "TesseractOcr": "paragraphs", "PdfOcrFallback": "paragraphs", "HybridIntelligent": "paragraphs"}


def chunk_table(docs: DataFrame, chunker: str, text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_idx, content, section, level, char_start, char_end`` by one of ``CHUNKERS``; null texts give nothing."""

    def run(batches):
        cut = CHUNKERS[chunker]
        for pdf in sliced(batches):
            rows = [
                (key, n, *piece)
                for key, text in zip(pdf["doc_id"], pdf["text"], strict=True)
                if text is not None
                for n, piece in enumerate(cut(text))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "content", "section", "level", "char_start", "char_end"])

    source = docs.select("doc_id", F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, chunk_idx int, content string, section string, level int, char_start int, char_end int")


def chunk_type(content: Column) -> Column:
    def starts(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.startswith(F.ltrim(content), F.lit(w))
        return out

    return F.when(starts("fn ", "function "), "Function").when(starts("class ", "struct "), "Class").when(starts("//", "/*"), "Comment").otherwise("TextBlock")
