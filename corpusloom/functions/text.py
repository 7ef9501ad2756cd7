"""Text functions as column expressions: tokens, normalisation, redaction, likeness.

Lengths that count bytes use ``octet_length``; word boundaries and case follow Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st"}
MORE_LIGATURES = {"\u0133": "ij", "\u0152": "OE", "\u0153": "oe", "\u1d6b": "ue"}
FULLWIDTH = {"\uff21": "A", "\uff41": "a"}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u061c"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"


def words(text: Column) -> Column:
    """Non-empty runs between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def joined_words(text: Column) -> Column:
    return F.array_join(words(text), " ")


def bare_tokens(text: Column) -> Column:
    """Lower-case words without anything but letters, digits and ``_``."""
    return words(F.regexp_replace(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{N}_\s]", ""))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by ``a_b`` for each neighbouring pair."""
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def term_tokens(text: Column) -> Column:
    """Bare tokens of more than two bytes, the terms of the document-frequency map."""
    return F.filter(bare_tokens(text), lambda w: F.octet_length(w) > 2)


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def hits(text: Column, pieces: list[str] | tuple[str, ...]) -> Column:
    """How many of the literals occur."""
    total = F.lit(0)
    for p in pieces:
        total = total + F.contains(text, F.lit(p)).cast("int")
    return total


def any_of(text: Column, pieces: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in pieces:
        found = found | F.contains(text, F.lit(p))
    return found


def matches(text: Column, pattern: str) -> Column:
    """How many non-overlapping matches a pattern has."""
    return F.regexp_count(text, F.lit(pattern))


def jaccard_words(a: Column, b: Column) -> Column:
    """Likeness of lower-case word sets; two empty texts are alike."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark does not have."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ligature_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(LIGATURES), ""))


def ligature_counts(text: Column) -> Column:
    """A map from each ligature to how often it occurs."""
    items: list[Column] = []
    for a in LIGATURES:
        items += [F.lit(a), count_of(text, a)]
    return F.create_map(*items)


def sanitize_pdf_text(text: Column, every: bool = False) -> Column:
    """Ligatures and no-break spaces, then compatibility composition; ``every`` also drops zero-width marks and joins white space."""
    first = dict(list(LIGATURES.items())[: 7 if every else 5])
    out = nfkc(F.replace(_replaced(text, first), F.lit("\u00a0"), F.lit(" ")))
    return joined_words(F.translate(out, ZERO_WIDTH, "")) if every else out


def replace_ligatures(text: Column) -> Column:
    return _replaced(text, LIGATURES | MORE_LIGATURES)


def clean_ligatures(text: Column) -> Column:
    """The eight replacements that sectioned chunking applies first."""
    table = {k: v for k, v in LIGATURES.items() if v != "ft"} | FULLWIDTH
    return _replaced(text, table)


def normalization_quality(original: Column, normalized: Column) -> Column:
    ratio = F.length(normalized) / F.length(original)
    return (
        F.when((ratio >= 1.0) & (ratio <= 1.3), 1.0).when((ratio > 1.3) & (ratio <= 1.5), 0.8).when((ratio > 1.5) & (ratio <= 2.0), 0.6).otherwise(0.3)
    )


def clean_extracted(text: Column) -> Column:
    """Sanitised text in one line with plain quotes and dashes and without control characters."""
    out = F.translate(joined_words(sanitize_pdf_text(text)), "\u2018\u2019\u2013\u2014", "''--")
    return F.regexp_replace(out, r"[\p{Cc}&&[^\n\t]]", "")


def normalization_score(text: Column) -> Column:
    """Weights of characters that spoil indexing, among the first 10,000, and of hyphens at line ends."""
    head = F.substring(text, 1, 10_000)

    def count(chars: str) -> Column:
        return F.length(head) - F.length(F.translate(head, chars, ""))

    chars = 10 * count("".join(LIGATURES)) + 8 * count(ZERO_WIDTH) + 3 * count("\u00a0\u00ad\u202f\u205f\u3000")
    chars = chars + 2 * count("".join(chr(c) for c in range(0x2000, 0x200B)))
    return chars + F.when(any_of(text, ["-\n", "- \n", "-\r\n"]), 5).otherwise(0)


def needs_normalization(text: Column) -> Column:
    size = F.octet_length(text)
    return (size >= 10) & (normalization_score(text) >= F.when(size > 50_000, 8).otherwise(3))


def normalize_for_rag(text: Column, always: bool = False) -> Column:
    """Ligatures, spaces, compatibility composition, hyphens at line ends, zero-width marks, white space; only where needed."""
    out = nfkc(F.translate(_replaced(text, LIGATURES), SPACES, " " * len(SPACES)))
    out = F.regexp_replace(out, r"(?U)(\p{L})-\s*\n\s*(\p{L})", "$1$2")
    out = joined_words(F.translate(out, ZERO_WIDTH, ""))
    return out if always else F.when(needs_normalization(text), out).otherwise(text)


def normalization_report(text: Column) -> Column:
    """Characters (bytes) and tokens before and after, ligatures, and whether anything was done."""
    after = normalize_for_rag(text)
    return F.struct(
        F.octet_length(text).alias("chars_before"),
        F.octet_length(after).alias("chars_after"),
        word_count(text).alias("tokens_before"),
        word_count(after).alias("tokens_after"),
        ligature_count(text).alias("ligatures"),
        needs_normalization(text).alias("applied"),
    )


def redact_pii(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL_REDACTED]"), PHONE, "[PHONE_REDACTED]")


def has_pii(text: Column) -> Column:
    return F.rlike(text, F.lit(EMAIL)) | F.rlike(text, F.lit(PHONE))


def trimmed_lines(text: Column) -> Column:
    """Trimmed non-empty lines, joined by line ends."""
    return F.array_join(F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def truncate_bytes(text: Column, limit: int) -> Column:
    """Texts of more bytes keep ``limit - 3`` characters and end with an ellipsis."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("…")))


def condense(text: Column, limit: int) -> Column:
    """The trimmed text up to its last full stop within the limit if that is past the middle, else up to the last space."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    head = F.substring(bare, 1, limit)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    space = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    at_stop, at_space = F.contains(head, F.lit(".")) & (stop - 1 > limit // 2), F.contains(head, F.lit(" "))
    cut = F.when(at_space, F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(bare) <= limit, bare).when(at_stop, F.substring(head, F.lit(1), stop)).otherwise(F.concat(cut, F.lit("...")))


def key_sentences(text: Column, n: int) -> Column:
    """The first sentences of more than 30 bytes, counted before they are trimmed."""
    long = F.filter(F.split(text, "[.!?]"), lambda s: (F.octet_length(s) > 30) & (F.trim(s) != ""))
    return F.transform(F.slice(long, 1, n), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def line_numbers(text: Column, start: Column, end: Column) -> Column:
    """Lines (from 1) of the first and last character of a range."""

    def line(at: Column) -> Column:
        return F.regexp_count(F.substring(text, F.lit(1), at), F.lit("\n")) + 1

    return F.struct(line(start).alias("line_start"), line(end).alias("line_end"))


def human_size(size: Column, largest: str = "TB") -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    top = units.index(largest)
    out = F.concat(F.round(size / 1024.0**top, 1).cast("string"), F.lit(f" {largest}"))
    for k in reversed(range(top)):
        out = F.when(size < 1024.0 ** (k + 1), F.concat(F.round(size / 1024.0**k, 1).cast("string"), F.lit(f" {units[k]}"))).otherwise(out)
    return out


def confidence_percent(confidence: Column) -> Column:
    """0 to 100, cut to a whole number."""
    return F.least(F.greatest(confidence * 100.0, F.lit(0.0)), F.lit(100.0)).cast("int")


def ligature_positions(text: Column) -> Column:
    """``array<struct<at, ligature>>``: bytes before each ligature, in order."""
    found = F.array(*[F.lit(c) for c in LIGATURES | MORE_LIGATURES])
    chars = F.split(text, "")
    sized = F.transform(chars, lambda c, i: F.struct(F.octet_length(F.substring(text, F.lit(1), i)).alias("at"), c.alias("ligature")))
    return F.filter(sized, lambda s: F.array_contains(found, s["ligature"]))


# Phrases of a recording program's own windows, marks that are navigation, and what stands at the start of such lines.
INTERFACE_MARKS = "©€@&+>\\|"


def without_interface(text: Column, phrases: tuple[str, ...], starts: tuple[str, ...] = (), marks: str = INTERFACE_MARKS) -> Column:
    """Trimmed lines of three bytes or more that hold none of the phrases, are not marks alone and do not begin as listed."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))

    def good(line: Column) -> Column:
        noise = (F.octet_length(line) < 3) | (F.translate(line, marks, "") == "")
        for s in starts:
            noise = noise | F.startswith(line, F.lit(s))
        return ~noise & ~any_of(line, phrases)

    return F.trim(F.array_join(F.filter(lines, good), "\n"))


def secured(content: Column, app: Column, blocked: tuple[str, ...], redact: bool = True, limit: int = 100_000) -> Column:
    """The content that may go on: none of a blocked application, without personal data, cut to the limit."""
    kept = F.when(~any_of(app, blocked), content)
    return F.substring(redact_pii(kept) if redact else kept, 1, limit)


def hash_base36(text: Column, points: bool = False) -> Column:
    """The 32-bit hash ``h * 31 + c`` over UTF-16 units of the text, or with ``points`` over its code points, signed, in base 36."""
    size = 4 if points else 2
    units = F.encode(text, "UTF-32" if points else "UTF-16BE")
    codes = F.transform(
        F.sequence(F.lit(1), F.floor(F.octet_length(units) / size).cast("int")),
        lambda i: F.conv(F.hex(F.substring(units, (size * i - size + 1).cast("int"), F.lit(size))), 16, 10).cast("long"),
    )
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    digits = F.lower(F.conv(F.abs(folded).cast("string"), 10, 36))
    return F.when(F.length(text) == 0, "0").otherwise(F.concat(F.when(folded < 0, "-").otherwise(""), digits))


def file_title(name: Column) -> Column:
    """The file's name without its extension, with spaces for ``_`` and ``-``."""
    return F.translate(F.regexp_replace(name, r"\.[^/.]+$", ""), "_-", "  ")
