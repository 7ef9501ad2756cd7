"""Fill-in-the-middle transformation as one numpy kernel over the UTF-8 buffer of an Arrow batch.

Bytes are looked up in a table of classes; a unit starts where the classes of two adjacent bytes say
so. A cumulative sum over the starts, reset at each document by subtracting what stood before it,
numbers the units, and one ``searchsorted`` finds the cuts of all rows. Prefix, middle and suffix are
slices of the same buffer and are never copied before they are joined to the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded_batches, numbered, place_of

#: Bytes of text that one call of the kernel takes; a longer text is taken alone. The kernel needs about eight times as much.
KERNEL_BYTES = 8 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Units:
    """``classes[byte]`` is the class of a byte; a unit starts between bytes of the classes a and b where ``starts[a, b]``."""

    classes: np.ndarray
    starts: np.ndarray


def _units(members: bytes, pairs: tuple[tuple[int, int], ...]) -> Units:
    classes, starts = np.zeros(256, np.uint8), np.zeros((2, 2), bool)
    classes[list(members)] = 1
    for a, b in pairs:
        starts[a, b] = True
    return Units(classes, starts)


UNITS = {
    # [^\n]*\n|[^\n]+
    "lines": _units(b"\n", ((1, 0), (1, 1))),
    # a word with the white space behind it; white space at the very start of a text is a unit of its own
    "words": _units(b" \t\n\x0b\x0c\r", ((1, 0),)),
}


def unit_starts(data: np.ndarray, bounds: np.ndarray, units: Units) -> np.ndarray:
    """For each byte whether a unit starts there. ``bounds`` are the n + 1 limits of n documents."""
    kinds = units.classes[data]
    starts = np.empty(len(data), bool)
    starts[1:] = units.starts[kinds[:-1], kinds[1:]]
    firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
    starts[firsts] = True
    return starts


def _before(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a cumulative sum held before each position."""
    if not len(total):
        return np.zeros(len(at), np.int64)
    return np.where(at > 0, total[np.maximum(at, 1) - 1], 0).astype(np.int64)


def _holds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each document holds a marker, whole and inside its own bounds."""
    at = marker_places(data)
    row = np.searchsorted(bounds, at, side="right") - 1
    held = np.zeros(len(bounds) - 1, bool)
    held[row[at + 3 <= bounds[row + 1]]] = True
    return held


def marker_places(data: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    return at[np.isin(data[at + 1], list(b"PSM")) & (data[at + 2] == ord(">"))]


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Strings between neighbouring bounds, over the same bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def cut(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray, rate: int, spm: int, units: Units) -> dict[str, np.ndarray]:
    """Units, form, cuts (byte places) and code points of prefix and middle of all documents together.

    ``draws`` has four columns of unsigned 32-bit numbers.
    """
    begin, end = bounds[:-1], bounds[1:]
    total = np.cumsum(unit_starts(data, bounds, units), dtype=np.int32 if len(data) < 2**31 else np.int64)
    before = _before(total, begin)
    n = _before(total, end) - before
    drawn = draws[:, :2] % (n + 1)[:, None]
    cuts = []
    for k in (drawn.min(axis=1), drawn.max(axis=1)):
        # unit k of the document starts where the sum reaches one more than k and what stood before the document
        cuts.append(np.where(k < n, np.searchsorted(total, (before + k + 1).astype(total.dtype), side="left"), end))
    del total
    plain = (n == 0) | _holds(data, bounds) | (draws[:, 2] % 100 >= rate)
    points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32 if len(data) < 2**31 else np.int64)
    at = [_before(points, x) for x in (begin, *cuts)]
    return {
        "n": n,
        "form": np.where(plain, 0, np.where(draws[:, 3] % 100 < spm, 2, 1)),
        "first": cuts[0],
        "second": cuts[1],
        "prefix_chars": at[1] - at[0],
        "middle_chars": at[2] - at[1],
    }


def transform(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray, rate: int, spm: int, units: Units) -> list[pa.Array]:
    """Columns ``n, form, prefix_chars, middle_chars, output`` of a piece of a batch."""
    found = cut(data, bounds, draws, rate, spm, units)
    form, plain = found["form"], found["form"] == 0
    inner = np.empty(3 * len(plain) + 1, np.int64)
    inner[0:-1:3], inner[1::3], inner[2::3], inner[-1] = bounds[:-1], found["first"], found["second"], bounds[-1]
    pieces = _slices(data, inner)
    at, back = np.arange(0, 3 * len(plain), 3), form == 2  # the suffix comes first
    order = pa.array([PREFIX, SUFFIX], pa.large_string())
    joined = pc.binary_join_element_wise(
        order.take(pa.array(back * 1)), pieces.take(pa.array(at + 2 * back)), order.take(pa.array(1 - back)), pieces.take(pa.array(at + 2 * ~back)),
        _large(MIDDLE), pieces.take(pa.array(at + 1)), _large(""),
    )
    output = pc.if_else(pa.array(plain), _slices(data, bounds), joined)
    return [
        pa.array(found["n"]),
        pa.array([PLAIN, PSM, SPM]).take(pa.array(form)),
        pa.array(found["prefix_chars"], mask=plain),
        pa.array(found["middle_chars"], mask=plain),
        output.cast(pa.string()),
    ]


def rebuild(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> pa.Array:
    """The texts, from outputs and forms alone: a text that is not plain holds no marker, so its output holds three."""
    cut_up = form > 0
    at = marker_places(data)
    row = np.searchsorted(bounds, at, side="right") - 1
    at = at[cut_up[row] & (at + 3 <= bounds[row + 1])]
    if len(at) != 3 * cut_up.sum():
        raise ValueError("an output that is not plain must hold three markers")
    end = bounds[1:][cut_up]
    # before, first marker, first part, second marker, second part, third marker, third part of each such row
    edges = np.stack([at[0::3], at[0::3] + 3, at[1::3], at[1::3] + 3, at[2::3], at[2::3] + 3, end], axis=1)
    pieces = _slices(data, np.append(edges.ravel(), len(data)))
    first, second, middle = (pieces.take(pa.array(np.arange(k, 7 * len(end), 7))) for k in (1, 3, 5))
    psm = pa.array(form[cut_up] == 1)
    joined = pc.binary_join_element_wise(pc.if_else(psm, first, second), middle, pc.if_else(psm, second, first), _large(""))
    place = np.cumsum(cut_up) - 1
    return pc.if_else(pa.array(cut_up), joined.take(pa.array(np.where(cut_up, place, 0), mask=~cut_up)), _slices(data, bounds)).cast(pa.string())


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``from, to`` (rows), bytes and bounds of pieces of a string column of ``KERNEL_BYTES`` or of one row."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + KERNEL_BYTES, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the hex SHA-256 of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "lines", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row.

    Of 100 texts ``rate`` are cut, of these ``spm`` take the form that puts the suffix first. Cuts fall
    between units and depend on the id and the seed alone. A null text is empty; an empty text, and one
    that holds a marker, is plain: its output is the text and its lengths are null. Rows without an id
    draw as if it were empty. Repeated rows are kept, an empty table gives an empty one, and other
    columns, whatever their names, are not read.
    """
    units = UNITS[unit]
    bounded_batches(df.sparkSession)
    source = numbered(df)
    key, text = F.col(f"c{place_of(df, id_col)}").cast("long"), F.col(f"c{place_of(df, text_col)}").cast("string")
    rows = source.select(key.alias("doc_id"), text.alias("text"), *[c.alias(f"h{k}") for k, c in enumerate(draws(key, seed))])
    target = T.StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    schema = arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            for a, b, data, bounds in _parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *transform(data, bounds, drawn[a:b], rate, spm, units)], schema=schema)

    return rows.mapInArrow(run, target)


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output", out_col: str = "restored") -> DataFrame:
    """All rows and columns of ``df`` and ``restored``, the exact text, from the output and the form alone.

    A null output is empty, a null form plain. A column of the result's name, in any case, is replaced.
    """
    bounded_batches(df.sparkSession)
    kept = [n for n, c in enumerate(df.columns) if c.lower() != out_col.lower()]
    rows = numbered(df)
    code = F.coalesce(F.when(F.col(f"c{place_of(df, form_col)}") == PSM, 1).when(F.col(f"c{place_of(df, form_col)}") == SPM, 2), F.lit(0))
    rows = rows.select(*[f"c{n}" for n in kept], F.col(f"c{place_of(df, output_col)}").cast("string").alias("o"), code.alias("f"))
    target = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("restored", T.StringType())])
    schema, last = arrow_schema(target), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = batch.column(last + 1).to_numpy(zero_copy_only=False)
            for a, b, data, bounds in _parts(batch.column(last)):
                part = batch.slice(a, b - a)
                columns = [c.cast(f.type) for c, f in zip(part.columns[:last], schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, rebuild(data, bounds, form[a:b])], schema=schema)

    back = rows.mapInArrow(run, target)
    return back.toDF(*[df.columns[n] for n in kept], out_col)
