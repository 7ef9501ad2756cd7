"""Regions of a page: boxes whose gaps are small on both axes, and their kinds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import SLICE_ROWS, bounded_batches

#: Gap below which boxes are neighbours.
GAP = 30.0
# Steps of columns, and limits of each kind of region.
COLUMN = 20.0
FIGURE_AREA, FIGURE_DENSITY, PLAIN_AREA, PLAIN_DENSITY = 50_000.0, 0.003, 100_000.0, 0.001
TABLE_WIDTH, TABLE_COLUMNS, HEADER_SHAPE, HEADER_PLACE, HEADER_BYTES = 200.0, 2, 0.3, 0.15, 100
CAPTION = r"(?i)^((figure|fig\.?|chart|graph|diagram)\s*\d+|(tableau|table)\s*\d+)"
LIST_ITEM = r"^\s*([•\-*]\s+|\d+[.)]\s+|[a-z][.)]\s+)"
KEY_VALUE = r"^[^:=]+[:=]\s*.+$"
CONFIDENCES = {"Figure": 0.8, "Table": 0.85, "Header": 0.9, "List": 0.75, "KeyValue": 0.7, "Text": 0.9}


#: Boxes of a page that are compared at once with others.
TILE, OTHERS = 512, 4096


def _components(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each box, in order of ``y``, the first box of its region.

    Tiles of boxes meet those that begin no further down than their reach, and links are joined by
    union-find, so memory does not grow with the square of a page.
    """
    parent = np.arange(len(x))
    for a in range(0, len(x), TILE):
        one = slice(a, a + TILE)
        stop = int(np.searchsorted(y, (y + h)[one].max() + GAP))
        for c in range(a, stop, OTHERS):
            two = slice(c, min(c + OTHERS, stop))
            across = np.maximum(x[one][:, None] - (x + w)[two][None, :], x[two][None, :] - (x + w)[one][:, None])
            down = np.maximum(y[one][:, None] - (y + h)[two][None, :], y[two][None, :] - (y + h)[one][:, None])
            i, j = np.nonzero((across < GAP) & (down < GAP))
            i, j = i + a, j + c
            while True:
                low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
                if (low == high).all():
                    break
                np.minimum.at(parent, high, low)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    return parent


def regions(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, region, content, boxes, columns, x, y, width, height`` of connected boxes, page by page.

    A page is what one recognition returns, and one task takes it, box by box with its neighbours;
    regions are numbered in order of their first box, and contents are read by lines of ten units, then from left to right. A column is a step
    of 20 units across in which two boxes begin.
    """

    target = arrow_regions()

    def cluster(page: pa.Table, out: list[tuple]) -> None:
        x, y, w, h = (page.column(c).to_numpy().astype(float) for c in ("x", "y", "width", "height"))
        order = np.lexsort((x, y))
        x, y, w, h = x[order], y[order], w[order], h[order]
        contents = page.column("content").to_pylist()
        label = _components(x, y, w, h)
        own = page.column("doc_id")[0].as_py(), page.column("page")[0].as_py()
        by_label = np.argsort(label, kind="stable")
        for n, at in enumerate(np.split(by_label, np.flatnonzero(np.diff(label[by_label])) + 1)):
            at = at[np.lexsort((x[at], np.round(y[at] / 10)))]
            left, top = x[at].min(), y[at].min()
            text = " ".join(contents[k] or "" for k in order[at].tolist())
            columns = int((np.unique(np.floor(x[at] / COLUMN), return_counts=True)[1] >= 2).sum())
            out.append((*own, n, text, len(at), columns, left, top, (x + w)[at].max() - left, (y + h)[at].max() - top))

    def flush(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches):
        """Pages one after another: rows come in order of document and page, and only the last page of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        last, out = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n) for n in (0, 1)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                for x in (key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()):
                    change[1:] |= x[1:] != x[:-1]
            ends = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                key = keys[0][a].as_py(), keys[1][a].as_py()
                if held and key != last:
                    cluster(pa.Table.from_batches(held), out)
                    held = []
                    if len(out) >= SLICE_ROWS:
                        yield flush(out)
                        out = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            cluster(pa.Table.from_batches(held), out)
        if out:
            yield flush(out)

    schema = "doc_id long, page int, region int, content string, boxes int, columns int, x double, y double, width double, height double"
    rows = boxes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "x", "y", "width", "height", "content")
    bounded_batches(boxes.sparkSession)
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(run, schema)


def arrow_regions() -> pa.Schema:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
    return pa.schema(list(zip(("doc_id", "page", "region", "content", "boxes", "columns", "x", "y", "width", "height"), kinds, strict=True)))


def region_kind(content: Column, y: Column, width: Column, height: Column, columns: Column, page_height: Column) -> Column:
    """Figure, Table, Header, List, KeyValue or Text, by area and density, columns, place and form; the first that fits."""
    area = width * height
    density = F.when(area == 0, 0.0).otherwise(F.octet_length(content) / F.nullif(area, F.lit(0.0)))
    lines = F.split(content, "\r?\n")

    def share(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)))) / F.size(lines)

    figure = (area >= FIGURE_AREA) & (density <= FIGURE_DENSITY) & (F.rlike(content, F.lit(CAPTION)) | ((density < PLAIN_DENSITY) & (area > PLAIN_AREA)))
    header = (y / page_height <= HEADER_PLACE) & (height / width <= HEADER_SHAPE) & (F.octet_length(content) < HEADER_BYTES) & (F.size(lines) <= 2)
    return (
        F.when(figure, "Figure")
        .when((width >= TABLE_WIDTH) & (columns >= TABLE_COLUMNS), "Table")
        .when(header, "Header")
        .when((F.size(lines) >= 2) & (share(LIST_ITEM) > 0.5), "List")
        .when((F.size(lines) >= 2) & (share(KEY_VALUE) > 0.6), "KeyValue")
        .otherwise("Text")
    )


def region_confidence(kind: Column) -> Column:
    out = F.lit(CONFIDENCES["Text"])
    for name, value in CONFIDENCES.items():
        out = F.when(kind == name, value).otherwise(out)
    return out
