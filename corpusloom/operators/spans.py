"""Source spans: lookups by position and range, explanations, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the smallest bins; those of each further level are twice as long.
BIN = 64
#: Levels, up to bins longer than any text.
LEVELS = 40


def level_of(start: Column, end: Column) -> Column:
    """The lowest level whose bins are as long as the range, so that it touches one or two of them."""
    size = F.greatest(end - start, F.lit(1))
    return F.greatest(F.ceil(F.round(F.log2(size / BIN), 9)), F.lit(0)).cast("int")


def _bins(start: Column, end: Column, levels: Column) -> Column:
    """``array<struct<level, bin>>``: the bins of each level that the half-open range touches, for levels no lower than its own."""
    last = F.greatest(end - 1, start)

    def at(level: Column) -> Column:
        width = F.lit(BIN) * F.pow(F.lit(2), level)
        pair = F.array_distinct(F.array(F.floor(start / width), F.floor(last / width)))
        return F.transform(pair, lambda n: F.struct(level.alias("level"), n.alias("bin")))

    return F.flatten(F.transform(levels, at))


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    """The levels that occur; at most ``LEVELS``."""
    return sorted(r.level for r in df.select(level_of(F.col(start), F.col(end)).alias("level")).distinct().collect())


def binned(df: DataFrame, start: str, end: str, others: list[int], above: bool) -> DataFrame:
    """One row for each bin, ``_level, _bin``, of its own level, or (``above``) of those of the ``others`` that are higher."""
    own = level_of(F.col(start), F.col(end))
    levels = F.array(own) if not above else F.filter(F.array(*map(F.lit, others)) if others else F.array().cast("array<int>"), lambda x: x > own)
    return df.withColumn("_at", F.explode(_bins(F.col(start), F.col(end), levels))).withColumns({"_level": F.col("_at.level"), "_bin": F.col("_at.bin")}).drop("_at")


def overlapping(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """``range_id, span_id`` where the spans ``[char_start, char_end)`` and ranges ``[lo, hi)`` of a document overlap; each pair once.

    Both lie in one or two bins of the level of their length. A pair meets in the level of the longer of
    the two: the shorter one also stands in one or two bins of each higher level that the other side has,
    so a span as long as its document is a row or two and not one for each bin of its length.
    """
    a, b = spans.select("doc_id", "span_id", "char_start", "char_end"), ranges.where("hi > lo").select("doc_id", "range_id", "lo", "hi")
    of_spans, of_ranges = _levels(a, "char_start", "char_end"), _levels(b, "lo", "hi")
    met = []
    same = binned(a, "char_start", "char_end", [], False)
    sides = [(same, binned(b, "lo", "hi", [], False))]
    if of_spans and of_ranges and of_spans[-1] > of_ranges[0]:
        sides.append((same, binned(b, "lo", "hi", of_spans, True)))
    if of_spans and of_ranges and of_ranges[-1] > of_spans[0]:
        sides.append((binned(a, "char_start", "char_end", of_ranges, True), binned(b, "lo", "hi", [], False)))
    for x, y in sides:
        both = x.join(y, ["doc_id", "_level", "_bin"]).where((F.col("char_start") < F.col("hi")) & (F.col("char_end") > F.col("lo")))
        # a pair that shares two bins is kept in the first
        first = F.floor(F.greatest("char_start", "lo") / (F.lit(BIN) * F.pow(F.lit(2), F.col("_level"))))
        met.append(both.where(F.col("_bin") == first).select("range_id", "span_id"))
    return reduce(DataFrame.unionByName, met)


def at_position(spans: DataFrame, positions: DataFrame) -> DataFrame:
    """``pos_id, span_id``: the first span (by start, then id) of the document that holds the position."""
    a = spans.select("doc_id", "span_id", "char_start", "char_end")
    levels = _levels(a, "char_start", "char_end")
    bins = _bins(F.col("pos"), F.col("pos") + 1, F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    b = positions.select("doc_id", "pos_id", "pos", F.explode(bins).alias("_at")).select("doc_id", "pos_id", "pos", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin"))
    met = binned(a, "char_start", "char_end", [], False).join(b, ["doc_id", "_level", "_bin"])
    held = met.where((F.col("pos") >= F.col("char_start")) & (F.col("pos") < F.col("char_end")))
    return held.groupBy("pos_id").agg(F.min_by("span_id", F.struct("char_start", "span_id")).alias("span_id"))


def valid_spans(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("char_start") < F.col("char_end")) & (F.length("content") > 0))


def span_stats(spans: DataFrame) -> DataFrame:
    """``spans, documents, mean_length``, and ``with_box`` if spans have a ``bbox``."""
    boxed = [F.count("bbox").alias("with_box")] if "bbox" in spans.columns else []
    return spans.agg(
        *boxed, F.count("*").alias("spans"), F.count_distinct("doc_id").alias("documents"), F.avg(F.col("char_end") - F.col("char_start")).alias("mean_length")
    )


def explain(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, chunk_idx, spans, confidence, coverage``: spans of the document that hold the chunk's text or lie in it.

    Coverage counts each span's characters that occur anywhere in the chunk, over the chunk's bytes,
    in percent; it can exceed 100.
    """
    met = chunks.select("doc_id", "chunk_idx", F.col("content").alias("chunk")).join(spans, "doc_id")
    held = met.where(F.contains("chunk", "content") | F.contains("content", "chunk"))
    common = F.size(F.filter(F.split("content", ""), lambda c: (c != "") & F.contains("chunk", c)))
    return held.groupBy("doc_id", "chunk_idx").agg(
        F.count("*").alias("spans"), F.avg("confidence").alias("confidence"),
        (F.sum(common) / F.octet_length(F.first("chunk")) * 100).alias("coverage"),
    )


def chunks_with_spans(chunks: DataFrame, span_ids: DataFrame) -> DataFrame:
    """Chunks that list any of the spans."""
    listed = chunks.select("chunk_id", F.explode("source_spans").alias("span_id")).join(span_ids, "span_id", "left_semi")
    return chunks.join(listed.select("chunk_id").distinct(), "chunk_id", "left_semi")


def with_source_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, chunk_idx, char_start, char_end, ...`` with ``source_spans``: the sorted ids of the spans that they overlap."""
    ranges = chunks.select("doc_id", F.struct("doc_id", "chunk_idx").alias("range_id"), F.col("char_start").alias("lo"), F.col("char_end").alias("hi"))
    found = overlapping(spans, ranges).groupBy("range_id").agg(F.sort_array(F.collect_list("span_id")).alias("source_spans"))  # the spans of one chunk
    named = found.select(F.col("range_id.doc_id").alias("_d"), F.col("range_id.chunk_idx").alias("_i"), "source_spans")
    nothing = F.expr("cast(array() as array<bigint>)")
    joined = chunks.join(named, (F.col("doc_id") == F.col("_d")) & (F.col("chunk_idx") == F.col("_i")), "left").drop("_d", "_i")
    return joined.withColumn("source_spans", F.coalesce("source_spans", nothing))


def layout_blocks(lines: DataFrame) -> DataFrame:
    """Running vertical position of lines of ``doc_id, n, height, gap``."""
    own = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("y", F.coalesce(F.sum(F.col("height") + F.col("gap")).over(own), F.lit(0)))
