"""Figure and table captions, numeric lines, key-value pairs, blocks of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FIGURE = r"(?miu)^[ \t]*(Figure|Fig\.?|Graphique|Graph)\s+(\d+)[\.:–\-\s]+(.+?)$"
TABLE = r"(?miu)^[ \t]*(Table|Tableau|Tab\.?)\s+(\d+)[\.:–\-\s]+(.+?)$"
PAIRS = r"(?i)(accuracy|precision|recall|f1|compression|ratio|level|rate)[\s:=]+([0-9.]+\s*%?)"


def captions(text: Column) -> Column:
    """``array<struct<figure_id, kind, number, caption>>``: figures, then tables, in order of the text. Only line feeds end a line."""

    def of(pattern: str, table: bool) -> Column:
        parts = [F.regexp_extract_all(text, F.lit("(?d)" + pattern), F.lit(n)) for n in (1, 2, 3)]
        zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("word", "number", "rest"), strict=True)])

        def one(x: Column) -> Column:
            kind = F.lit("Table") if table else F.when(F.contains(F.lower(x["word"]), F.lit("graph")), "Graph").otherwise("Figure")
            name = F.concat(kind, F.lit(" "), x["number"])
            return F.struct(name.alias("figure_id"), kind.alias("kind"), x["number"].alias("number"), F.concat(name, F.lit(": "), F.regexp_replace(x["rest"], r"(?U)^\s+|\s+$", "")).alias("caption"))

        return F.transform(zipped, one)

    return F.concat(of(FIGURE, False), of(TABLE, True))


OCR_NOTE = "⚠️ Note: Data extracted via OCR from graphic. Verify visually for exact values."


def figure_chunks(pages: DataFrame) -> DataFrame:
    """Caption chunks of ``doc_id, page, text``, certain and of high priority, and with ``ocr_text`` the numbers of each figure's page.

    ``doc_id, page, figure_id, content, chunk_source, confidence, priority``. A page whose recognised text
    holds no number gives captions only.
    """
    ocr = numeric_lines(F.col("ocr_text")) if "ocr_text" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("doc_id", "page", ocr.alias("numbers"), F.inline(captions(F.col("text"))))
    page = (F.col("page") + 1).cast("string")
    caption = F.concat(F.lit("[FIGURE CAPTION - Page "), page, F.lit("]\n"), F.col("caption"))
    source = F.when(F.col("kind") == "Table", "Table").otherwise("FigureCaption")
    pairs = F.transform(key_values(F.col("numbers")), lambda p: F.concat(p["key"], F.lit(": "), p["value"]))
    listed = F.when(F.size(pairs) > 0, F.concat(F.lit("\n\nExtracted values:\n"), F.array_join(pairs, "\n"))).otherwise("")
    seen = F.concat(F.lit("[FIGURE OCR - "), F.col("figure_id"), F.lit(" - Page "), page, F.lit("]\n"), F.col("numbers"), listed, F.lit("\n\n" + OCR_NOTE))
    one = F.struct(caption.alias("content"), source.alias("chunk_source"), F.lit(1.0).alias("confidence"), F.lit(3).alias("priority"))
    two = F.when(F.trim("numbers") != "", F.struct(seen.alias("content"), F.lit("FigureRegionText").alias("chunk_source"), F.lit(0.7).alias("confidence"), F.lit(2).alias("priority")))
    return rows.select("doc_id", "page", "figure_id", F.inline(F.filter(F.array(one, two), lambda c: c.isNotNull())))


def figure_context(text: Column, caption: Column, around: int) -> Column:
    """The text from so many characters before the caption's first occurrence to as many after its end."""
    at = F.locate(caption, text) if isinstance(caption, str) else F.call_function("locate", caption, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(caption) + around))


def with_figures(body: DataFrame, figures: DataFrame) -> DataFrame:
    """Body chunks and figure chunks of documents as one set, numbered anew: body first, in order, then figures by page; those without an id come last."""
    from pyspark.sql import Window

    own = body.select("doc_id", F.lit(0).alias("_part"), F.col("chunk_idx").alias("_at"), "content", F.lit("Body").alias("chunk_source"), F.lit(None).cast("string").alias("figure_id"), "confidence")
    seen = figures.select("doc_id", F.lit(1).alias("_part"), F.col("page").alias("_at"), "content", "chunk_source", "figure_id", "confidence")
    order = Window.partitionBy("doc_id").orderBy("_part", "_at", F.asc_nulls_last("figure_id"), "chunk_source")
    return own.unionByName(seen).withColumn("chunk_idx", F.row_number().over(order) - 1).drop("_part", "_at")


def numeric_lines(text: Column) -> Column:
    kept = F.filter(F.split(text, "\r?\n"), lambda x: F.rlike(x, F.lit(r"[\p{N}%xX.,]")))
    return F.array_join(F.filter(F.transform(kept, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def key_values(text: Column) -> Column:
    """``array<struct<key, value>>``."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIRS), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(PAIRS), F.lit(2)).alias("value"))
    return F.transform(zipped, lambda x: F.struct(x["key"].alias("key"), F.trim(x["value"]).alias("value")))


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, text, confidence, has_table, has_header`` from blocks; reading order is y in steps of ten, then x."""
    placed = F.struct(F.round(F.col("y") / 10).alias("line"), F.col("x"), F.col("content"))
    held = blocks.groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list(placed)).alias("b"), F.avg("confidence").alias("confidence"),
        F.bool_or(F.col("block_type") == "Table").alias("has_table"), F.bool_or(F.col("block_type") == "Header").alias("has_header"),
    )
    return held.select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["content"]), "\n").alias("text"), "confidence", "has_table", "has_header")


def recognised_confidence(text: Column) -> Column:
    """Of recognised text: length, share of letters and digits, words, and noise."""
    total = F.nullif(F.length(text), F.lit(0))
    alnum = F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", ""))
    noise = F.length(F.regexp_replace(text, r"(?U)[\p{IsAlphabetic}\p{N}\s.,!?()\-:;\"']", ""))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.octet_length(w) > 2))
    score = 0.5 + F.least(F.octet_length(text) / 100.0, F.lit(0.3)) + alnum / total * 0.2 + F.least(words / 10.0, F.lit(0.2)) - noise / total * 0.3
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.lit(0.0))


def coalesce_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, text, confidence`` of pages with native and recognised text: native where it is not blank."""
    native = F.nullif(F.trim("native_text"), F.lit(""))
    text = F.coalesce(native, F.nullif(F.trim("ocr_text"), F.lit("")))
    confidence = F.when(native.isNotNull(), 0.95).otherwise(F.coalesce("ocr_confidence", F.lit(0.5)))
    parts = F.sort_array(F.collect_list(F.struct("page", text.alias("text"))))
    held = pages.groupBy("doc_id").agg(parts.alias("p"), F.avg(confidence).alias("confidence"))
    kept = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t.isNotNull())
    return held.select("doc_id", F.array_join(kept, "\n\n").alias("text"), "confidence")


def block_kind(line: Column) -> Column:
    """Figure, Table, List, Header, KeyValue, Amount or Text for a line."""
    amount = F.rlike(line, F.lit(r"^\s*[€$£]?\s*\d[\d\s.,]*\s*[€$£]?\s*$"))
    return (
        F.when(F.rlike(line, F.lit(r"(?i)^\s*(figure|fig\.|graph)\s*\d")), "Figure")
        .when((F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2) | F.contains(line, F.lit("\t")), "Table")
        .when(F.rlike(line, F.lit(r"^\s*([-*•]|\d+[.)])\s+")), "List")
        .when((F.length(line) < 80) & F.rlike(line, F.lit(r"^[\p{Lu}\d\s:.-]+$")) & F.rlike(line, F.lit(r"\p{Lu}")), "Header")
        .when(F.rlike(line, F.lit(r"^[^:]{2,40}:\s+\S")), "KeyValue")
        .when(amount, "Amount")
        .otherwise("Text")
    )
