"""Ingest: texts to searchable chunks with metadata, in one pass over the documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text, vectors
from ..operators import chunking, collections
from ..storage import sliced

CHUNKS = "doc_id long, chunk_idx int, content string, confidence double"


def cut(docs: DataFrame, carried: list[str], method_col: str = "method", size: int = 384, overlap: int = 48) -> DataFrame:
    """``doc_id, chunk_idx, content, confidence`` and the carried columns, by each row's way of extraction, with the ladder of fallbacks."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for pdf in sliced(batches):
            rows = []
            for key, body, method, *more in pdf.itertuples(index=False):
                body = body or ""
                chunker = chunking.sentence_chunks if chunking.DISPATCH.get(method, "sentences") == "sentences" else chunking.paragraph_chunks
                for n, (content, confidence) in enumerate(chunking.with_fallbacks(body, list(chunker(body, size, overlap)), size, overlap)):
                    rows.append((key, n, content, confidence, *more))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "content", "confidence", *carried])

    schema = ", ".join([CHUNKS, *[f"{c} {kinds[c]}" for c in carried]])
    return docs.select("doc_id", "text", F.col(method_col).alias("method"), *carried).mapInPandas(run, schema)


def ingest(docs: DataFrame, group_id: str = "default", dims: int = 64, classified: bool = True) -> DataFrame:
    """Chunks of ``docs (doc_id, text, lang)``: normalised, cut, classified, embedded, with ids from ids.

    ``chunk_id, doc_id, group_id, chunk_idx, content, chunk_type, category, confidence, hash, language, embedding``.
    Nothing is shuffled: the category of the whole document travels with its row. Without ``classified``,
    for readers that take neither, categories are null and no document is searched for their patterns.
    """
    normal = docs.select("doc_id", text.normalize_for_rag(F.coalesce("text", F.lit(""))).alias("text"), F.col("lang").alias("language"), F.lit("DirectRead").alias("method"))
    embed = vectors.hashed_embedding(dims)
    category = classify.category(F.col("text")) if classified else F.lit(None).cast("string")
    rows = cut(normal.withColumn("category", category), ["category", "language"])
    return rows.where(collections.embeddable(F.col("content"))).select(
        F.concat_ws(":", "doc_id", "chunk_idx").alias("chunk_id"), "doc_id", F.lit(group_id).alias("group_id"), "chunk_idx", "content",
        chunking.chunk_type(F.col("content")).alias("chunk_type"), "category", "confidence", F.sha2("content", 256).alias("hash"), "language",
        embed(vectors.passage_text(F.col("content"))).alias("embedding"),
    )


def document_metadata(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunks, category, confidence, language`` of ingested documents."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.first("category").alias("category"), F.avg("confidence").alias("confidence"), F.first("language").alias("language")
    )


def write_collection(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """A collection as Parquet, one folder a group, so a search of a group reads its folder only."""
    chunks.write.mode(mode).partitionBy("group_id").parquet(path)
