"""Queries of the kept-up index and of top lists by bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import block_max, bm25, segments
from .queries import _INDEX
from .registry import batch, chunks, query, r6

_LEFT = _INDEX.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)")


@query(f"WITH {_LEFT} SELECT query_id, doc_id, round(sparse, 6) AS sparse FROM sparse")
def maintained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of an index after upserts and deletes: every seventh text replaces an old version, every tenth comes later, every eleventh is deleted."""
    docs, d = chunks(spark, sf_dir), F.col("doc_id")
    old = docs.where(d % 10 != 0).withColumn("content", F.when(d % 7 == 0, F.concat(F.lit("old "), F.substring("content", 1, 300))).otherwise(F.col("content")))
    index = segments.SegmentedIndex.empty(spark).upsert(old).upsert(docs.where((d % 10 == 0) | (d % 7 == 0))).delete(docs.where(d % 11 == 0).select("doc_id"))
    terms = bm25.query_terms(batch(spark, sf_dir))
    return bm25.bm25(terms, index.index(terms)).select("query_id", "doc_id", r6(F.col("sparse")).alias("sparse"))


@query(f"WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sparse, 9) DESC, doc_id) AS rank FROM sparse) SELECT query_id, doc_id, round(sparse, 6) AS score, rank FROM r WHERE rank <= 10")
def bounded_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of all scores, of which most ranges of documents are never scored."""
    terms = bm25.query_terms(batch(spark, sf_dir))
    found, _ = block_max.top_k(terms, block_max.build(bm25.build_index(chunks(spark, sf_dir), terms)))
    return found.select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))
