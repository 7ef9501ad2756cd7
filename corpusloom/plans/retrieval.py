"""Ranked retrieval plans: vector search with metadata, hybrid search, answer context."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, numeric, text, vectors
from ..operators import bm25, pair_blocks, rerank, scoring
from ..storage import checkpointed, stored

def vector_search(queries: DataFrame, points: DataFrame, k: int = 10, min_score: float | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: exact cosine top-k; ``min_score`` filters after the top-k, so fewer may be left."""
    best = scoring.top_k(vectors.similar_pairs(queries, points, k), k)
    return best if min_score is None else best.where(F.col("score") >= min_score)


def hit_metadata(hits: DataFrame, categories: list[str] | None = None, business: bool = False, fiscal_year: int | None = None) -> DataFrame:
    """Hits with payload defaults, the category of their own content, and business facts of business hits.

    ``fiscal_year`` labels the period of indicators and filters nothing. Without categories and facts
    every hit is Mixed.
    """
    out = hits.withColumns({
        "content": F.coalesce("content", F.lit("")),
        "document_id": F.coalesce("document_id", F.lit("unknown")),
        "confidence": F.coalesce("confidence", F.lit(0.85)),
    })
    if categories or business:
        # stored, so that a filter on the category is not moved to the table of the texts, all of which would be classified
        out = stored(out.withColumn("category", classify.category(F.col("content"))), "hits")
    else:
        out = out.withColumn("category", F.lit("Mixed"))
    if categories:
        out = out.where(F.col("category").isin(categories))
    if business:
        facts = classify.business_metadata(F.col("content"), F.lit(fiscal_year).cast("int"))
        out = out.withColumn("business", F.when(F.col("category") == "Business", facts))
    return out


def hybrid_search(
    queries: DataFrame, docs: DataFrame, k: int = 10, pool: int = 20, dense: bool = False, prior: bool = False, intents: DataFrame | None = None
) -> DataFrame:
    """``query_id, doc_id, dense, sparse, keyword, hybrid, score, query_kind, has_match, rank``.

    Hybrid scores over all chunks; bibliography scores a tenth; queries about numbers put chunks whose
    numbers fit before others; a pool of the best. ``dense`` compares the ``embedding`` columns of both.
    With ``prior`` the best ``k`` of the pool pass the section prior, which drops contaminated ones and
    ranks by score alone. With ``intents (query_id, intent)`` the weights follow the query's intent.

    Blocks of queries meet blocks of chunks twice: for the ranges of the scores, and for the best of
    each query. No pair below the lists is written. Chunks and queries without an id are left out.
    """
    queries, docs = queries.where("query_id is not null"), docs.where("doc_id is not null")
    best_of = pool if prior else k
    asked = checkpointed(queries.select("query_id", numeric.query_kind(F.col("query")).alias("query_kind"), numeric.constraints(F.col("query")).alias("_wanted")))
    keep = {"listed": rerank.is_bibliography(F.coalesce("content", F.lit("")))} | ({"embedding": F.col("embedding").cast("array<double>")} if dense else {})
    lists = []
    for block, terms in _query_blocks(queries):
        index = bm25.build_index(docs, terms, inside=True, keep=keep)
        lists.append(_best_pairs(block, docs, terms, index, asked, best_of, dense, intents))
    best = scoring.top_k(reduce(DataFrame.unionByName, lists), best_of, first="has_match")
    best = best.join(asked.select("query_id", "query_kind"), "query_id")
    if prior:
        sources = docs.select("doc_id", "content", F.col("source_type") if "source_type" in docs.columns else F.lit("Document Text").alias("source_type"))
        best = rerank.section_rerank(best.where(F.col("rank") <= k).drop("rank").join(sources, "doc_id"))
        best = scoring.top_k(best, k)
    return best.select("query_id", "doc_id", "dense", "sparse", "keyword", "hybrid", "score", "query_kind", "has_match", "rank")


def _query_blocks(queries: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Queries and their terms, in blocks that every task can hold."""
    terms = checkpointed(bm25.query_terms(queries))
    blocks = max(-(-queries.count() // vectors.SENT_QUERIES), -(-terms.count() // bm25.SENT_TERMS), 1)
    if blocks == 1:
        return [(queries, terms)]
    blocks *= 2  # parts by a hash are not quite equal
    own = lambda df, n: df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
    return [(own(queries, n), own(terms, n)) for n in range(blocks)]


def _best_pairs(queries: DataFrame, docs: DataFrame, terms: DataFrame, index: bm25.Index, asked: DataFrame, k: int, dense: bool, intents: DataFrame | None) -> DataFrame:
    """``query_id, doc_id, dense, sparse, keyword, hybrid, score, has_match``: the best of each query in each block of chunks."""
    spark = docs.sparkSession
    kind = queries.schema["query_id"].dataType
    ids = sorted(r.query_id for r in queries.select("query_id").distinct().collect())  # a block
    top = bm25.technical_terms(queries, bm25.index_idf(index), 5)
    own = bm25.scorer(terms, index, top, queries.select("query_id", "embedding") if dense else None, ids)
    sent, held = spark.sparkContext.broadcast(own), index.held
    weights = np.array([scoring.WEIGHTS["Mixed"]] * len(ids)).reshape(len(ids), 3)
    if intents is not None:
        named = {r.query_id: r.intent for r in intents.join(queries.select("query_id"), "query_id", "left_semi").collect()}
        weights = np.array([scoring.WEIGHTS.get(named.get(q), scoring.WEIGHTS["Mixed"]) for q in ids]).reshape(len(ids), 3)
    columns = ", ".join(f"{s}_{n} double" for n in pair_blocks.NAMES for s in ("low", "high"))
    rows = held.mapInArrow(lambda batches: pair_blocks.ranges(batches, sent.value), f"q long, {columns}")
    sums = [f(f"{s}_{n}").alias(f"{s}_{n}") for n in pair_blocks.NAMES for s, f in (("low", F.min), ("high", F.max))]
    found = {r.q: r for r in rows.groupBy("q").agg(*sums).collect()}  # one row a query
    scale = {f"{s}_{n}": np.array([found[q][f"{s}_{n}"] if q in found else 0.0 for q in range(len(ids))]) for n in pair_blocks.NAMES for s in ("low", "high")}
    names = F.broadcast(spark.createDataFrame([(q, n) for n, q in enumerate(ids)], T.StructType([T.StructField("query_id", kind), T.StructField("q", T.IntegerType())])))
    digits = asked.join(names, "query_id").where(F.col("query_kind").isin("DigitAtomic", "DigitCombined")).select("q", F.inline("_wanted"))
    if digits.isEmpty():
        held = held.withColumn("fits", F.array().cast("array<int>"))
    else:
        numbers = docs.select(F.col("doc_id").cast("long").alias("_d"), F.inline(F.array_distinct(numeric.values(F.col("content")))))
        fitting = numbers.join(F.broadcast(digits.withColumnRenamed("unit", "_unit")), F.col("unit") == F.col("_unit"))
        fitting = fitting.where(numeric.meets(F.struct("value", "unit"), F.struct("op", "low", "high", F.col("_unit").alias("unit"))))
        held = held.join(fitting.groupBy("_d").agg(F.collect_set("q").alias("fits")), F.col("doc_id") == F.col("_d"), "left")  # at most the block's queries
        held = held.withColumn("fits", F.coalesce("fits", F.array().cast("array<int>")))
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), *((c, pa.float64()) for c in (*pair_blocks.NAMES, "hybrid", "score")), ("has_match", pa.bool_())])
    read = ["doc_id", "dl", "at", "tf", "inside", "listed", "fits", *(["embedding"] if dense else [])]
    lists = held.select(*read).mapInArrow(
        lambda batches: pair_blocks.best(batches, sent.value, scale, weights, k, schema), "q long, doc_id long, dense double, sparse double, keyword double, hybrid double, score double, has_match boolean"
    )
    return lists.join(names, "q").drop("q").select("query_id", "doc_id", *pair_blocks.NAMES, "hybrid", "score", "has_match")


def query_intents(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, intent``: ExactPhrase, Conceptual or Mixed, by the query's words and the idf of its three leading terms."""
    index = bm25.build_index(docs, bm25.query_terms(queries))
    top = bm25.technical_terms(queries, bm25.index_idf(index), 3).groupBy("query_id").agg((F.max("idf") > 2.5).alias("high"))
    known = queries.join(top, "query_id", "left")
    return known.select("query_id", classify.search_intent(F.col("query"), F.coalesce("high", F.lit(False)), F.size(text.term_tokens(F.col("query")))).alias("intent"))


def context_block(rank: Column, label: Column, page: Column, confidence: Column, content: Column) -> Column:
    """One source of the answer context."""
    head = F.format_string("### Source %d - %s (Page %s, Confidence: %d%%)\n", rank, label, F.coalesce(page.cast("string"), F.lit("?")), F.round(confidence * 100).cast("int"))
    return F.concat(head, F.when(F.length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("..."))).otherwise(content))


def answer_context(ranked: DataFrame) -> DataFrame:
    """``query_id, context, sources``: the ranked chunks of each query as one text, in order of rank."""
    block = F.struct("rank", context_block(F.col("rank"), F.col("label"), F.col("page"), F.col("score"), F.col("content")).alias("block"))
    held = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(block)).alias("b"))  # a bounded top list
    return held.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.size("b").alias("sources"))


def response_confidence(ranked: DataFrame) -> DataFrame:
    """``query_id, confidence``: mean confidence weighted by score; 0 without weight."""
    total = F.sum("score")
    return ranked.groupBy("query_id").agg(F.coalesce(F.sum(F.col("score") * F.col("confidence")) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("confidence"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``query_id, recall``: the share of the exact top-k that was found."""
    good = exact.where(F.col("rank") <= k).select("query_id", "doc_id")
    hit = good.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def previous_ranks(ranked: DataFrame) -> DataFrame:
    """Adds the score gap to the next better row."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("gap", F.lag("score").over(order) - F.col("score"))
