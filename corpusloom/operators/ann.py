"""Approximate vector search by product quantisation: short codes are scanned, and the best candidates compared exactly.

A vector's dimensions are split into parts, each of which is named by the nearest of 256 centroids of
that part. A query has the products of its parts with all centroids, so a code's score is a sum of
looked-up numbers, and only the candidates' own vectors are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import scoring

#: Points that the centroids are fitted on, at most (those with the smallest hash of their id); all points are coded.
FIT_POINTS = 20_000
#: Queries whose tables are sent at once, and codes that are compared with them at once in a task.
SENT_QUERIES, BLOCK = 1000, 4096
#: Centroids of a part; a code has a byte a part.
CODES = 256


def fit_codebook(points: DataFrame, parts: int = 32, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """``parts`` by at most ``CODES`` by dimensions of a part: centroids by k-means, on a bounded sample of ``points (doc_id, embedding)`` at length 1.

    The length of the sample's vectors must be a multiple of ``parts``; without a vector there are no centroids.
    """
    sample = points.where("embedding is not null").select("embedding").orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(FIT_POINTS).collect()
    x = np.array([r.embedding for r in sample], dtype=np.float64)
    if not x.size:
        return np.zeros((parts, 0, 1))
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(len(x), parts, -1)
    first = np.random.default_rng(seed).permutation(len(x))[:CODES]
    book = x[first].transpose(1, 0, 2).copy()
    for m in range(parts):
        own = x[:, m]
        for _ in range(rounds):
            nearest = _nearest(own, book[m])
            n = np.bincount(nearest, minlength=book.shape[1])
            sums = np.stack([np.bincount(nearest, weights=own[:, d], minlength=book.shape[1]) for d in range(own.shape[1])], axis=1)
            book[m] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book[m])
    return book


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def encode(points: DataFrame, book: np.ndarray) -> DataFrame:
    """``doc_id, code binary`` of the points whose vectors have the book's dimensions; others are left out."""
    sent = points.sparkSession.sparkContext.broadcast(book)
    schema = pa.schema([("doc_id", pa.int64()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        dims = c.shape[0] * c.shape[2]
        for batch in batches if c.shape[1] else ():
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, x = vectors._unit(pa.concat_arrays([part.column(1)])).get(dims, (np.zeros(0, np.int64), np.zeros((0, dims))))
                x = x.reshape(len(rows), c.shape[0], c.shape[2])
                codes = np.stack([_nearest(x[:, m], c[m]) for m in range(c.shape[0])], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in codes], pa.binary())], schema=schema)

    rows = points.where("doc_id is not null and embedding is not null").select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "doc_id long, code binary")


def candidates(queries: DataFrame, codes: DataFrame, book: np.ndarray, most: int) -> DataFrame:
    """``query_id, doc_id, score``: for each query the ``most`` codes of the greatest products, over all ``codes`` of :func:`encode`.

    Queries go in blocks of ``SENT_QUERIES``; each block of codes keeps ``most`` of each query.
    """
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = asked.limit(SENT_QUERIES + 1).collect()
    blocks = [rows]
    if len(rows) > SENT_QUERIES:
        parts = 2 * -(-asked.count() // SENT_QUERIES)  # parts by a hash are not quite equal
        blocks = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n).collect() for n in range(parts)]
    found = [_scan(rows, codes, book, most) for rows in blocks]
    return scoring.top_k(reduce(DataFrame.unionByName, found), most)


def _scan(rows: list, codes: DataFrame, book: np.ndarray, most: int) -> DataFrame:
    parts, size, width = book.shape
    rows = [r for r in rows if len(r.embedding) == parts * width]
    x = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), parts * width)
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(len(rows), parts, width)
    tables = np.einsum("qmd,mkd->mqk", x, book).astype(np.float32)  # a part's products with its centroids
    sent = codes.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows], dtype=np.int64), tables))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = sent.value
        for batch in batches if len(ids) else ():
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                doc = part.column(0).to_numpy()
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(doc), len(tables))
                scores = np.zeros((len(ids), len(doc)), np.float32)
                for m in range(code.shape[1]):
                    scores += tables[m][:, code[:, m]]
                k = min(most, len(doc))
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(ids)), k)
                d = best.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(doc[d]), pa.array(scores[q, d].astype(np.float64))], schema=schema)

    return codes.mapInArrow(run, "query_id long, doc_id long, score double")


def approximate_search(queries: DataFrame, points: DataFrame, codes: DataFrame, book: np.ndarray, k: int = 10, most: int = 50) -> DataFrame:
    """``query_id, doc_id, score, rank``: of the ``most`` candidates of each query the best ``k`` by exact cosine.

    ``codes`` are :func:`encode` of the points, stored once; only candidates meet their vectors. Queries
    and points without a vector of the book's dimensions have no hits.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("_q"))
    met = candidates(queries, codes, book, most).select("query_id", "doc_id").join(asked, "query_id")
    exact = met.join(points.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").alias("_p")), "doc_id")
    return scoring.top_k(exact.select("query_id", "doc_id", F.round(vectors.cosine(F.col("_q"), F.col("_p")), 12).alias("score")), k)
