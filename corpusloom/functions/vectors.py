"""Vector functions on arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import bounded_batches


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    """0 where lengths differ."""
    total = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(F.coalesce(dot(a, b) / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-6, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hashed_embedding(dims: int = 64):
    """A stand-in for a model of static word vectors, as a function of a text column.

    The mean of signed one-hot vectors of hashed words (MD5), normalised. Hashing and summing per text
    is Arrow-batched, because a column expression would be copied into every product that uses it.
    """

    def embed(texts: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for t in texts:
            slots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in (t or "").lower().split()], dtype=np.int64) % (2 * dims)
            v = np.bincount(slots % dims, weights=np.where(slots < dims, 1.0, -1.0), minlength=dims) if len(slots) else np.zeros(dims)
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n > 1e-6 else v).tolist())
        return pd.Series(out)

    return F.pandas_udf(embed, T.ArrayType(T.DoubleType()))


def query_text(query: Column) -> Column:
    """What is embedded for a query."""
    return F.concat(F.lit("query: "), F.coalesce(query, F.lit("")))


def passage_text(content: Column) -> Column:
    """What is embedded for a chunk."""
    return F.concat(F.lit("passage: "), F.coalesce(content, F.lit("")))


#: Most queries whose vectors travel to every task; more go in blocks.
SENT_QUERIES = 10_000
#: Points that are compared with the queries at once in a task.
BLOCK = 4096
#: Scores of queries with points that a task holds at once.
CELLS = 1 << 20


def _unit(arrays: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of an array of vectors by their length: numbers of the rows, and the vectors at length 1 (or 0)."""
    sizes = np.diff(arrays.offsets.to_numpy())
    sizes[np.asarray(arrays.is_null())] = 0
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        x = np.asarray(arrays.take(pa.array(at)).flatten().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), n)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[n] = (at, np.divide(x, length, out=np.zeros_like(x), where=length > 0))
    return out


def _first(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the ``k`` greatest values of each row, of equal ones the first; ``k`` is below the row's length."""
    least = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k, None]
    above, equal = values > least, values == least
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal)


def similar_pairs(queries: DataFrame, points: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, doc_id, score``: cosines of ``embedding`` columns by products of matrices of unit vectors.

    Each block of points keeps the best ``k`` of each query (all without it; ties by id), so only these
    go on to a ranking. Vectors of other lengths, null or of norm 0 have a cosine of 0. Ids are numbers.
    The queries' vectors are sent to every task in blocks of ``SENT_QUERIES``, each of which meets all points.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = points.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = asked.limit(SENT_QUERIES + 1).collect()
    if len(rows) > SENT_QUERIES:
        parts = 2 * -(-asked.count() // SENT_QUERIES)  # parts by a hash are not quite equal
        own = F.pmod(F.xxhash64("query_id", F.lit(parts)), F.lit(parts))
        return reduce(DataFrame.unionByName, [_similar_to(asked.where(own == n).collect(), held, k) for n in range(parts)])
    return _similar_to(rows, held, k)


def _similar_to(rows: list, held: DataFrame, k: int | None) -> DataFrame:
    """:func:`similar_pairs` of a block of queries."""
    ids = np.array([r.query_id for r in rows], dtype=np.int64)
    sent = held.sparkSession.sparkContext.broadcast((ids, _unit(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                doc, arrays = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                order = np.argsort(doc, kind="stable")
                parts = _unit(pa.concat_arrays([arrays]))
                # a part of the queries at a time, so that memory does not grow with them
                for first in range(0, len(ids), max(CELLS // max(len(doc), 1), 1)):
                    some = slice(first, first + max(CELLS // max(len(doc), 1), 1))
                    scores = np.zeros((len(ids[some]), len(doc)))
                    for n, (rows, x) in parts.items():
                        if n in known:
                            own, q = known[n]
                            a, b = np.searchsorted(own, [first, some.stop])
                            scores[np.ix_(own[a:b] - first, rows)] = np.round(q[a:b] @ x.T, 12)
                    if k is None or k >= len(doc):
                        q, d = np.repeat(np.arange(len(scores)), len(doc)), np.tile(np.arange(len(doc)), len(scores))
                    else:
                        q, d = _first(np.nan_to_num(np.round(scores[:, order], 9), nan=-np.inf), k)  # the order of the ranking
                        d = order[d]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][q]), pa.array(doc[d]), pa.array(scores[q, d])], schema=schema)

    bounded_batches(held.sparkSession)
    return held.mapInArrow(run, "query_id long, doc_id long, score double")
