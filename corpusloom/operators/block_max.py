"""Top lists of BM25 without scoring all pairs: weights by ranges of documents, and bounds that leave most of them unread.

A range of documents has for each term the largest weight that any of them gives it, so a query's sum of
these bounds all scores in the range. The ranges of the greatest bounds are scored first, which gives
each query a score that its list has at least; then only ranges whose bound reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, stored
from . import bm25, pair_blocks, scoring, term_batches

#: Ids of a range.
RANGE = 3
#: Scores are compared by nine decimals, so a bound may be that much below.
SLACK = 1e-8


@dataclass(frozen=True)
class BlockMax:
    """``rows (range, doc_id, dl, at, tf)``, one a document, lie in order of ranges; None for an index of more terms than are sent to tasks."""

    index: bm25.Index
    size: int
    k1: float
    b: float
    rows: DataFrame | None


def build(index: bm25.Index, size: int = RANGE, k1: float = bm25.K1, b: float = bm25.B) -> BlockMax:
    rows = None
    if index.held is not None:
        rows = index.held.select(F.floor(F.col("doc_id") / size).alias("range"), "doc_id", "dl", "at", "tf")
        rows = stored(rows.repartitionByRange("range").sortWithinPartitions("range"), "ranges")
    return BlockMax(index, size, k1, b, rows)


class _Part:
    """Documents of an Arrow batch: the weights of their terms, their ranges, and the bounds of all queries in these.

    A range that lies in several batches has a bound in each of them, which holds for its documents there.
    """

    def __init__(self, own: pair_blocks.Scorer, part: pa.RecordBatch) -> None:
        self.own, self.docs = own, pair_blocks.doc_ids(part.column("doc_id"))
        self.size, queries, terms = part.num_rows, len(own.ids), len(own.weights)
        sizes, values = term_batches._lists(part.column("at"))
        self.row, self.term = np.repeat(np.arange(self.size), sizes), np.asarray(values).astype(np.int64)
        tf = np.asarray(term_batches._lists(part.column("tf"))[1]).astype(np.float64)
        norm = 1.0 - own.b + own.b * part.column("dl").to_numpy().astype(np.float64) / own.mean
        self.weight = own.weights[self.term] * tf * (own.k1 + 1.0) / (tf + own.k1 * norm[self.row])
        ranges = pair_blocks.doc_ids(part.column("range"))
        first = np.concatenate([[True], ranges[1:] != ranges[:-1]])
        self.ranges, self.place = ranges[first], np.cumsum(first) - 1
        key = self.place[self.row] * terms + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.weight[order], starts) if len(key) else np.zeros(0)
        met, self.bound = own.words.sums(key[starts] // terms, key[starts] % terms, most, len(self.ranges), queries) if len(key) else np.zeros((2, len(self.ranges), queries))
        self.met = met > 0

    def asked(self, first: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which of the ranges and queries ``first`` (sorted ranges, and a query of each) names."""
        out = np.zeros(self.met.shape, bool)
        low, high = (np.searchsorted(first[0], self.ranges, side=s) for s in ("left", "right"))
        n = high - low
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        out[np.repeat(np.arange(len(n)), n), first[1][at]] = True
        return out

    def postings(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries of documents and terms with each place in the queries' terms that has the term, a bounded number at once."""
        words = self.own.words
        for a, b in term_batches.bounded(words.counts[self.term[entries]], term_batches.ENTRIES):
            yield term_batches.expand(entries[a:b], self.term[entries[a:b]], words.starts, words.counts, np.arange(len(words.query)))

    def scored(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, doc, score`` in the ranges of ``mask``; others are not scored."""
        words, queries = self.own.words, mask.shape[1]
        sums, hit = np.zeros(self.size * queries), np.zeros(self.size * queries, bool)
        for entry, at in self.postings(np.flatnonzero(mask.any(axis=1)[self.place[self.row]])):
            keep = mask[self.place[self.row[entry]], words.query[at]]
            entry, at = entry[keep], at[keep]
            cell = self.row[entry] * queries + words.query[at]
            sums += np.bincount(cell, weights=words.values[0][at] * self.weight[entry], minlength=len(sums))
            hit[cell] = True
        cell = np.flatnonzero(hit)
        return cell % queries, self.docs[cell // queries], sums[cell]

    def read(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many postings of each query lie in the ranges of ``mask``, and in all."""
        out = np.zeros((2, mask.shape[1]), np.int64)
        for entry, at in self.postings(np.arange(len(self.row))):
            q = self.own.words.query[at]
            for x, own in zip(out, (q[mask[self.place[self.row[entry]], q]], q), strict=True):
                x += np.bincount(own, minlength=len(x))
        return out[0], out[1]


def top_k(terms: DataFrame, blocks: BlockMax, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``query_id, doc_id, score, rank``: the list of all scores, ties by id; and ``query_id, read, postings``: how many postings were scored, of all that the query has.

    ``terms (query_id, term, qtf)`` are terms of the index. Bounds and scores are matrices of a batch; a
    task holds one batch and the best of each query, and tells no more than these.
    """
    if blocks.rows is None or (asked := bm25._sent(terms)) is None:
        return _joined_top_k(terms, blocks, k)
    context = blocks.rows.sparkSession.sparkContext
    own = bm25.scorer(asked, blocks.index, k1=blocks.k1, b=blocks.b)
    sent, kind = context.broadcast(own), terms.schema["query_id"].dataType
    ids = {q: n for n, q in enumerate(own.ids)}

    def passed(column: str, each) -> DataFrame:
        """The best of what ``each`` gives of a part: query, id or range, score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            own = sent.value
            best = pair_blocks.Best(len(own.ids), k)
            for batch in batches if own.ids else ():
                for part in own.parts(batch):
                    best.add(*each(_Part(own, part)))
            yield pa.RecordBatch.from_arrays(best.columns(own.names(to_arrow_type(kind))), names=["query_id", column, "score"])

        return blocks.rows.mapInArrow(run, f"query_id {kind.simpleString()}, {column} long, score double")

    def bounds(part: _Part):
        at, q = np.nonzero(part.met)
        return q, part.ranges[at], part.bound[at, q]

    # every range with a bound has a document with a score, so k of them give a list of k
    best = scoring.top_k(passed("range", bounds), k, tie="range").collect()  # a few a query
    named = sorted((pair_blocks.NO_ID if r.range is None else r.range, ids[r.query_id]) for r in best)
    first = context.broadcast(tuple(np.array(c, dtype=np.int64) for c in (zip(*named, strict=True) if named else ((), ()))))
    found = scoring.top_k(passed("doc_id", lambda part: part.scored(part.asked(first.value))), k).where(F.col("rank") == k).collect()
    ends = np.full(len(own.ids), -np.inf)
    for r in found:
        ends[ids[r.query_id]] = r.score
    least = context.broadcast(ends)

    def open_(part: _Part) -> np.ndarray:
        return part.met & (part.bound >= least.value - SLACK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = sent.value
        read = np.zeros((2, len(own.ids)), np.int64)
        for batch in batches if own.ids else ():
            for part in own.parts(batch):
                one = _Part(own, part)
                read += one.read(open_(one) | one.asked(first.value))
        yield pa.RecordBatch.from_arrays([own.names(to_arrow_type(kind)), *map(pa.array, read)], names=["query_id", "read", "postings"])

    share = blocks.rows.mapInArrow(count, f"query_id {kind.simpleString()}, read long, postings long").groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))
    return scoring.top_k(passed("doc_id", lambda part: part.scored(open_(part))), k), share.where("postings > 0")


def _scored(asked: DataFrame, terms: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` in the ranges that are ``asked (query_id, range)``."""
    wanted = asked.join(terms, "query_id")
    return wanted.join(weights, ["range", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def _joined_top_k(terms: DataFrame, blocks: BlockMax, k: int) -> tuple[DataFrame, DataFrame]:
    """The same by joins, for more terms than are sent to tasks."""
    index = blocks.index
    norm = 1.0 - blocks.b + blocks.b * F.col("dl") / max(index.mean_length, 1e-9)
    weight = bm25.idf(index.rows, F.col("df")) * F.col("tf") * (blocks.k1 + 1.0) / (F.col("tf") + blocks.k1 * norm)
    weights = index.postings.join(index.frequencies, "term").select(F.floor(F.col("doc_id") / blocks.size).alias("range"), "term", "doc_id", weight.alias("weight"))
    weights = stored(weights.repartitionByRange("range").sortWithinPartitions("range", "term"), "weights")
    maxima = stored(weights.groupBy("range", "term").agg(F.max("weight").alias("most")), "maxima")
    bounds = maxima.join(terms, "term").groupBy("query_id", "range").agg(F.sum(F.col("qtf") * F.col("most")).alias("bound"))
    bounds = stored(bounds, "bounds")
    # every range with a bound has a document with a score, so k of them give a list of k
    first = checkpointed(scoring.top_k(bounds, k, "bound", tie="range").select("query_id", "range"))
    found = checkpointed(scoring.top_k(_scored(first, terms, weights), k))
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    rest = checkpointed(open_.select("query_id", "range").join(first, ["query_id", "range"], "left_anti"))
    best = scoring.top_k(found.drop("rank").unionByName(_scored(rest, terms, weights)), k)
    held = checkpointed(weights.groupBy("range", "term").agg(F.count("*").alias("n")).join(terms, "term").groupBy("query_id", "range").agg(F.sum("n").alias("n")))
    seen = first.unionByName(rest).withColumn("seen", F.lit(True))
    share = held.join(seen, ["query_id", "range"], "left").groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("seen"), F.col("n"))), F.lit(0)).alias("read"), F.sum("n").alias("postings"))
    return best, share
