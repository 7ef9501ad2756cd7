"""Scores of a block of documents with a block of queries as matrices.

A document's row of the index holds all that its scores need, so blocks of rows meet the queries where
they lie. What leaves a block are pairs with a score, ranges of scores, or the best of each query, and
never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import vectors
from . import term_batches

#: Sums that a block of scores holds at once.
CELLS = 1 << 20
NAMES = ("dense", "sparse", "keyword")


class Lookup:
    """For each term the queries that have it, with the numbers they add."""

    def __init__(self, size: int, rows: list[tuple], kinds: int) -> None:
        """``rows``: a term's place, a query's place, and ``kinds`` numbers."""
        columns = [np.array(c, dtype=np.float64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * (2 + kinds)
        order = np.argsort(columns[0], kind="stable")
        own = columns[0][order].astype(np.int64)
        self.starts = np.searchsorted(own, np.arange(size))
        self.counts = np.bincount(own, minlength=size).astype(np.int64)
        self.query = columns[1][order].astype(np.int64)
        self.values = [c[order] for c in columns[2:]]

    def sums(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray | None, rows: int, queries: int) -> list[np.ndarray]:
        """The number of terms that have met, and the sum of each kind of number, as matrices of rows by queries."""
        out = [np.zeros(rows * queries, np.int64), *(np.zeros(rows * queries) for _ in self.values)]
        for a, b in term_batches.bounded(self.counts[term], term_batches.ENTRIES):
            entry, at = term_batches.expand(np.arange(a, b), term[a:b], self.starts, self.counts, np.arange(len(self.query)))
            if not len(entry):
                continue
            # rows lie in order
            first, last = int(row[entry[0]]), int(row[entry[-1]]) + 1
            cell, own = (row[entry] - first) * queries + self.query[at], slice(first * queries, last * queries)
            size = (last - first) * queries
            out[0][own] += np.bincount(cell, minlength=size)
            for x, v in zip(out[1:], self.values, strict=True):
                x[own] += np.bincount(cell, weights=v[at] if weight is None else v[at] * weight[entry], minlength=size)
        return [x.reshape(rows, queries) for x in out]


@dataclass(frozen=True)
class Scorer:
    """A block of queries: idf of terms, the queries' terms, both boosts' terms if there are any, unit vectors by length if there are any."""

    ids: list
    weights: np.ndarray
    mean: float
    words: Lookup
    boosts: tuple[Lookup, Lookup] | None = None
    unit: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
    k1: float = 1.2
    b: float = 0.75

    def parts(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(CELLS // max(len(self.ids), 1), 1)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

    def __call__(self, part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether a pair shares anything but vectors, and ``dense, sparse, keyword``, with ``technical`` before the cap of both boosts, of rows by queries."""
        size, n = part.num_rows, len(self.ids)

        def entries(name: str) -> tuple[np.ndarray, np.ndarray]:
            sizes, values = term_batches._lists(part.column(name))
            return np.repeat(np.arange(size), sizes), np.asarray(values).astype(np.int64)

        row, term = entries("at")
        tf = entries("tf")[1].astype(np.float64)
        norm = 1.0 - self.b + self.b * part.column("dl").to_numpy().astype(np.float64) / self.mean
        met, sparse = self.words.sums(row, term, self.weights[term] * tf * (self.k1 + 1.0) / (tf + self.k1 * norm[row]), size, n)
        keyword = technical = dense = np.zeros((size, n))
        if self.boosts is not None:
            row, term = entries("inside")
            more, total, rare = self.boosts[0].sums(row, term, None, size, n)
            keyword = np.where(more > 0, np.minimum(total + np.where(rare >= 2, 0.2, 0.0), 1.0), 0.0)
            also, technical = self.boosts[1].sums(row, term, None, size, n)
            met = met + more + also
        if self.unit is not None:
            dense = np.zeros((size, n))
            for length, (rows, x) in vectors._unit(pa.concat_arrays([part.column("embedding")])).items():
                if length in self.unit:
                    own, q = self.unit[length]
                    dense[np.ix_(rows, own)] = np.round(x @ q.T, 12)
        return met > 0, {"dense": dense, "sparse": sparse, "keyword": keyword, "technical": technical}

    def names(self, kind: pa.DataType) -> pa.Array:
        return pa.array(self.ids, kind)


class Best:
    """The best ``k`` documents of each query so far, by scores of nine decimals and then ids; a null id is the least."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.size = k, queries
        self.query, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        near = np.round(score, 9) >= self.least[query]
        query, doc, score = (np.concatenate([a, b[near]]) for a, b in ((self.query, query), (self.doc, doc), (self.score, score)))
        rounded = np.round(score, 9)
        order = np.lexsort((doc, -rounded, query))
        query, doc, score, rounded = query[order], doc[order], score[order], rounded[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = rounded[last]
        self.query, self.doc, self.score = query[rank < self.k], doc[rank < self.k], score[rank < self.k]

    def columns(self, names: pa.Array) -> list[pa.Array]:
        """The queries by their names, the ids, the scores."""
        return [names.take(pa.array(self.query)), pa.array(self.doc, mask=self.doc == NO_ID), pa.array(self.score)]


#: Stands for a null id.
NO_ID = np.iinfo(np.int64).min


def doc_ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, int(NO_ID))).astype(np.int64)


def with_boosts(scores: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``dense, sparse, keyword`` with both boosts in one, at most 1."""
    return {"dense": scores["dense"], "sparse": scores["sparse"], "keyword": np.minimum(scores["keyword"] + scores["technical"], 1.0)}


def ranges(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    """``q, low_, high_`` of each score, one row a query and task, over all rows."""
    low = {n: np.full(len(scorer.ids), np.inf) for n in NAMES}
    high = {n: np.full(len(scorer.ids), -np.inf) for n in NAMES}
    seen = False
    for batch in batches:
        for part in scorer.parts(batch):
            for n, x in with_boosts(scorer(part)[1]).items():
                low[n], high[n] = np.minimum(low[n], x.min(axis=0)), np.maximum(high[n], x.max(axis=0))
            seen = True
    if seen:
        yield pa.RecordBatch.from_pydict({"q": np.arange(len(scorer.ids))} | {f"{s}_{n}": x[n] for n in NAMES for s, x in (("low", low), ("high", high))})


def best(batches: Iterator[pa.RecordBatch], scorer: Scorer, scale: dict[str, np.ndarray], weights: np.ndarray, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``q, doc_id, dense, sparse, keyword, hybrid, score, has_match``: the best ``k`` of each query in each block.

    Rows have ``listed``, which takes the score to a tenth, and ``fits``, the queries whose numbers the
    document meets, which go first. ``weights`` has a row a query.
    """
    for batch in batches:
        for part in scorer.parts(batch):
            size, n = part.num_rows, len(scorer.ids)
            scores = with_boosts(scorer(part)[1])
            scaled = [(scores[x] - scale[f"low_{x}"]) / np.maximum(scale[f"high_{x}"] - scale[f"low_{x}"], 1e-6) for x in NAMES]
            hybrid = weights[:, 0] * scaled[0] + weights[:, 1] * scaled[1] + weights[:, 2] * scaled[2]
            listed = part.column("listed").to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(listed[:, None], hybrid * 0.1, hybrid)
            match = np.zeros((size, n), bool)
            sizes, values = term_batches._lists(part.column("fits"))
            match[np.repeat(np.arange(size), sizes), np.asarray(values).astype(np.int64)] = True
            doc = part.column("doc_id").to_numpy()
            place = np.argsort(doc, kind="stable")
            # the order of the ranking: matches, scores by nine decimals, ids
            keys = np.round(score[place], 9) + np.where(match[place], 1e6, 0.0)
            order = np.argsort(-keys, axis=0, kind="stable")[:k]
            d, q = place[order].T.reshape(-1), np.repeat(np.arange(n), order.shape[0])
            columns = [q, doc[d], *(scores[x][d, q] for x in NAMES), hybrid[d, q], score[d, q], match[d, q]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
