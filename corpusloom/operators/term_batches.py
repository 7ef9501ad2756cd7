"""A bounded list of terms looked up in Arrow batches of texts: counted as words and pairs, and found inside words.

Tokens of a batch are encoded by a dictionary, so strings are compared once a distinct word, and all
counts are sums over numbers. Terms inside words are found by an Aho-Corasick automaton, once a
distinct word of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are looked up at once, and bytes of text.
ROWS, BYTES = 1024, 1 << 20
#: Distinct words whose terms a task remembers, and characters of the longest of them.
KEPT_WORDS, KEPT_CHARS = 500_000, 64


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``ROWS`` rows and about ``BYTES`` bytes in the column, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if pa.types.is_string(batch.column(column).type) else np.zeros(batch.num_rows, np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
        to = min(max(at + 1, most), at + ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes of the lists of a column and their values, one after another; a null list is empty."""
    column = pa.concat_arrays([column]) if column.offset else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return sizes, column.flatten()


class TermTable:
    """``terms`` are distinct strings without white space; results name them by their places."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        place = {t: n for n, t in enumerate(terms)}
        # a term with a line below may be a pair: each cut of it is looked for
        cuts = [(t[:i], t[i + 1 :], n) for t, n in place.items() for i in range(1, len(t) - 1) if t[i] == "_"]
        words = sorted({*place, *(w for a, b, _ in cuts for w in (a, b))})
        at = {w: n for n, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.single = np.array([place.get(w, -1) for w in words] + [-1], dtype=np.int64)
        keys = np.array([at[a] * len(words) + at[b] for a, b, _ in cuts], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.pairs = keys[order], np.array([n for _, _, n in cuts], dtype=np.int64)[order]

    def counts(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, term, tf, uf``: how often each term is a word or a pair of neighbours of a row's list of tokens, and how often a word."""
        sizes, values = _lists(tokens)
        coded = values.dictionary_encode()
        known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1)).astype(np.int64)
        codes = np.asarray(coded.indices).astype(np.int64)
        own = known[codes] if len(codes) else codes
        rows = np.repeat(np.arange(len(sizes)), sizes)
        term = self.single[own]
        found = np.flatnonzero(term >= 0)
        words = rows[found] * self.size + term[found]
        near = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0) & (rows[:-1] == rows[1:])) if len(own) else np.zeros(0, np.int64)
        wide = own[near] * len(self.words) + own[near + 1]
        at = np.minimum(np.searchsorted(self.keys, wide), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == wide if len(self.keys) else np.zeros(len(wide), bool)
        pairs = rows[near[hit]] * self.size + self.pairs[at[hit]]
        key, tf = np.unique(np.concatenate([words, pairs]), return_counts=True)
        single, n = np.unique(words, return_counts=True)
        uf = np.zeros(len(key), np.int64)
        uf[np.searchsorted(key, single)] = n
        return key // max(self.size, 1), key % max(self.size, 1), tf, uf


class Inside:
    """Which terms lie anywhere in a word, by an automaton."""

    def __init__(self, terms: list[str], numbers: list[int] | None = None) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        self.size = len(terms)
        for n, t in zip(numbers if numbers is not None else range(len(terms)), terms, strict=True):
            if t:
                self.machine.add_word(t, n)
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()
        self.known: dict[str, np.ndarray] = {}

    def of_word(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            found = np.array(sorted({n for _, n in self.machine.iter(word)}), dtype=np.int64) if not self.empty else np.zeros(0, np.int64)
            if len(word) <= KEPT_CHARS:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``row, term`` for the terms in the texts, each once a row."""
        sizes, values = _lists(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        coded = values.dictionary_encode()
        lists = [self.of_word(w) for w in coded.dictionary.to_pylist()]
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        rows, codes = np.repeat(np.arange(len(sizes)), sizes), np.asarray(coded.indices).astype(np.int64)
        # a word counts once a row
        n = max(len(lists), 1)
        words = np.unique(rows * n + codes)
        rows, codes = words // n, words % n
        row, term = expand(rows, codes, np.cumsum(counts) - counts, counts, flat)
        most = int(term.max(initial=0)) + 1
        key = np.unique(row * most + term)
        return key // most, key % most


def expand(rows: np.ndarray, codes: np.ndarray, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with all values of its code, which lie from ``starts[code]`` on."""
    n = counts[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[codes] if len(codes) else n, n)
    return np.repeat(rows, n), values[at]


#: Entries that are expanded at once.
ENTRIES = 1 << 21


def bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, or of one row."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def as_lists(rows: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """Columns of sorted rows as lists of integers, one list a row of ``n``."""
    ends = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in columns]


def counted(docs: DataFrame, terms: list[str], searched: list[int]) -> DataFrame:
    """``doc_id, dl, at, tf, uf, inside`` and any further columns, for each row of ``docs (doc_id, bare array<string>, low string, ...)``.

    They are its length in words and pairs, its terms and their counts, and the ``searched`` terms in
    ``low``. Terms are named by their places in ``terms``; lists are ordered by them.
    """
    sent = docs.sparkSession.sparkContext.broadcast((terms, searched))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    target = T.StructType([*T.StructType.fromDDL("doc_id long, dl long, at array<int>, tf array<int>, uf array<int>, inside array<int>").fields, *docs.schema.fields[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, searched = sent.value
        table, inside = TermTable(terms), Inside([terms[n] for n in searched], searched)
        for batch in batches:
            for part in parts(batch, 2):
                n = part.num_rows
                sizes = np.asarray(pc.fill_null(pc.list_value_length(part.column(1)), 0)).astype(np.int64)
                row, term, tf, uf = table.counts(part.column(1))
                lists = as_lists(row, n, term, tf, uf)
                row, term = inside.of_texts(part.column(2)) if searched else (np.zeros(0, np.int64),) * 2
                columns = [part.column(0), pa.array(2 * sizes - np.minimum(sizes, 1)), *lists, *as_lists(row, n, term), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return docs.select("doc_id", "bare", "low", *docs.columns[3:]).mapInArrow(run, target)


def found_inside(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``key, term`` for the terms that lie in the lower-case texts of ``rows (key, low)``, each once a row."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, names = Inside(sent.value), pa.array(sent.value, pa.string())
        for batch in batches:
            for part in parts(batch, 1):
                row, term = inside.of_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(term))], names=["key", "term"])

    return rows.select("key", "low").mapInArrow(run, f"key {kind}, term string")
