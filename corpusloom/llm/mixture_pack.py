"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target proportions.

Every document is tokenized once and stored with its place in its source's queue. Target shares of
the windows can be given by source; without them a source's target is its share of all tokens, so all
queues run dry together. Where a queue runs dry before the others, these go on in proportion to their
targets; no token is dropped or repeated. Tokens are dealt to windows by
deficits: each window adds a source's share of its size to the source's deficit, sources are served
in turn what their deficit allows, and what a window leaves over or takes ahead is carried on. The
deal is a tree: a node of the tree deals its sources' quotas to at most ``FAN`` children by the same
deficits, down to single windows. Any node follows from the totals of the sources alone, so each task
computes the few nodes that its documents fall into, deficits pass windows and partitions without
any exchange of tokens, and the result does not depend on who computes it. Sources beyond the first
queues are mixed by the same deal to one stream, which is a queue like any other.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

WINDOW = 2048
END_ID = 1
#: Children of a node, and windows of the lowest nodes.
FAN = 64
#: Tokens of a piece that a window takes from a queue, at least, unless the window or queue ends.
LEAST = 256
#: Queues of a mixture; sources beyond the largest are mixed among themselves in the last one.
MOST_QUEUES = 64
#: Nodes that a task keeps of a mixture, and mixtures within a mixture.
KEPT_NODES = 256
KEPT_STREAMS = 64
#: Rows of the offsets' table up to which it is sent to every task; beyond that it is joined by a shuffle.
SENT_ROWS = 200_000
#: Runs without white space of so many characters are left to the library, whose merging is not quadratic.
_LONG = re.compile(r"\S{4096}")
_PROBES = ("A b.\nC 'll d's  e\n\n\nf ", "x y\u00a0z\nq\r\n\t1", " lead 12ab-cd\n(e)", "é漢字🙂 \u200bz\u2028\x1c \x85")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_encoding(path: str):
    """The vocabulary of a byte-level BPE file as ranks for the faster library; None if it can't be read so or ids differ on probes.

    In a byte-level vocabulary each byte is written as one printable character, and a merged token's
    number gives its rank.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # printable Latin bytes stand for themselves, the others follow from U+0100 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    octet = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
    ranks = {bytes(octet[c] for c in t): n for t, n in model["vocab"].items() if all(c in octet for c in t)}
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    found = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same = all(found.encode_ordinary(p) == tokenizer(path).encode(p, add_special_tokens=False).ids for p in _PROBES)
    return found if same else None


class DocumentIds:
    """Ids of whole texts as bytes of one integer type, as the tokenizers library gives them.

    A control token of the vocabulary that stands in a text is read as such, as the library does;
    such texts are left to it.
    """

    def __init__(self, path: str) -> None:
        self.library, self.fast = tokenizer(path), fast_encoding(path)
        self.control = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> bytes:
        if self.fast is None or _LONG.search(text) or any(c in text for c in self.control):
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)
        return ids.tobytes()


def deal(quotas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cumulative quotas of the children: row k is what the sources have given before child k.

    Row sums are the cumulative sizes, columns never fall, and each entry is near its source's share.
    """
    total = max(int(quotas.sum()), 1)
    out = np.zeros((len(sizes) + 1, len(quotas)), dtype=np.int64)
    done = 0
    for k, size in enumerate(sizes.tolist()):
        done += size
        deficit = quotas * (done / total) - out[k]
        left = quotas - out[k]
        give = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        short = size - int(give.sum())
        while short:
            # the largest deficits are rounded up, or the smallest remainders given back, one token each
            can = give < left if short > 0 else give > 0
            order = np.argsort(-(deficit - give) if short > 0 else deficit - give, kind="stable")
            order = order[can[order]][: abs(short)]
            give[order] += 1 if short > 0 else -1
            short = size - int(give.sum())
        out[k + 1] = out[k] + give
    return out


def serve(quotas: list[int], sizes: list[int], least: int = LEAST) -> list[list[tuple[int, int, int, int]]]:
    """Deficit round-robin over the windows of a lowest node.

    For each source its pieces ``(start, window, offset, length)``, where start counts the source's
    tokens in the node.
    """
    total, n = sum(quotas), len(quotas)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in quotas]
    given, deficit, turn = [0] * n, [0.0] * n, 0

    def take(s: int, window: int, at: int, length: int) -> int:
        pieces[s].append((given[s], window, at, length))
        given[s] += length
        deficit[s] -= length
        return at + length

    for window, size in enumerate(sizes):
        for s in range(n):
            deficit[s] += quotas[s] * size / total
        at = 0
        for step in range(n):
            s = (turn + step) % n
            own = min(size - at, quotas[s] - given[s], int(deficit[s]))
            if own >= least:
                at = take(s, window, at, own)
        turn = (turn + 1) % n
        while at < size:
            s = max((s for s in range(n) if given[s] < quotas[s]), key=lambda s: deficit[s])
            at = take(s, window, at, min(size - at, quotas[s] - given[s], max(least, int(deficit[s]))))
    return pieces


class Mixture:
    """Where each token of each queue lies, from the queues' totals."""

    def __init__(self, totals: list[int], window: int = WINDOW, fan: int = FAN, least: int = LEAST) -> None:
        self.totals = np.array(totals, dtype=np.int64)
        self.window, self.fan, self.least = window, fan, least
        self.tokens = int(self.totals.sum())
        self.windows = -(-self.tokens // window)
        self.depth = 1
        while fan**self.depth < self.windows:
            self.depth += 1
        self.kept: OrderedDict[tuple[int, int], tuple] = OrderedDict()

    def _sizes(self, level: int, index: int) -> np.ndarray:
        """Tokens of the children of a node; a child of level l covers ``fan ** l`` windows."""
        span = self.fan ** (level - 1) * self.window
        first = index * self.fan
        edges = np.minimum((first + np.arange(self.fan + 1)) * span, self.tokens)
        return np.diff(edges)[np.diff(edges) > 0]

    def _node(self, level: int, index: int, quotas: np.ndarray) -> tuple:
        key = (level, index)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        sizes = self._sizes(level, index)
        if level == 1:
            pieces = serve(quotas.tolist(), sizes.tolist(), self.least)
            found = (pieces, [np.array([p[0] for p in own], dtype=np.int64) for own in pieces])
        else:
            found = (deal(quotas, sizes),)
        self.kept[key] = found
        if len(self.kept) > KEPT_NODES:
            self.kept.popitem(last=False)
        return found

    def pieces(self, queue: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """``(window, offset, length)`` for the queue's tokens from ``at`` on, in order."""
        while length:
            index, base, quotas = 0, 0, self.totals
            for level in range(self.depth, 1, -1):
                (cumulated,) = self._node(level, index, quotas)
                child = int(np.searchsorted(cumulated[:, queue], at - base, side="right")) - 1
                base += int(cumulated[child, queue])
                quotas, index = cumulated[child + 1] - cumulated[child], index * self.fan + child
            pieces, starts = self._node(1, index, quotas)
            own, first = pieces[queue], index * self.fan
            for k in range(int(np.searchsorted(starts[queue], at - base, side="right")) - 1, len(own)):
                start, window, offset, size = own[k]
                skip = at - base - start
                n = min(size - skip, length)
                yield first + window, offset + skip, n
                at, length = at + n, length - n
                if not length:
                    return


class Sources:
    """Where each token of each source lies, for any number of sources, from their totals, the largest first.

    The queues of a mixture are sources or streams: a stream is the windows of a mixture of its own
    sources, one after another. So each source has its share of its stream, and the stream its share
    of the whole.
    """

    def __init__(self, totals: np.ndarray, window: int = WINDOW, most: int = MOST_QUEUES, top: bool = True) -> None:
        n = len(totals)
        if n <= most:
            self.first = np.arange(n + 1)
        elif top:
            self.first = np.array([*range(most), n])
        else:
            self.first = np.arange(most + 1) * n // most
        self.totals, self.window, self.most = totals, window, most
        self.mixture = Mixture([int(totals[a:b].sum()) for a, b in zip(self.first[:-1], self.first[1:], strict=True)], window)
        self.streams: OrderedDict[int, Sources] = OrderedDict()

    def _stream(self, queue: int) -> Sources:
        if queue in self.streams:
            self.streams.move_to_end(queue)
        else:
            self.streams[queue] = Sources(self.totals[self.first[queue] : self.first[queue + 1]], self.window, self.most, False)
            if len(self.streams) > KEPT_STREAMS:
                self.streams.popitem(last=False)
        return self.streams[queue]

    def pieces(self, source: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """``(window, offset, length)`` for the source's tokens from ``at`` on, in order."""
        queue = int(np.searchsorted(self.first, source, side="right")) - 1
        first = int(self.first[queue])
        if self.first[queue + 1] - first == 1:
            yield from self.mixture.pieces(queue, at, length)
            return
        for window, offset, n in self._stream(queue).pieces(source - first, at, length):
            yield from self.mixture.pieces(queue, window * self.window + offset, n)


def phases(totals: np.ndarray, weights: np.ndarray, window: int) -> list[np.ndarray]:
    """Tokens that each queue gives in each phase; all but the last phase fill whole windows.

    In a phase the queues that are not dry give in proportion to their weights until the next one is
    about to run dry, and a window at a time around that point. Queues of weight 0 come last.
    """
    left, out = totals.astype(np.int64).copy(), []
    while left.sum():
        w = np.where(left > 0, weights, 0.0)
        w = w / w.sum() if w.sum() > 0 else left / left.sum()
        lasts = np.floor(np.min(left[w > 0] / w[w > 0]) / window) * window
        size = int(min(max(lasts, window), left.sum()))
        give = np.minimum(np.floor(w * size).astype(np.int64), left)
        while short := size - int(give.sum()):
            can, weight = (give < left) & (w > 0), w
            if not can.any():
                can, weight = give < left, left
            share = np.where(can, weight, 0.0)
            more = np.minimum(np.floor(share / share.sum() * short).astype(np.int64), left - give)
            if not more.any():
                order = np.argsort(np.where(can, give - w * size, np.inf), kind="stable")[: min(short, int(can.sum()))]
                more[order] = 1
            give += more
        out.append(give)
        left -= give
    return out


class Targets:
    """Where each token of each source lies if the first sources have target shares and the others, as one queue, what is left."""

    def __init__(self, totals: np.ndarray, shares: list[float], window: int = WINDOW, most: int = MOST_QUEUES) -> None:
        self.named, self.window = len(shares), window
        rest = totals[self.named :]
        self.rest = Sources(rest, window, most) if len(rest) else None
        queues = np.array([*totals[: self.named], *([rest.sum()] if len(rest) else [])], dtype=np.int64)
        weights = np.array([*shares, *([max(0.0, 1.0 - sum(shares))] if len(rest) else [])], dtype=float)
        gives = phases(queues, weights, window)
        self.mixtures = [Mixture(g.tolist(), window) for g in gives]
        self.before = np.concatenate([np.zeros((1, len(queues)), dtype=np.int64), np.cumsum(np.array(gives, dtype=np.int64).reshape(-1, len(queues)), axis=0)])
        self.windows = np.concatenate([[0], np.cumsum([m.windows for m in self.mixtures])]).astype(int).tolist()

    def _queue(self, queue: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        ends = self.before[:, queue]
        while length:
            k = int(np.searchsorted(ends, at, side="right")) - 1
            n = min(length, int(ends[k + 1]) - at)
            for window, offset, size in self.mixtures[k].pieces(queue, at - int(ends[k]), n):
                yield self.windows[k] + window, offset, size
            at, length = at + n, length - n

    def pieces(self, source: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """``(window, offset, length)`` for the source's tokens from ``at`` on, in order."""
        if source < self.named:
            yield from self._queue(source, at, length)
            return
        for window, offset, n in self.rest.pieces(source - self.named, at, length):
            yield from self._queue(self.named, window * self.window + offset, n)


def tokenize(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, part int, before long, n long, ids binary``: ``before`` counts the source's tokens in the part so far.

    A null or empty text has the end id alone; a null source is the source of the empty name; rows
    without an id and repeated rows are rows like any other; other columns are not read; an empty
    table gives an empty one.
    """
    import pyarrow as pa

    from .common import bounded_batches

    bounded_batches(df.sparkSession)
    names = ["doc_id", "source", "part", "before", "n", "ids"]

    def run(batches):
        from pyspark import TaskContext

        own, part, sums = DocumentIds(path), TaskContext.get().partitionId(), {}
        end, size = np.array([END_ID], dtype=own.kind).tobytes(), own.kind.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids_of, texts, sources = (c.to_pylist() for c in batch.slice(at, 256).columns)
                ids = [own.encode(t or "") + end for t in texts]
                before, n = [], [len(i) // size for i in ids]
                sources = [s or "" for s in sources]
                for s, k in zip(sources, n, strict=True):
                    before.append(sums.get(s, 0))
                    sums[s] = before[-1] + k
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                columns = (ids_of, sources, [part] * len(n), before, n, ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = df.select(*[F.col(f"`{c}`").cast(k) for c, k in ((id_col, "long"), (text_col, "string"), (source_col, "string"))])
    return source.mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


def pack(df: DataFrame, path: str, window: int = WINDOW, shares: dict[str, float] | None = None, **columns: str) -> DataFrame:
    """``doc_id, start, length, ids binary, doc_tokens, sequence_id, offset``: the pieces of every document.

    ``ids`` holds little-endian unsigned 32-bit integers. Each document's ids end with ``END_ID``. All
    windows but the last are full. ``shares`` gives sources their target shares of a window; the others
    share what is left of 1 as they occur. Without it all have their natural shares. The driver and
    each task hold one number a source. A null text is empty, a null source is the source of the empty
    name; repeated rows and null ids are packed like any others; other columns are not read; an empty
    table gives no pieces.
    """
    shares = shares or {}
    if any(v < 0 for v in shares.values()) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares are not negative and add up to 1 at most")
    rows = stored(tokenize(df, path, **columns), "tokens")
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc(F.col("source").isin(list(shares))), F.desc("n"), "source").collect()
    targets = [shares[r.source] for r in by_source if r.source in shares]
    totals, most = np.array([r.n for r in by_source], dtype=np.int64), MOST_QUEUES
    listed = df.sparkSession.createDataFrame([(r.source, k) for k, r in enumerate(by_source)], "q_source string, queue int")
    if len(by_source) <= SENT_ROWS:
        listed = F.broadcast(listed)
    queued = sums.join(listed, F.col("source") == F.col("q_source")).select("source", "part", "n", "queue")
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = queued.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    if bases.count() <= SENT_ROWS:
        bases = F.broadcast(bases)
    placed = rows.join(bases, (F.col("source") == F.col("b_source")) & (F.col("part") == F.col("b_part"))).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids"
    )

    def make():
        deals = Targets(totals, targets, window, most) if targets else Sources(totals, window, most)

        def work(key, queue, at, n, raw):
            ids = np.frombuffer(raw, dtype=np.dtype("<u2") if len(raw) == 2 * n else np.dtype("<u4")).astype("<u4").tobytes()
            start = 0
            for sequence, offset, length in deals.pieces(queue, at, n):
                yield (key, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset)
                start += length

        return work

    return map_rows(placed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", make)
