"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to source blocks by a hash of their content, so a block holds the same rows however
often a task is run again. The blocks' row counts and the exact shard sizes fix the margins of the
matrix that says how many rows of each block go to each shard. The matrix is drawn as a tree: a range
of blocks splits its row of shard counts between its halves by a multivariate hypergeometric draw, down
to single blocks. Each node's draw follows from the seed and the node alone, so every task draws the
few rows that it needs and nobody holds the matrix. Each block is permuted (ordered by a keyed hash),
its rows go to shards by their rank, and each shard is permuted again: its rows fall into parts by one
keyed hash and are ordered within them by another.
"""

from __future__ import annotations

from collections import OrderedDict
from math import exp, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, numbered, row_hash, stored

#: Rows of a source block on average; the driver and each task hold 8 bytes for each.
BLOCK_ROWS = 10_000
#: Blocks at most, of which the driver and each task hold a number each, and partitions of an exchange at most.
MOST_BLOCKS, MOST_TASKS = 2_000_000, 20_000
#: Rows of a part of a shard on average; parts are sorted each on its own.
PART_ROWS = 50_000
#: Equal rows above which they are told apart, so that they do not share a block.
EQUAL_ROWS = 20_000
#: Rows of the table of parts up to which it is sent to every task; beyond it is joined by a shuffle.
SENT_PARTS = 200_000
#: Populations from this size on are beyond the generator's own draw.
LARGE = 10**9
#: Nodes of the tree that a task keeps.
KEPT_NODES = 1024


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most; the first shards have the larger ones."""
    low, more = divmod(rows, shards)
    return np.full(shards, low, dtype=np.int64) + (np.arange(shards) < more)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, large: int = LARGE) -> int:
    """How many good ones ``n`` draws without replacement hold, for populations of any size.

    Large populations are drawn by rejection from a hat that covers every log-concave distribution on
    the integers (Devroye 1987); nothing is approximated but by floating point.
    """
    if good < large and bad < large:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_weight(x: int) -> float:
        return -(lgamma(x + 1) + lgamma(good - x + 1) + lgamma(n - x + 1) + lgamma(bad - n + x + 1))

    def log_choose(a: int, b: int) -> float:
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

    top = log_weight(mode)
    peak = min(1.0, exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n)))
    width = 1 + peak / 2
    while True:
        flat = rng.random() <= width / (1 + width)
        y = (rng.random() * width if flat else width + rng.standard_exponential()) / peak
        x = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= x <= high and rng.random() * min(1.0, exp(width - peak * y)) <= exp(log_weight(x) - top):
            return x


def draw(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows take places of each shard: a multivariate hypergeometric draw, by halves of the shards."""
    if n == 0 or len(places) == 1:
        return np.array([n] if len(places) == 1 else [0] * len(places), dtype=np.int64)
    half = len(places) // 2
    k = hypergeometric(rng, int(places[:half].sum()), int(places[half:].sum()), n)
    return np.concatenate([draw(rng, places[:half], k), draw(rng, places[half:], n - k)])


class Matrix:
    """The communication matrix from its margins: ``before`` are the rows of all earlier blocks, with the total at its end."""

    def __init__(self, before: np.ndarray, sizes: np.ndarray, seed: int) -> None:
        self.before, self.sizes, self.seed = before, sizes, seed
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def row(self, block: int) -> np.ndarray:
        """Rows of the block that go to each shard."""
        low, high, own = 0, len(self.before) - 1, self.sizes
        while high - low > 1:
            middle = (low + high) // 2
            key = (low, high)
            if key not in self.kept:
                rng = np.random.default_rng([self.seed, low, high])
                self.kept[key] = draw(rng, own, int(self.before[middle] - self.before[low]))
                if len(self.kept) > KEPT_NODES:
                    self.kept.popitem(last=False)
            left = self.kept[key]
            low, high, own = (low, middle, left) if block < middle else (middle, high, own - left)
        return own


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All columns of ``df`` with ``shard int`` (0 to shards - 1) and ``slot long`` (gapless from 0 in each shard).

    Columns of the input named shard or slot, in any case, are replaced; other names do not matter.
    Null and repeated rows are rows like any other: equal rows are interchangeable, so their ties do
    not matter, and more than ``EQUAL_ROWS`` of a kind are told apart by numbers that are stored. An
    empty table gives an empty one. The result depends on the rows and the seed only, not on their
    order or partitions. The rows pass two exchanges, one by block and one by shard part; blocks and
    parts have about the same number of rows at every size.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [n for n, c in enumerate(df.columns) if c.lower() not in ("shard", "slot")]
    names = [f"c{n}" for n in kept]
    keyed = numbered(df).select(*names)
    keyed = keyed.withColumn("h", row_hash(keyed, F.lit(seed)))
    equal = checkpointed(keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > EQUAL_ROWS).select(F.col("h").alias("e")))
    if not equal.isEmpty():
        apart = keyed.join(equal, F.col("h") == F.col("e"), "left_semi").withColumn("h", F.xxhash64("h", F.monotonically_increasing_id()))
        keyed = keyed.join(equal, F.col("h") == F.col("e"), "left_anti").unionByName(stored(apart, "equal"))
    rows = keyed.count()
    blocks = min(max(1, -(-rows // BLOCK_ROWS)), MOST_BLOCKS)
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks)).cast("int"))
    counts = np.zeros(blocks, dtype=np.int64)
    for b, n in keyed.groupBy("block").count().collect():  # one row a block
        counts[b] = n
    before = np.concatenate([[0], np.cumsum(counts)])
    sent = df.sparkSession.sparkContext.broadcast((before, exact_sizes(rows, shards)))  # a number a block
    drawn: list[Matrix] = []  # of a task, whose batches share its nodes

    @F.pandas_udf("int")
    def shard_of(block: pd.Series, rank: pd.Series) -> pd.Series:
        if not drawn:
            drawn.append(Matrix(*sent.value, seed))
        matrix, b, r = drawn[0], block.to_numpy(), rank.to_numpy()
        out = np.empty(len(b), dtype=np.int32)
        for one in np.unique(b):
            at = b == one
            out[at] = np.searchsorted(np.cumsum(matrix.row(int(one))), r[at], side="right")
        return pd.Series(out)

    parts = max(1, -(-rows // (shards * PART_ROWS)))
    local = Window.partitionBy("block").orderBy(F.xxhash64("h", F.lit("local")), "h")
    # a partition holds a block, and later a part of a shard, or as few as there can be, whatever the session's number of partitions
    ranked = keyed.repartitionById(min(blocks, MOST_TASKS), "block").withColumn("rank", F.row_number().over(local) - 1)
    part = F.pmod(F.xxhash64("h", F.lit("part")), F.lit(parts)).cast("int")
    exchanged = ranked.withColumns({"shard": shard_of("block", "rank"), "part": part}).withColumn("cell", (F.col("shard") * parts + F.col("part")).cast("int"))
    again = Window.partitionBy("cell").orderBy(F.xxhash64("h", F.lit("again")), "h")
    placed = exchanged.repartitionById(min(shards * parts, MOST_TASKS), "cell").withColumn("at", (F.row_number().over(again) - 1).cast("long"))
    first = F.lit(0)
    if parts > 1:
        sizes = exchanged.groupBy(F.col("shard").alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        table = checkpointed(sizes.select("s", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))  # one row a part
        table = F.broadcast(table) if parts * shards <= SENT_PARTS else table
        placed, first = placed.join(table, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))), F.col("first")
    return placed.select(*names, "shard", (first + F.col("at")).alias("slot")).toDF(*[df.columns[n] for n in kept], "shard", "slot")
