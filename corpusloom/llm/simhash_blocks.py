"""SimHash near-duplicates: pigeonhole blocks, verified distances, connected components.

Fingerprints of at most ``d`` differing bits, cut into ``b > d`` blocks, agree on at least ``b - d``
of them. For each choice of ``b - d`` blocks the fingerprints are dealt by the bits of the choice;
pairs that share them meet in one group, where the distance is verified. A group gives links that
span its components and not all of its pairs, so rows grow with the fingerprints and no link
between different texts is lost. Groups over ``HOT_GROUP`` are split by more blocks of the bits that
are left, before any task gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded_batches, checkpointed, connected_components, map_rows, numbered, place_of, row_hash, stored

#: Rows of a group that is compared at once in a task.
DIRECT = 2048
#: Rows above which a group is split by further blocks.
HOT_GROUP = 50_000
_COUNT_STEP = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included, in order.

    A-Z are lowered, words are split at space and bytes 9 to 13 and joined by one space. Fewer words
    are one shingle; no words give none.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = starts + lengths
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], 42) for a, b in pairs), dtype=np.uint64, count=len(parts) - words + 1)


def majority_bits(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian fingerprint of ``64 * lanes`` bits: a bit is 1 if it is set in over half the hashes.

    The first lane is the hash itself, further lanes are mixed from it. No hashes give zero.
    """
    counts = np.zeros((lanes, 64), dtype=np.int64)
    for lane in range(lanes):
        for at in range(0, len(hashes), _COUNT_STEP):
            part = hashes[at : at + _COUNT_STEP]
            if lane:
                part = _mixed(part, lane)
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for low in range(0, len(bits), 255):
                counts[lane] += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts.reshape(-1) * 2 > len(hashes)).tobytes()


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The finaliser of splitmix64, a public generator, on the hash and the lane."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(df: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: a long for one lane, else binary. Null texts are empty; all rows are kept."""

    def make():
        def work(key, text):
            bits = majority_bits(shingle_hashes(text, words), lanes)
            return ((key, int.from_bytes(bits, "big", signed=True) if lanes == 1 else bits),)

        return work

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, f"doc_id long, fp {'long' if lanes == 1 else 'binary'}", make)


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    """Cut a list of bit numbers into parts whose sizes differ by one at most."""
    low, more = divmod(len(bits), parts)
    ends = np.cumsum([low + (k < more) for k in range(parts)])
    return [bits[e - low - (k < more) : e] for k, e in enumerate(ends)]


def as_mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _spanning(x: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (two arrays) that connect each component of the distinct values ``x`` under the distance."""
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = label != np.arange(len(x))
    if at.any():
        yield x[at], x[label[at]]


def group_links(x: np.ndarray, distance: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for a group of any size whose values agree on all bits but ``free``: splits by pigeonhole again."""
    if len(x) < 2:
        return
    if len(x) <= DIRECT or len(free) <= distance + 1:
        yield from _spanning(x, distance)
        return
    for part in split_bits(free, distance + 1):
        mask, rest = np.uint64(as_mask(part) & (2**64 - 1)), [b for b in free if b not in part]
        key = x & mask
        order = np.argsort(key, kind="stable")
        key, value = key[order], x[order]
        edge = np.flatnonzero(np.diff(key)) + 1
        for one in np.split(value, edge):
            if len(one) > 1:
                yield from group_links(one, distance, rest)


def pigeonhole_links(fps: DataFrame, distance: int = 3, blocks: int = 6, hot_group: int = HOT_GROUP) -> DataFrame:
    """Links ``a, b`` that span the components of distinct non-null 64-bit ``fp`` at ``distance`` bits or fewer."""
    cut = split_bits(list(range(64)), blocks)
    masks = [as_mask(sum(c, [])) for c in combinations(cut, blocks - distance)]
    fp = F.col("fp")
    pairs = F.array(*[F.struct(F.lit(m).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("k")) for m in masks])
    rows, ready = fps.select("fp", F.inline(pairs)).select("mask", "k", "fp"), []
    while True:
        hot = checkpointed(rows.groupBy("mask", "k").count().where(F.col("count") > hot_group).select("mask", "k"))
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, ["mask", "k"], "left_anti"))
        over = checkpointed(rows.join(hot, ["mask", "k"], "left_semi").distinct())
        # values that agree on all but a few bits are few
        last = F.bit_count("mask") >= 64 - (distance + 1)
        ready.append(over.where(last))
        rows = over.where(~last).mapInArrow(_finer(distance), "mask long, k long, fp long")
    all_rows = reduce(DataFrame.unionByName, ready)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for mask, _, x in _groups(batches):
            for a, b in group_links(np.unique(x.view(np.uint64)), distance, free_bits(mask)):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return all_rows.repartition("mask", "k").sortWithinPartitions("mask", "k").mapInArrow(run, "a long, b long")


def free_bits(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def _finer(distance: int):
    """Rows of ``mask, k, fp`` once for each further block of the bits that are free: near values agree on one of them."""
    schema = pa.schema([("mask", pa.int64()), ("k", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            mask, _, fp = (c.to_numpy() for c in batch.columns)
            for own in np.unique(mask).tolist():
                x = fp[mask == own]
                for part in split_bits(free_bits(own), distance + 1):
                    m = np.int64(own | as_mask(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), m)), pa.array(x & m), pa.array(x)], schema=schema)

    return run


def _groups(batches) -> Iterator[tuple[int, int, np.ndarray]]:
    """Groups of two rows or more from batches of ``t, k, value...`` sorted by ``t, k``; extra columns come as one array each."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        t, k = columns[:2]
        edge = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, [len(t)]])
        sizes = np.diff(edge)
        for n in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            a, b = edge[n], edge[n + 1]
            key = (int(t[a]), int(k[a]))
            if key != last:
                if last is not None and held and sum(len(h[0]) for h in held) > 1:
                    yield (*last, *(np.concatenate(c) for c in zip(*held, strict=True)))
                held, last = [], key
            held.append([c[a:b] for c in columns[2:]])
    if last is not None and sum(len(h[0]) for h in held) > 1:
        yield (*last, *(np.concatenate(c) for c in zip(*held, strict=True)))


def components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for rows of ``doc_id, fp``, given links between fingerprints.

    ``component_id`` is the smallest doc_id of the component; null if none of its rows has an id.
    """
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    placed = ids.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = checkpointed(placed.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, words: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``doc_id, fp long, component_id`` for every row of ``df (doc_id, text)``.

    Documents link if their 64-bit fingerprints differ in ``distance`` bits or fewer. Null and empty
    texts have fingerprint zero and link like any other; repeated rows are kept and share a
    component; other columns are not read.
    """
    rows = checkpointed(fingerprints(df, words))
    return components(rows, pigeonhole_links(rows.select("fp").distinct(), distance, blocks))


# Similarity of whole shingle sets

#: Lanes of the fingerprint of a set, and differing bits up to which a pair is a candidate. Sets of Jaccard
#: similarity 0.8 have a cosine of 8/9 and differ in 15.2 % of the bits on average, with a deviation of
#: 2.2 %; sets of four and five shingles, whose bits can tie, in 18.8 %. The sets themselves decide afterwards.
LANES, NEAR_BITS = 4, 68
#: Cells of a set that are dealt, each with its own fingerprint as a block.
CELLS = 16
#: Rows of a group of equal blocks that are compared at once, and texts that are.
GROUP, CHUNK = 4096, 1000
#: Further blocks on which a group that stays large is split, one after another, before all its pairs are compared in tiles.
DEPTH = 4
#: Sets whose shingles tell which are frequent, and how many frequent ones are told; both change the order of shingles only.
ORDER_SETS, ORDER_TERMS = 10_000, 100_000
#: Sets up to which their numbers are sent to all tasks, so that other texts are not shuffled.
SENT_NODES = 200_000
#: Bits of the widest parity map of a set.
MOST_BITS = 1 << 16
#: Bits of the first hash of a set of shingles; sets that share it are told apart by a second one of 64 bits.
NODE_BITS = 64


def set_blocks(hashes: np.ndarray) -> np.ndarray:
    """Blocks (signed 64 bits) of a set of distinct hashes: the SimHash of each non-empty dealt cell.

    The hashes are dealt to cells by a mixed hash, two to four a cell, or to 16 cells if they are few.
    Sets of similarity 0.8 differ in two ninths of a set's hashes, which are fewer than its cells, so by
    the pigeonhole principle some cells agree as a whole: six or more of 16 on average at worst, none
    with a probability below 0.1 %. Sets whose sizes lie to both sides of a power of two meet in the
    cells of the smaller one.
    """
    n, out = len(hashes), []
    level = max(n.bit_length() - 1, 0)
    levels = {max(4, level - 1)} | ({max(4, level - 2)} if 4 * n < 5 << level else set())
    for log in sorted(levels) if n else ():
        cell = _mixed(hashes, 97) >> np.uint64(64 - log)
        at = np.flatnonzero(cell < CELLS)
        at = at[np.argsort(cell[at], kind="stable")]
        if not len(at):
            continue
        own = cell[at]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(hashes[at].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.diff(np.concatenate([starts, [len(at)]]))
        majority = np.add.reduceat(bits, starts, axis=0, dtype=np.int64) * 2 > counts[:, None]
        value = np.packbits(majority, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        out.append(_mixed(value ^ (own[starts] + np.uint64(CELLS * log)), 3))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _near_labels(x: np.ndarray, distance: int) -> np.ndarray:
    """For each row of ``x`` (rows of 64-bit lanes) the number of a row of its component; rows are compared in tiles."""
    parent = np.arange(len(x))
    tiles = [np.arange(a, min(a + DIRECT // 2, len(x))) for a in range(0, len(x), DIRECT // 2)]
    for i, one in enumerate(tiles):
        for two in tiles[i:]:
            differ = np.zeros((len(one), len(two)), dtype=np.uint16)
            for lane in range(x.shape[1]):
                differ += np.bitwise_count(x[one, lane][:, None] ^ x[two, lane][None, :])
            near = differ <= distance
            while True:
                a = np.where(near, parent[two][None, :], len(x)).min(axis=1)
                b = np.where(near, parent[one][:, None], len(x)).min(axis=0)
                low = parent.copy()
                np.minimum.at(low, parent[one], np.minimum(a, parent[one]))
                np.minimum.at(low, parent[two], np.minimum(b, parent[two]))
                low = low[low]
                low = low[parent]
                if (low == parent).all():
                    break
                parent = low
    return parent


def _grouped_links(rows: DataFrame) -> DataFrame:
    """``k, a, b``: links that span the near components of each group of equal ``k`` among rows of ``k, node, fp``; groups are bounded."""
    schema = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, lists = batch.column(0).to_numpy(), batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            first, nodes, fps = ends[0], flat.field(0).to_numpy(), flat.field(1)
            for key, a, b in zip(keys.tolist(), (ends[:-1] - first).tolist(), (ends[1:] - first).tolist(), strict=True):
                node = nodes[a:b]
                order = np.argsort(node, kind="stable")
                node = node[order]
                x = np.frombuffer(b"".join(fps.slice(a, b - a).to_pylist()), dtype=">u8").reshape(b - a, -1)[order].astype(np.uint64)
                label = _near_labels(x, NEAR_BITS)
                at = label != np.arange(len(label))
                if at.any():
                    columns = (np.full(at.sum(), key, dtype=np.int64), node[at], node[label[at]])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    bounded_batches(rows.sparkSession)
    groups = rows.groupBy("k").agg(F.collect_list(F.struct("node", "fp")).alias("g"))  # at most about GROUP rows
    return groups.where(F.size("g") > 1).mapInArrow(run, "k long, a long, b long")


def _tiled_links(rows: DataFrame) -> DataFrame:
    """The links of the pairs of each group of ``k, n, node, fp, ended`` of which one row at least has ``ended``, chunk by chunk.

    A chunk meets each chunk that has ended rows; no task holds more than two chunks.
    """
    size = max(GROUP // 2, 1)
    chunks = F.ceil(F.col("n") / size)
    own = stored(rows.withColumns({"m": chunks, "c": F.pmod(F.xxhash64("node", F.lit("tile")), chunks)}), "tiles")
    ends = own.where("ended").select("k", F.col("c").alias("e")).distinct()
    if ends.isEmpty():
        return own.select("k", F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    # a tile is a chunk with ended rows and any other chunk of the group
    tiles = ends.join(own.select("k", "m").distinct(), "k").select("k", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("o"))
    tiles = tiles.select("k", F.least("e", "o").alias("i"), F.greatest("e", "o").alias("j")).distinct()
    sides = tiles.select("k", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("c"))
    return _grouped_links(sides.join(own.select("k", "c", "node", "fp"), ["k", "c"]).select(F.xxhash64("k", "i", "j").alias("k"), "node", "fp"))


def set_links(sets: DataFrame) -> DataFrame:
    """Candidate links ``a, b`` between the rows of ``node long, fp binary, blocks array<long>``, one row a distinct set.

    Rows that share a block meet in a group, which gives links that span its components by Hamming
    distance. In a larger group first each of several parts keeps one row a component, so a crowd of
    near copies shrinks to a few; if many are left, they are not near each other and are dealt by each
    further block that they share as well. What is still crowded after ``DEPTH`` further blocks is
    compared pair by pair, tile by tile, and so are rows of a crowd that have no further block, with
    all of the crowd. No group of any size meets in one task. Pairs that no group proposes are met by
    :func:`missed_links`.
    """
    counts = checkpointed(sets.select(F.explode("blocks").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = sets.select("node", "fp", F.explode("blocks").alias("k"))
    links = [checkpointed(_grouped_links(dealt.join(counts.where(F.col("n") <= GROUP), "k", "left_semi")))]
    hot = counts.where(F.col("n") > GROUP)
    placed = sets.select("node", "fp", F.size("blocks").alias("last"), F.posexplode("blocks").alias("place", "k"))
    for depth in range(DEPTH + 1):
        if hot.isEmpty():
            break
        rows = stored(placed.join(hot, "k").select("k", "n", "place", "last", "node", "fp"), "hot")
        for turn in range(3):
            # parts of a group by a hash that differs from turn to turn
            part = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / GROUP))
            parted = stored(rows.withColumn("p", F.xxhash64("k", part)), "hot")
            found = checkpointed(_grouped_links(parted.select(F.col("p").alias("k"), "node", "fp")))
            links.append(found)
            gone = found.select(F.col("k").alias("_k"), F.col("a").alias("_a"))
            left = parted.join(gone, (F.col("p") == F.col("_k")) & (F.col("node") == F.col("_a")), "left_anti").drop("n", "p")
            now = checkpointed(left.groupBy("k").agg(F.count("*").alias("n")))
            before = rows.select("k", "n").distinct()
            shrunk = now.join(before.withColumnRenamed("n", "m"), "k").where(F.col("n") <= 0.8 * F.col("m")).limit(1).count()
            rows = stored(left.join(now, "k"), "hot")
            if now.where(F.col("n") > GROUP).isEmpty() or not shrunk:
                break
        links.append(checkpointed(_grouped_links(rows.where(F.col("n") <= GROUP).select("k", "node", "fp"))))
        crowd = rows.where(F.col("n") > GROUP)
        ended = F.lit(depth == DEPTH) | (F.col("place") + 1 >= F.col("last"))
        links.append(checkpointed(_tiled_links(crowd.select("k", "n", "node", "fp", ended.alias("ended")))))
        if depth == DEPTH:
            break
        further = F.posexplode(F.expr("slice(blocks, place + 2, last)")).alias("more", "other")
        # only what is still crowded meets its blocks again
        deeper = crowd.select("k", "node", "fp", "place", "last").join(sets.select("node", "blocks"), "node").select("k", "node", "fp", "place", "last", further)
        placed = deeper.select("node", "fp", "last", (F.col("place") + 1 + F.col("more")).alias("place"), F.xxhash64("k", "other").alias("k"))
        counts = checkpointed(placed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
        links.append(checkpointed(_grouped_links(placed.join(counts.where(F.col("n") <= GROUP), "k", "left_semi").select("k", "node", "fp"))))
        hot = counts.where(F.col("n") > GROUP)
    return reduce(DataFrame.unionByName, links).select("a", "b")


def exact_groups(sets: list[np.ndarray], fifths: int = 4) -> np.ndarray:
    """For each set of distinct hashes the number of a set of its component; sets link at a Jaccard similarity of ``fifths / 5`` or more.

    Each set is compared once with the sets that no component has reached yet, so a group of near
    copies costs about one comparison a set.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(codes.max(initial=-1)) + 1, dtype=np.int64)
    # an empty set is near no other
    left = np.argsort(sizes, kind="stable")
    left = left[sizes[left] > 0]
    flat, firsts = _gathered(codes, starts, left)
    while len(left):
        first, reached = left[0], [int(left[0])]
        left, flat, firsts = left[1:], flat[sizes[first] :], firsts[1:] - sizes[first]
        while reached and len(left):
            i = reached.pop()
            # sets of other sizes can not be similar enough
            low = int(np.searchsorted(5 * sizes[left], fifths * sizes[i]))
            high = int(np.searchsorted(fifths * sizes[left], 5 * sizes[i], side="right"))
            if low >= high:
                continue
            own = codes[starts[i] : starts[i + 1]]
            marked[own] = 1
            stop = firsts[high] if high < len(left) else len(flat)
            common = np.add.reduceat(marked[flat[firsts[low] : stop]], firsts[low:high] - firsts[low])
            marked[own] = 0
            near = np.zeros(len(left), dtype=bool)
            near[low:high] = (5 + fifths) * common >= fifths * (sizes[i] + sizes[left[low:high]])
            if near.any():
                reached += left[near].tolist()
                label[left[near]] = first
                left = left[~near]
                flat, firsts = _gathered(codes, starts, left)
    return label


def _gathered(codes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the rows one after another, and where each row's begin."""
    sizes = starts[rows + 1] - starts[rows]
    firsts = np.cumsum(sizes) - sizes
    return codes[np.repeat(starts[rows] - firsts, sizes) + np.arange(int(sizes.sum()))], firsts


def exact_links(texts: DataFrame, words: int) -> DataFrame:
    """``a, b``: links that span the components by exact similarity of shingle sets in each group of the rows of ``g long, node, text``.

    A node that a group holds twice counts once.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for _, _, node, text in _groups(batches):
            node, at = np.unique(node, return_index=True)
            label = exact_groups([np.unique(shingle_hashes(t, words)) for t in text[at]])
            far = label != np.arange(len(label))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], schema=schema)

    bounded_batches(texts.sparkSession)
    keyed = texts.select(F.lit(0).alias("t"), "g", "node", "text")
    return keyed.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def exact_components(texts: DataFrame, words: int) -> DataFrame:
    """``node, root`` for the rows of ``part, node, text`` that have a near one: the components of each part by exact similarity.

    Parts of up to ``CHUNK`` texts are compared in one task each. Of larger ones first each chunk keeps
    one text a component, again and again while that makes them fewer; what is not joined to a part's
    largest component by then is compared with all chunks of the part, chunk by chunk. So every pair
    that may join two components has been compared, and no task holds more than two chunks.
    """
    sizes = checkpointed(texts.groupBy("part").agg(F.count("*").alias("n")))
    small, large = sizes.where(F.col("n") <= CHUNK), sizes.where(F.col("n") > CHUNK)
    links = [checkpointed(exact_links(texts.join(small.select("part"), "part").withColumn("g", F.col("part")), words))]
    if not large.isEmpty():
        full = stored(texts.join(large, "part"), "large")
        rows, before = full, full.count()
        while True:
            chunk = F.pmod(F.xxhash64("node", F.lit(len(links))), F.ceil(F.col("n") / CHUNK))
            found = checkpointed(exact_links(rows.withColumn("g", F.xxhash64("part", chunk)), words))
            links.append(found)
            left = rows.join(found.select(F.col("a").alias("_a")), F.col("node") == F.col("_a"), "left_anti").drop("n")
            now = checkpointed(left.groupBy("part").agg(F.count("*").alias("n")))
            after = now.agg(F.sum("n")).first()[0] or 0
            if rows.where(F.col("n") > CHUNK).isEmpty() or after > 0.8 * before:
                break
            rows, before = stored(left.join(now, "part"), "large"), after
        roots = connected_components(reduce(DataFrame.unionByName, links[1:])).withColumnRenamed("node", "_n")
        placed = full.select("part", "node", "n").join(roots, F.col("node") == F.col("_n"), "left").select("part", "node", "n", F.coalesce("root", "node").alias("root"))
        clusters = placed.groupBy("part", "root").agg(F.count("*").alias("m"))
        main = clusters.groupBy(F.col("part").alias("_p")).agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        minor = checkpointed(placed.join(main, F.col("part") == F.col("_p")).where("root <> main").select("part", "node", "n"))
        if not minor.isEmpty():
            of = checkpointed(minor.groupBy("part").agg(F.count("*").alias("m")))

            def chunk_of(rows: str):
                return F.pmod(F.xxhash64("node", F.lit(rows)), F.ceil(F.col(rows) / CHUNK))

            def each(rows: str):
                return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(rows) / CHUNK) - 1))

            both = full.join(of, "part")
            few = both.join(minor.select(F.col("node").alias("_m")), F.col("node") == F.col("_m"), "left_semi")
            one = few.select("part", "node", "text", chunk_of("m").alias("i"), each("n").alias("j"))
            two = both.select("part", "node", "text", each("m").alias("i"), chunk_of("n").alias("j"))
            links.append(checkpointed(exact_links(one.unionByName(two).withColumn("g", F.xxhash64("part", "i", "j")), words)))
    return connected_components(reduce(DataFrame.unionByName, links))


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit for each residue of the distinct hashes: 1 if an odd number has it; as many bits as hashes or more, up to ``MOST_BITS``.

    Each hash that one of two sets has alone changes one bit, so two maps differ in no more bits than
    there are such hashes. A map of half the width is both halves of the bits added.
    """
    width = min(max(64, 1 << max(len(hashes) - 1, 0).bit_length()), MOST_BITS)
    at = (_mixed(hashes, 11) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def near_blocks(sizes: np.ndarray, maps: list[bytes], some: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows ``some`` and ``others`` whose sizes and parity maps allow a similarity of 0.8, of a bounded number of pairs at once; no pair that has it is left out."""
    wide = np.array([len(m) for m in maps], dtype=np.int64)
    folded: dict[tuple[int, int], np.ndarray] = {}

    def lanes(rows: np.ndarray, own: int, width: int, side: int) -> np.ndarray:
        if (side, own, width) not in folded:
            x = np.frombuffer(b"".join(maps[r] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
            while x.shape[1] * 8 > width:
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            folded[side, own, width] = x
        return folded[side, own, width]

    for u in np.unique(wide[some]).tolist():
        for v in np.unique(wide[others]).tolist():
            a, b, width = some[wide[some] == u], others[wide[others] == v], min(u, v)
            # sets of a similarity of 0.8 differ in size by a quarter at most, so their widths by one step
            if 5 * sizes[a].max() < 4 * sizes[b].min() or 5 * sizes[b].max() < 4 * sizes[a].min():
                continue
            x, y = lanes(a, u, width, 0), lanes(b, v, width, 1)
            step = max(1, DIRECT * DIRECT // max(len(b), 1))
            for low in range(0, len(a), step):
                one = a[low : low + step]
                differ = np.zeros((len(one), len(b)), dtype=np.int32)
                for lane in range(x.shape[1]):
                    differ += np.bitwise_count(x[low : low + step, lane][:, None] ^ y[:, lane][None, :])
                m, n = sizes[one][:, None], sizes[b][None, :]
                i, j = np.nonzero((9 * differ <= m + n) & (5 * m >= 4 * n) & (5 * n >= 4 * m))
                yield one[i], b[j]


def near_maps(sizes: np.ndarray, maps: list[bytes], some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of :func:`near_blocks`."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *near_blocks(sizes, maps, some, others)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (for each row a row of its component, the least one) after the links between the rows ``a`` and ``b``."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sets hold, ascending, and how many of some ``ORDER_SETS`` sets do; ``texts (node, text)``, at most ``ORDER_TERMS`` shingles."""
    every = max(1, -(-texts.count() // ORDER_SETS))
    some = texts.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(every)) == 0)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sets = batch.slice(at, 256), []
                for node, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if node not in seen:
                        seen.add(node)
                        sets.append(np.unique(shingle_hashes(text, words)))
                if sets:
                    h, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

    bounded_batches(texts.sparkSession)
    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    told = counts.orderBy(F.desc("n"), "h").limit(ORDER_TERMS).collect()  # a bounded list
    h, n = np.array([r.h for r in told], dtype=np.int64).view(np.uint64), np.array([r.n for r in told], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the distinct hashes by rarity, as many as a set of similarity 0.8 can not do without: two such sets share one of them.

    A similar set holds four fifths of the hashes at least. In any one order of all hashes the first
    fifth and one more of either set therefore meet.
    """
    size = len(hashes)
    keep = size - (4 * size + 4) // 5 + 1
    if not size or keep >= size:
        return hashes
    rarity = np.zeros(size, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rarity = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((_mixed(hashes, 7), rarity))[:keep]]


def shared_prefix(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many hashes the prefixes (:func:`prefix_of`) of sets of ``m`` and ``n`` hashes share at least if their similarity is 0.8.

    What the sets share, four ninths of both sizes at least, lies in both prefixes or behind that prefix
    which ends first; behind a prefix are four fifths of its set, less one.
    """
    behind = (4 * np.maximum(m, n) + 4) // 5 - 1
    return np.maximum((4 * (m + n) + 8) // 9 - behind, 1)


def missed_links(rows: DataFrame, sets: DataFrame, roots: DataFrame, words: int) -> DataFrame:
    """``a, b``: links by exact similarity between sets that ``roots (node, root)`` leaves apart; with these links the components are whole.

    Each set stands under its rarest shingles, of which any two similar sets share one, so every pair
    of similar sets meets. Of those that meet, pairs of one root, or whose sizes or parity maps rule out
    the similarity, go, and so do pairs that share too few of their rarest shingles; the texts decide
    the others. ``rows (node, text)`` may repeat a node; ``sets (node, size, map)`` has each once. A
    crowded shingle is compared chunk by chunk.
    """
    frequent, counts = _frequent(rows, words)
    spark = rows.sparkSession
    kind = "k long, node long, size int"
    key_schema = pa.schema([("k", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])

    def keys(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ks, nodes, sizes = [], [], []
                for node, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if node in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    hashes = np.unique(shingle_hashes(text, words))
                    ks.append(prefix_of(hashes, frequent, counts))
                    nodes.append(node)
                    sizes.append(len(hashes))
                if ks:
                    times = [len(k) for k in ks]
                    columns = np.concatenate(ks).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), times), np.repeat(np.array(sizes, dtype=np.int32), times)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=key_schema)

    def shared(batches):
        # a key of one node meets nothing
        for k, _, node, size in _groups(pa.RecordBatch.from_arrays([b.column(n) for n in (0, 0, 1, 2)], names=["t", "k", "node", "size"]) for b in batches):
            node, at = np.unique(node, return_index=True)
            if len(node) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, dtype=np.int64)), pa.array(node), pa.array(size[at])], schema=key_schema)

    bounded_batches(spark)
    dealt = rows.mapInArrow(keys, kind).repartition("k").sortWithinPartitions("k").mapInArrow(shared, kind)
    placed = stored(dealt.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("k", "node", "size", F.coalesce("root", "node").alias("root")), "shared")
    held = placed.groupBy("k", "root").agg(F.count("*").alias("m"))
    groups = held.groupBy("k").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main")).where("n > most")
    groups = checkpointed(groups.select("k", "n", (F.col("n") - F.col("most")).alias("few"), "main"))
    size = max(GROUP, 1)

    def chunk_of(n: str):
        return F.pmod(F.xxhash64("node", F.lit(n)), F.ceil(F.col(n) / size))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / size) - 1))

    both = placed.join(groups, "k")
    # few pairs are counted key by key; two similar sets share as many of their rarest shingles as :func:`shared_prefix` says
    little = F.col("n") * F.col("few") <= DIRECT
    counted_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64())])

    def count(batches):
        for _, _, node, size, root in _groups(pa.RecordBatch.from_arrays([b.column(n) for n in (0, 0, 1, 2, 3)], names=["t", "k", "node", "size", "root"]) for b in batches):
            i, j = np.nonzero((node[:, None] < node[None, :]) & (root[:, None] != root[None, :]))
            m, n = size[i].astype(np.int64), size[j].astype(np.int64)
            near = (5 * m >= 4 * n) & (5 * n >= 4 * m)
            if near.any():
                columns = node[i[near]], node[j[near]], shared_prefix(m[near], n[near])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=counted_schema)

    counted = both.where(little).select("k", "node", "size", "root").repartition("k").sortWithinPartitions("k").mapInArrow(count, "a long, b long, need long")
    enough = counted.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("need").alias("need")).where("c >= need").select("a", "b")
    # of crowded keys, what is not of the largest component meets all that the key has, and the maps decide
    both = both.where(~little)
    minor = both.where("root <> main").select("k", "node", "root", chunk_of("few").alias("i"), each("n").alias("j"), F.lit(True).alias("side"))
    all_ = both.select("k", "node", "root", each("few").alias("i"), chunk_of("n").alias("j"), F.lit(False).alias("side"))
    tiles = minor.unionByName(all_).select(F.xxhash64("k", "i", "j").alias("t"), "k", "node", "root", "side")
    tiles = tiles.join(sets.select(F.col("node").alias("_n"), "size", "map"), F.col("node") == F.col("_n")).select("t", "k", "node", "root", "side", "size", "map")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        # only the components of the pairs are asked for, so a tile gives links that span them and not its pairs
        for _, _, node, root, side, sizes, maps in _groups(batches):
            side = side.astype(bool)
            own, at = np.unique(node, return_inverse=True)
            label = np.arange(len(own))
            for a, b in near_blocks(sizes.astype(np.int64), list(maps), np.flatnonzero(side), np.flatnonzero(~side)):
                apart = root[a] != root[b]
                label = joined_labels(label, at[a[apart]], at[b[apart]])
            far = label != np.arange(len(own))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[label[far]]), pa.array(own[far])], schema=schema)

    ruled = tiles.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(meet, "a long, b long").distinct()
    parts = checkpointed(connected_components(stored(enough.unionByName(ruled), "pairs")).withColumnRenamed("root", "part"))
    nodes = parts.select("node")
    nodes = F.broadcast(nodes) if parts.count() <= SENT_NODES else nodes
    texts = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    found = exact_components(stored(texts.join(parts, "node").select("part", "node", "text"), "texts"), words)
    return checkpointed(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def keep_one(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without near-duplicates: of each component exactly one row stays.

    Documents link if the sets of their word shingles, repeats left out, have a Jaccard similarity of
    0.8 or more. Blocks and SimHash fingerprints of the sets propose components, and within each of
    them the sets themselves decide; what they have not proposed is met by its rarest shingles, so no
    link is lost. Texts of equal shingle sets, by two hashes of 64 bits, always link,
    so null, empty and blank texts do. The row that stays is the one with the smallest id, rows without an id last; of several
    the one with the smallest hash of all its columns, so the result does not depend on the order of
    the rows. Repeated rows are one row afterwards; columns of any name are carried; an empty table
    gives an empty one. Ids must be numbers.
    """
    names, text_at = df.columns, place_of(df, text_col)
    plain = numbered(df)
    own_id = F.col(f"c{place_of(df, id_col)}").cast("long")
    source = plain.select(
        *plain.columns, F.monotonically_increasing_id().alias("rid"), own_id.alias("id"), row_hash(plain).alias("hash"), F.col(f"c{text_at}").cast("string").alias("body")
    )
    target = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL("node long, check long, size int, map binary, fp binary, blocks array<long>").fields])
    out_schema = arrow_schema(target)

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, check, size, maps, fp, blocks = [], [], [], [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    hashes = np.unique(shingle_hashes(text, words))
                    node.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42) >> (64 - NODE_BITS))
                    check.append(xxhash.xxh64_intdigest(hashes.tobytes(), 43))
                    size.append(len(hashes))
                    maps.append(parity_map(hashes))
                    fp.append(majority_bits(hashes, LANES))
                    blocks.append(set_blocks(hashes))
                ends = np.cumsum([0, *map(len, blocks)])
                columns = [
                    *part.columns[:-1], *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, check)),
                    pa.array(size, pa.int32()), pa.array(maps, pa.binary()), pa.array(fp, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(blocks))),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    bounded_batches(df.sparkSession)
    rows = stored(source.mapInArrow(run, target), "sets")
    sets = rows.groupBy("node", "check").agg(F.min("rid").alias("rid"), *[F.any_value(c).alias(c) for c in ("size", "map", "fp", "blocks")])
    # different sets of one first hash, of which there are hardly any, get nodes of their own
    same = F.row_number().over(Window.partitionBy("node").orderBy("check"))
    sets = stored(sets.withColumn("first", F.col("node")).withColumn("node", F.when(same == 1, F.col("node")).otherwise(F.xxhash64("node", "check"))), "nodes")
    moved = sets.where("node <> first").select("first", F.col("check").alias("_check"), F.col("node").alias("own"))
    nodes = rows.select("rid", "id", "hash", "node", "check")
    if not moved.isEmpty():
        nodes = nodes.join(moved, (F.col("node") == F.col("first")) & (F.col("check") == F.col("_check")), "left").withColumn("node", F.coalesce("own", "node"))
    parts = checkpointed(connected_components(set_links(sets)).select(F.col("node").alias("_n"), F.col("root").alias("part")))
    # the text of one row a set
    asked = sets.select("node", F.col("rid").alias("_rid")).join(parts, F.col("node") == F.col("_n")).select("part", "node", "_rid")
    texts = stored(rows.select("rid", F.col(f"c{text_at}").cast("string").alias("text")).join(asked, F.col("rid") == F.col("_rid")).select("part", "node", "text"), "texts")
    roots = checkpointed(exact_components(texts, words))
    bodies = rows.select("rid", "node", "check", F.col(f"c{text_at}").cast("string").alias("text"))
    if not moved.isEmpty():
        bodies = bodies.join(F.broadcast(moved), (F.col("node") == F.col("first")) & (F.col("check") == F.col("_check")), "left").withColumn("node", F.coalesce("own", "node"))
    missed = missed_links(bodies.select("node", "text"), sets, roots, words)
    if not missed.isEmpty():
        roots = checkpointed(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed)))
    roots = roots.withColumnRenamed("node", "_n")
    narrow = nodes.join(roots, F.col("node") == F.col("_n"), "left").select("rid", "id", "hash", F.coalesce("root", "node").alias("root"))
    narrow = checkpointed(narrow)
    order = F.struct(F.col("id").isNull().alias("x"), "id", "hash", "rid")
    best = narrow.groupBy(F.col("root").alias("_r")).agg(F.min_by("rid", order).alias("best"), F.count("*").alias("n")).where("n > 1").select("_r", "best")
    gone = narrow.join(checkpointed(best), F.col("root") == F.col("_r")).where("rid <> best").select(F.col("rid").alias("_gone"))
    return rows.join(checkpointed(gone), F.col("rid") == F.col("_gone"), "left_anti").select(*plain.columns).toDF(*names)
