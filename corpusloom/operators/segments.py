"""A word index that is kept up by segments: upserts add one, deletes leave tombstones, merges rewrite the small ones.

A segment is immutable. ``terms`` has a row for each document with the counts of its words and pairs,
in order of id; ``postings`` has a row for each of them, by buckets of terms. A tombstone says up to
which segment a document is gone. Frequencies and lengths are sums of deltas: a segment adds those of
its documents, and a tombstone takes away those of the version that it ends, which are read from that
version's row and not from its text. So a change reads the texts of what has changed, and nothing else.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_tokens
from ..storage import bounded_batches, checkpointed, stored, tables_dir
from . import bm25

#: Buckets of terms; a search reads those of its terms.
BUCKETS = 64
#: Segments of one size that are merged; the sizes are powers of it.
FAN = 4


def _bucket(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_TERMS = "doc_id long, dl long, terms array<struct<term: string, tf: bigint, uf: bigint>>"
#: Texts whose terms are counted at once.
ROWS = 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_TERMS`` for rows of ``doc_id, bare array<string>``: how often each term is a word or a pair of neighbours, and how often a word."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lengths, ends, terms, tf, uf = [], [0], [], [], []
            for words in part.column(1).to_pylist():
                single = Counter(words)
                both = Counter(single)
                both.update(f"{a}_{b}" for a, b in pairwise(words))
                lengths.append(2 * len(words) - min(len(words), 1))
                terms += both
                tf += both.values()
                uf += [single.get(t, 0) for t in both]
                ends.append(len(terms))
            columns = [pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(uf, pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["term", "tf", "uf"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), lists], names=["doc_id", "dl", "terms"])


@dataclass(frozen=True)
class Segment:
    number: int
    path: str
    rows: int


@dataclass(frozen=True)
class SegmentedIndex:
    """``segments``, the folders of tombstones with the greatest number that they reach, those of frequency deltas, and the sums of rows and lengths."""

    spark: SparkSession
    folder: str
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[tuple[int, str], ...] = ()
    deltas: tuple[str, ...] = ()
    number: int = 1
    rows: int = 0
    length: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> SegmentedIndex:
        return SegmentedIndex(spark, f"{tables_dir(spark)}/segments-{uuid.uuid4().hex}")

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _gone(self) -> DataFrame | None:
        """``_d, upto``: documents and the segment before which their rows are dead."""
        paths = [p for _, p in self.tombstones]
        return self.spark.read.parquet(*paths).select(F.col("doc_id").alias("_d"), "upto") if paths else None

    def _live(self, df: DataFrame, segment: Segment) -> DataFrame:
        if not any(upto > segment.number for upto, _ in self.tombstones):
            return df
        return df.join(self._gone().where(F.col("upto") > segment.number).select("_d").distinct(), F.col("doc_id") == F.col("_d"), "left_anti")

    def documents(self) -> DataFrame:
        """``doc_id, dl, segment`` of the live documents."""
        parts = [self._live(self.spark.read.parquet(f"{s.path}/terms").select("doc_id", "dl"), s).withColumn("segment", F.lit(s.number)) for s in self.segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "doc_id long, dl long, segment int")

    def _ended(self, ids: DataFrame, upto: int) -> SegmentedIndex:
        """Without the documents of ``ids (doc_id)``, whose rows before ``upto`` are dead."""
        dead = self.documents().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        path = self._write(dead.select("doc_id", "segment", "dl", F.lit(upto).alias("upto")), "gone")
        dead = self.spark.read.parquet(path)
        lost = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        if not lost.n:
            return self
        span = dead.agg(F.min("doc_id"), F.max("doc_id")).first()
        rows = []
        for s in self.segments:
            own = self.spark.read.parquet(f"{s.path}/terms").where(F.col("doc_id").between(*span))  # rows lie in order of id
            rows.append(own.join(dead.where(F.col("segment") == s.number).select("doc_id"), "doc_id", "left_semi").select(F.inline("terms")))
        # numbers of words and pairs that the dead rows held
        delta = reduce(DataFrame.unionByName, rows).groupBy("term").agg((-F.count("*")).alias("df"), (-F.count_if(F.col("uf") > 0)).alias("du"))
        deltas = (*self.deltas, self._write(delta, "delta"))
        return replace(self, tombstones=(*self.tombstones, (upto, path)), deltas=deltas, rows=self.rows - lost.n, length=self.length - lost.dl)

    def delete(self, ids: DataFrame) -> SegmentedIndex:
        """Without the documents of ``ids (doc_id)``; ids that are not there change nothing."""
        return replace(self._ended(ids, self.number), number=self.number + 1)

    def upsert(self, docs: DataFrame) -> SegmentedIndex:
        """With the documents of ``docs (doc_id, content)``, which replace those of their ids.

        A null content is empty; of rows of one id that with the greatest content counts; rows without an id are left out.
        """
        # ranges of ids are cut from the texts as they come, so that their terms are counted once and where they stay
        ranged = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "content").repartitionByRange("doc_id")
        docs = ranged.groupBy("doc_id").agg(F.max("content").alias("content"))
        path = f"{self.folder}/segment-{uuid.uuid4().hex}"
        bounded_batches(self.spark)
        self._write_segment(docs.select("doc_id", bare_tokens(F.coalesce("content", F.lit(""))).alias("bare")).mapInArrow(_counted, _TERMS), path, ranged=True)
        new = self.spark.read.parquet(f"{path}/terms")
        sums = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        if not sums.n:
            return self
        delta = self.spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("uf") > 0).alias("du"))
        kept = self._ended(new.select("doc_id"), self.number)
        return replace(
            kept, segments=(*kept.segments, Segment(self.number, path, sums.n)), deltas=(*kept.deltas, self._write(delta, "delta")), number=self.number + 1,
            rows=kept.rows + sums.n, length=kept.length + sums.dl,
        ).merged()

    def _write_segment(self, terms: DataFrame, path: str, ranged: bool = False) -> None:
        """``terms (doc_id, dl, terms)`` in order of id, and the postings by buckets, of which large ones lie in several files; ``ranged`` terms lie in ranges of ids."""
        (terms if ranged else terms.repartitionByRange("doc_id")).sortWithinPartitions("doc_id").write.option("compression", "zstd").parquet(f"{path}/terms")
        rows = self.spark.read.parquet(f"{path}/terms").select("doc_id", "dl", F.inline("terms")).withColumn("bucket", _bucket("term"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")

    def merged(self, fan: int = FAN) -> SegmentedIndex:
        """With each ``fan`` segments of one size made one, again and again; dead rows are left out, and tombstones that nothing needs any more.

        Deltas are added up when there are many. No text is read.
        """
        out = self
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in out.segments:
                tier = 0
                while s.rows >= fan ** (tier + 1):
                    tier += 1
                tiers.setdefault(tier, []).append(s)
            group = next((g for _, g in sorted(tiers.items()) if len(g) >= fan), None)
            if group is None:
                break
            path = f"{out.folder}/segment-{uuid.uuid4().hex}"
            out._write_segment(reduce(DataFrame.unionByName, [out._live(out.spark.read.parquet(f"{s.path}/terms"), s) for s in group]), path)
            rows = out.spark.read.parquet(f"{path}/terms").count()
            # what is live passes all tombstones there are, so the greatest number of the group says no more than is true
            left = [s for s in out.segments if s not in group] + ([Segment(max(s.number for s in group), path, rows)] if rows else [])
            out = replace(out, segments=tuple(sorted(left, key=lambda s: s.number)))
        oldest = min((s.number for s in out.segments), default=out.number)
        out = replace(out, tombstones=tuple(t for t in out.tombstones if t[0] > oldest))
        if len(out.deltas) > 2 * fan:
            out = replace(out, deltas=(out._write(out.frequencies(), "delta"),))
        return out

    def frequencies(self, wanted: DataFrame | None = None) -> DataFrame:
        """``term, df, du`` over the live documents, of all terms or those of ``wanted (term)``."""
        if not self.deltas:
            return self.spark.createDataFrame([], "term string, df long, du long")
        rows = self.spark.read.parquet(*self.deltas)
        if wanted is not None:
            rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("du").alias("du")).where("df > 0")

    def index(self, wanted: DataFrame) -> bm25.Index:
        """The index of the live documents for the terms of ``wanted (term)``, as :func:`bm25.build_index` would make it of their texts."""
        named = checkpointed(wanted.select("term").distinct())
        buckets = [r.bucket for r in named.select(_bucket("term").alias("bucket")).distinct().collect()]  # at most BUCKETS
        names = named.count()
        named = F.broadcast(named) if names <= bm25.SENT_TERMS else named
        parts = []
        for s in self.segments:
            rows = self.spark.read.parquet(f"{s.path}/postings").where(F.col("bucket").isin(buckets)).select("doc_id", "dl", "term", "tf", "uf")
            parts.append(self._live(rows.join(named, "term", "left_semi"), s))
        postings = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "doc_id long, dl long, term string, tf long, uf long")
        frequencies = checkpointed(self.frequencies(named))
        held, terms = None, ()
        if names <= bm25.SENT_TERMS:
            # a row for each document that has any, so that scores are sums within rows
            terms = tuple(sorted(r.term for r in named.collect()))
            places = F.broadcast(self.spark.createDataFrame(list(enumerate(terms)), "at int, term string"))
            rows = postings.join(places, "term").groupBy("doc_id", "dl").agg(F.sort_array(F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf"), F.col("uf").cast("int").alias("uf")))).alias("l"))
            held = stored(rows.select("doc_id", "dl", "l.at", "l.tf", "l.uf", F.array().cast("array<int>").alias("inside")), "postings")
        return bm25.Index(self.documents().select("doc_id", "dl"), postings, frequencies, self.rows, self.length / self.rows if self.rows else 0.0, held, terms)
