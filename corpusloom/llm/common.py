"""Shared helpers of the training-data operators: shared folder, bounded Arrow streaming, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import bounded_batches, checkpointed, clear_stored, scan, shared_dir, stored

__all__ = ["bounded_batches", "checkpointed", "clear_stored", "scan", "shared_dir", "stored"]

#: Output bytes that a Python worker gathers before it hands a batch to Spark.
FLUSH_BYTES = 8 << 20
#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 128
#: Rows of a narrow table for a partition, and partitions that it may have however few rows it has.
PART_ROWS, LEAST_PARTS = 50_000, 8


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with the columns ``c0, c1, ...``: no name of the input can clash with a helper, whatever its case."""
    return df.toDF(*[f"c{n}" for n in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> int:
    """Where the column is: by its exact name, else by any case."""
    if name in df.columns:
        return df.columns.index(name)
    low = [c.lower() for c in df.columns]
    if name.lower() not in low:
        raise ValueError(f"no column {name}")
    return low.index(name.lower())


def row_hash(df: DataFrame, *salt: Column) -> Column:
    """A hash of all columns of a numbered table; maps, which have no order, are hashed as JSON."""
    return F.xxhash64(*salt, *[F.to_json(c) if "map<" in kind else F.col(c) for c, kind in df.dtypes])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[..., Iterable[tuple]]],
) -> DataFrame:
    """Apply a row function in Arrow batches with bounded memory.

    ``make()`` runs once a task and returns ``work(*columns) -> iterable of output tuples``.
    """
    bounded_batches(df.sparkSession)
    target = T.StructType.fromDDL(schema)
    out_schema = arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for record in work(*row):
                        rows.append(record)
                        size += 64 + sum(len(v) for v in record if isinstance(v, (str, bytes)))
                        if size >= FLUSH_BYTES:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    return df.mapInArrow(run, target)


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more partitions than these need."""
    return df.coalesce(max(LEAST_PARTS, rows // PART_ROWS))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two comparable, non-null columns ``a`` and ``b``. Returns ``node, root`` for every node
    that an edge names; ``root`` is the smallest node of its component. Each step is a pre-aggregated
    minimum, stored, and a plain join of two exchanges, which adaptive execution splits where many
    neighbours meet one hub; each round ends in a reliable checkpoint. Tables of few rows are kept in
    few partitions, since each partition of a step is files of its own, however few rows it has.
    """

    def kept(df: DataFrame) -> DataFrame:
        return narrowed(df, rows)

    def lowest(e: DataFrame) -> DataFrame:
        return checkpointed(kept(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))))

    def settled(e: DataFrame) -> bool:
        """Whether each edge leads from a node of one edge to the centre of its star, which no further round changes."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        return ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf > 0 and centre > 0").isEmpty()

    e = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while rows := e.count():
        e = kept(e)
        if settled(e):
            break
        # a node's neighbours are larger ones, which rows name second, and smaller ones, which rows name first
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.where("b > a")
            .join(lowest(both), F.col("a") == F.col("k"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = checkpointed(kept(kept(large).distinct()))
        least = lowest(large)
        small = (
            large.join(least, F.col("a") == F.col("k"))
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        e = checkpointed(kept(kept(small).distinct()))
    roots = kept(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
