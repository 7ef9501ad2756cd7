"""Tables in the folder that the driver and all executors share, and scans that use all cores."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a scan for each core below which its few splits are dealt to all cores.
SPLIT_BYTES = 4 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 32 << 20
#: Rows of a batch that a task turns into others at once.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all runs on one machine (tests) a temporary folder is made
    and set; a cluster without the setting is an error, as its executors would not see the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not folder:
        current = jsc.getCheckpointDir()
        if current.isDefined():
            return str(current.get())
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its stored tables, or inside :func:`scratch` those of its block."""
    return f"{shared_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}{_BLOCK.get()}"


_BLOCK: ContextVar[str] = ContextVar("block", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that its block has stored; what is to stay must be written elsewhere by then."""
    block = _BLOCK.set(f"{_BLOCK.get()}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, tables_dir(spark))
        _BLOCK.reset(block)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all tables that this application has stored, when no result that reads them is needed any more."""
    _delete(spark, tables_dir(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts and vectors do not gather in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, few at a time, for steps that make several rows of each."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE_ROWS):
            yield pdf.iloc[at : at + SLICE_ROWS]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of so few bytes that its splits can't occupy all cores is dealt to them once.

    A table above ``SPLIT_BYTES`` a core, as all large ones are, is read as its splits lie.
    """
    bounded_batches(spark)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
