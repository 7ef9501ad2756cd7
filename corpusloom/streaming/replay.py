"""A table of events replayed as a stream, with a restart between its slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import tables_dir


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], closing: DataFrame, by: str = "ts", slices: int = 3) -> DataFrame:
    """The rows that the streaming query ``build`` appends over ``rows``, which arrive in ``slices`` equal spans of ``by``.

    For each slice the query starts anew from its checkpoint, works on what has arrived, and stops. The
    rows of ``closing`` come last, to move the watermark past the others. Files lie in the shared folder.
    """
    spark = rows.sparkSession
    folder = f"{tables_dir(spark)}/replay-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(F.unix_micros(by)), F.max(F.unix_micros(by))).first()
    arrivals = [closing.select(rows.columns)]
    if low is not None:
        edges = [low + (high - low) * k // slices for k in range(slices)] + [high + 1]
        arrivals = [rows.where(F.unix_micros(by).between(a, b - 1)) for a, b in zip(edges, edges[1:], strict=False)] + arrivals
    for slice_ in arrivals:
        slice_.write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        running = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
