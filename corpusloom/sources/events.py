"""Ingest events as a stream of JSON lines, the shape in which pages are posted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "nonce string, client string, ts timestamp, version string, title string, url string, content string, method string"


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Events of the JSON files that arrive in a folder; lines that are no event have null fields and fail the gates."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the files that are there."""
    return spark.read.schema(SCHEMA).json(folder)
