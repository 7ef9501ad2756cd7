"""Sessions over ingested documents: opened with their chunks, listed, read and expired by their age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collections import embeddable, live_sessions, session_confidence


def open_sessions(chunks: DataFrame, created_at: Column, ocr_confidence: Column) -> DataFrame:
    """``session_id, doc_id, created_at, chunks, embedded, confidence``: a session for each document of ingested chunks.

    A chunk counts as embedded if it has a vector and its text is fit for one. The id follows from the
    document and the time, so opening it again gives the same session.
    """
    fit = embeddable(F.col("content")) & F.col("embedding").isNotNull()
    held = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(fit).alias("embedded"), F.avg("confidence").alias("mean"))
    named = held.withColumns({
        "created_at": created_at,
        "session_id": F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), created_at.cast("string")), 256), 1, 32),
        "confidence": session_confidence(F.col("mean"), ocr_confidence, F.col("embedded") / F.col("chunks")),
    })
    return named.select("session_id", "doc_id", "created_at", "chunks", "embedded", "confidence")


def list_sessions(sessions: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """The live sessions with their age in seconds."""
    return live_sessions(sessions, now, ttl_s).withColumn("age_s", F.unix_timestamp(now) - F.unix_timestamp("created_at"))


def get_sessions(sessions: DataFrame, wanted: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """The live ones of the sessions of ``wanted (session_id)``; expired ones are gone on reading."""
    return live_sessions(sessions, now, ttl_s).join(wanted.select("session_id").distinct(), "session_id", "left_semi")


def close_sessions(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select("session_id").distinct(), "session_id", "left_anti")
