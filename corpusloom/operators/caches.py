"""Caches as tables: web pages by address with expiry, recognition results by file, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .collections import cap_cache

#: Bytes that a recognition result takes on average, of the cache's megabytes.
RESULT_BYTES = 50_000


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after ``new`` ones: ``key, url, content_type, content_hash, size, created_at, expires_at, accesses``.

    Of new rows of one key the last created counts. An entry whose content has not changed keeps
    everything but its expiry, which becomes the new one; others are replaced.
    """
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("expires_at"), "content_hash"))).where("_n = 1").drop("_n")
    fresh = last.select(F.col("key").alias("_k"), F.col("content_hash").alias("_h"), F.col("expires_at").alias("_e"))
    old = entries.join(fresh, F.col("key") == F.col("_k"), "left")
    kept = old.where("_k is null or content_hash = _h").withColumn("expires_at", F.coalesce("_e", "expires_at")).select(entries.columns)
    added = last.join(entries.select(F.col("key").alias("_k"), F.col("content_hash").alias("_h")), (F.col("key") == F.col("_k")) & (F.col("content_hash") == F.col("_h")), "left_anti")
    return kept.unionByName(added.select(entries.columns))


def get(entries: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``request_id, key, hit`` for ``requests (request_id, key)``: an entry counts until it expires."""
    live = entries.where(F.col("expires_at") >= now).select(F.col("key").alias("_k")).distinct()
    found = requests.join(live, F.col("key") == F.col("_k"), "left")
    return found.select("request_id", "key", F.col("_k").isNotNull().alias("hit"))


def touched(entries: DataFrame, answered: DataFrame) -> DataFrame:
    """Entries with the hits of answered requests added to their accesses."""
    hits = answered.where("hit").groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_n"))
    return entries.join(hits, F.col("key") == F.col("_k"), "left").withColumn("accesses", F.col("accesses") + F.coalesce("_n", F.lit(0))).select(entries.columns)


def invalidate(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose address the pattern does not match anywhere."""
    return entries.where(~F.rlike("url", F.lit(pattern)))


def stats_by_type(entries: DataFrame) -> DataFrame:
    """``content_type, entries, size, mean_accesses``."""
    return entries.groupBy("content_type").agg(F.count("*").alias("entries"), F.sum("size").alias("size"), F.avg("accesses").alias("mean_accesses"))


def valid_results(cache: DataFrame, files: DataFrame, now: Column, ttl_hours: int = 24, max_mb: int = 256) -> DataFrame:
    """Recognition results that may be used: ``path, size, modified, cached_at, last_used`` of files that are the same, and fresh.

    ``files (path, size, modified)`` are as they are now. Of the valid ones those used last stay, as many
    as the megabytes hold.
    """
    now_files = files.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("modified").alias("_m"))
    same = cache.join(now_files, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("modified") == F.col("_m")), "left_semi")
    fresh = same.where(F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= ttl_hours * 3600)
    most = max(max_mb * (1 << 20) // RESULT_BYTES, 10)
    return cap_cache(fresh.withColumns({"cache": F.lit("ocr"), "key": F.col("path")}), most, "last_used").select(cache.columns)


def clean(entries: DataFrame, now: Column, max_entries: int, max_age_hours: int) -> DataFrame:
    """``cache, key, cached_at`` that stay: documents up to an age and a number, the newest first; embeddings ten times as many of any age."""
    old = (F.col("cache") == "documents") & (F.unix_timestamp(now) - F.unix_timestamp("cached_at") > max_age_hours * 3600)
    limit = F.when(F.col("cache") == "embeddings", max_entries * 10).otherwise(max_entries)
    return selection.newest(entries.where(~old), "cache", "cached_at", "key", limit)
