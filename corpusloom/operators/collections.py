"""Maintenance and statistics of collections: upsert, delete, groups, listings, caches, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def _first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; what the order leaves open is decided by a hash of the row."""
    own = Window.partitionBy(key).orderBy(*order, F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """All stored rows whose key is not in the new ones, and of the new ones the last of each key; of equal ones that with the smallest hash of its columns."""
    last = _first(new, key, F.desc(order))
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Groups are created once: stored rows win, and of new ones of a key that with the smallest hash of its columns."""
    return stored.unionByName(_first(new, key).join(stored.select(key), key, "left_anti"))


def delete_documents(stored: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def chunk_points(chunks: DataFrame) -> DataFrame:
    """Chunks with an embedding as points: a hashed id, the vector and the payload."""
    return chunks.where("embedding is not null").select(
        F.substring(F.sha2(F.col("chunk_id").cast("string"), 256), 1, 32).alias("point_id"), "chunk_id", "doc_id", "content", "embedding",
        F.coalesce("confidence", F.lit(0.85)).alias("confidence"),
    )


def embeddable(content: Column) -> Column:
    return (F.trim(content) != "") & ~F.startswith(content, F.lit("EXTRACTION FAILED"))


def list_documents(chunks: DataFrame) -> DataFrame:
    """``doc_id, n_chunks, confidence, sample``: the sample is the start of the first non-empty chunk."""
    first = F.min_by("content", F.when(F.trim("content") != "", F.col("chunk_idx")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.avg("confidence").alias("confidence"), F.substring(first, 1, 200).alias("sample"))


def chunk_stats(chunks: DataFrame, by: str = "chunk_source") -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.octet_length("content")).alias("mean_bytes"))


def global_confidence(ocr: Column, business: Column, chunk_mean: Column) -> Column:
    """Mean of the parts that exist: 0.8 for recognised or 1 for native text, the business score, the chunks' mean."""
    parts = F.array(F.when(ocr, 0.8).otherwise(1.0), business, chunk_mean)
    held = F.filter(parts, lambda p: p.isNotNull())
    return F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held)


def session_confidence(mean_confidence: Column, ocr_confidence: Column, embedded_share: Column) -> Column:
    return 0.4 * mean_confidence + 0.3 * ocr_confidence + 0.3 * embedded_share


def session_stats(sessions: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """``sessions, chunks, embedded, expired``; age counts from creation."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return sessions.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_embedded"), F.lit(0)).alias("embedded"),
        F.coalesce(F.sum((age > ttl_s).cast("int")), F.lit(0)).alias("expired"),
    )


def live_sessions(sessions: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    return sessions.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_s)


def latest_versions(cache: DataFrame, key: str, modified: str = "modified") -> DataFrame:
    """The newest entry of each key, of equal ones that with the smallest hash of its columns; older ones are stale."""
    return _first(cache, key, F.desc(modified))


def evict(entries: DataFrame, needed: int, score: str = "eviction_score", size: str = "size", by: str | None = None) -> DataFrame:
    """Entries to evict, lowest scores first, until the needed size is free; ``by`` splits into caches."""
    groups = [by] if by else []
    # cut by score first: what lies above the scores that free enough is never ordered
    steps = entries.groupBy(*groups, F.floor(F.col(score)).alias("_step")).agg(F.sum(size).alias("_size"))
    below = Window.partitionBy(*groups).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # one row a step of the score
    enough = steps.withColumn("_before", F.coalesce(F.sum("_size").over(below), F.lit(0))).where(F.col("_before") < needed)
    named = enough.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_step"), "_before")
    step = F.floor(F.col(score)) == F.col("_step")
    for g in groups:
        step = step & (F.col(g) == F.col(f"_{g}"))
    left = entries.join(named, step).drop(*[f"_{g}" for g in groups])
    own = Window.partitionBy(*groups, "_step").orderBy(score, "key").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_before") + F.coalesce(F.sum(size).over(own), F.lit(0))
    return left.withColumn("_freed", freed).where(F.col("_freed") < needed).drop("_freed", "_before", "_step")


def cap_cache(entries: DataFrame, max_entries: int, newest: str = "last_access", by: str = "cache") -> DataFrame:
    """Keeps the entries used last of each cache."""
    own = Window.partitionBy(by).orderBy(F.desc(newest), "key")
    return entries.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= max_entries).drop("_n")


def cap_conversations(conversations: DataFrame, limit: int = 100, owner: str = "owner") -> DataFrame:
    """The newest conversations of each owner; one row an id, the last written."""
    once = latest_versions(conversations, "conv_id", "updated_at")
    own = Window.partitionBy(owner).orderBy(F.desc("updated_at"), "conv_id")
    return once.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= limit).drop("_n")


# Keywords of conversation tags.
TAGS = {
    "code": ("code", "programming", "fonction", "script", "debug", "error"),
    "documentation": ("doc", "documentation", "readme", "guide", "tutorial"),
    "analyse": ("analyse", "analyser", "étudier", "examiner", "rapport"),
    "création": ("créer", "générer", "faire", "construire", "développer"),
    "question": ("comment", "pourquoi", "que", "quoi", "quel", "?"),
    "technique": ("api", "base de données", "serveur", "réseau", "système"),
}


def conversation_title(first_message: Column) -> Column:
    """The first six words without punctuation."""
    bare = F.regexp_replace(first_message, r"[^\p{L}\p{N}\s_]", "")
    return F.array_join(F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, 6), " ")


def conversation_tags(text: Column) -> Column:
    low = F.lower(text)
    found = [F.when(_any(low, words), F.lit(tag)) for tag, words in TAGS.items()]
    held = F.filter(F.array(*found), lambda t: t.isNotNull())
    return F.when(F.size(held) == 0, F.array(F.lit("général"))).otherwise(held)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def running_metrics(requests: DataFrame, by: str = "app") -> DataFrame:
    """Count, mean latency and success rate of each app."""
    return requests.groupBy(by).agg(F.count("*").alias("n"), F.avg("latency").alias("mean_latency"), F.avg(F.col("ok").cast("double")).alias("success_rate"))


#: Rows of a group over which its moving average is folded at a time.
AVERAGE_ROWS = 50_000


def moving_average(events: DataFrame, by: str, order: str, value: str, keep: float) -> DataFrame:
    """Exponential moving average: ``keep`` of the old value and the rest of the new one, from the first value on.

    ``order`` is a number. A group's rows are cut into stretches of it, in each of which the average is a
    weighted sum by row numbers; stretches follow each other by one multiplication, so no group meets in
    one task.
    """
    span = events.agg(F.min(order), F.max(order), F.count("*")).first()
    cuts = max(1, -(-(span[2] or 0) // AVERAGE_ROWS))
    width = max(1, -(-((span[1] or 0) - (span[0] or 0) + 1) // cuts))
    rows = events.select(by, F.floor((F.col(order) - F.lit(span[0] or 0)) / width).alias("_part"), F.col(order).alias("_o"), F.col(value).cast("double").alias("v"))
    own = Window.partitionBy(by, "_part")
    numbered = rows.select(by, "_part", "v", F.row_number().over(own.orderBy("_o", "v")).alias("i"), F.count("*").over(own).alias("n"))
    weight = (1 - keep) * F.pow(F.lit(keep), F.col("n") - F.col("i"))
    parts = numbered.groupBy(by, "_part").agg(F.sum(weight * F.col("v")).alias("s"), F.max("n").alias("n"), F.min_by("v", "i").alias("first"))
    # one row a stretch: the first value of all stands in for what came before it
    listed = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_part", "s", "n", "first"))).alias("p"))
    return listed.select(by, F.aggregate("p", F.get("p", F.lit(0))["first"], lambda a, x: a * F.pow(F.lit(keep), x["n"]) + x["s"]).alias("ema"))


def latency_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    """``by, low, mean, p50, p95, p99, high``; percentiles are exact, and no group's values meet in one buffer."""
    plain = runs.groupBy(by).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    told = selection.percentiles(runs, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed(by, "_by")
    return plain.join(told, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "low", "mean", "p50", "p95", "p99", "high")


def hit_ratio(requests: DataFrame) -> DataFrame:
    return requests.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("ratio"))


def create_collection(catalog: DataFrame, name: str, dims: int, distance: str = "Cosine") -> DataFrame:
    """``name, dims, distance`` with the collection; one that exists stays as it is."""
    new = catalog.sparkSession.createDataFrame([(name, dims, distance)], "name string, dims int, distance string")
    return insert_absent(catalog.select("name", "dims", "distance"), new, "name")


def drop_collection(catalog: DataFrame, name: str) -> DataFrame:
    """The catalog without the collection; one that does not exist is no error."""
    return catalog.where(F.col("name") != name)


def collection_of(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the collection of its group, null for groups that do not exist."""
    known = groups.select(F.col("group_id").alias("_g"), "collection")
    return asked.join(known, F.col("group_id") == F.col("_g"), "left").drop("_g")


def conversation_totals(rows: DataFrame) -> DataFrame:
    """``model, conversations, messages, mean_messages`` of ``conv_id, model, n_messages``; the mean is rounded."""
    return rows.groupBy("model").agg(F.count("*").alias("conversations"), F.sum("n_messages").alias("messages"), F.round(F.avg("n_messages")).cast("long").alias("mean_messages"))


def method_histogram(requests: DataFrame, by: str = "app", method: str = "method") -> DataFrame:
    return requests.groupBy(by, method).agg(F.count("*").alias("n"))


def overlap_stats(chunks: DataFrame, overlap: Column) -> DataFrame:
    """``chunks, mean_bytes, overlap_percent``."""
    return chunks.agg(F.count("*").alias("chunks"), F.avg(F.octet_length("content")).alias("mean_bytes"), F.max(overlap * 100.0).alias("overlap_percent"))


def model_summary(models: DataFrame) -> DataFrame:
    """``total_size, popular, categories`` of ``name, size, downloads, category``: those above the mean of downloads are popular."""
    mean = models.agg(F.avg("downloads").alias("mean"))
    return models.join(F.broadcast(mean), how="cross").agg(  # one row
        F.sum("size").alias("total_size"), F.count_if(F.col("downloads") > F.col("mean")).alias("popular"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
