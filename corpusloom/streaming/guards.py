"""Ingest guards on streams: time gate, version and size gates, replay, rate limit, expiry, bursts.

Each guard takes a DataFrame that may stream or not. State is bounded by event time: watermarks drop
nonces, and rate limits keep at most the accepted times of a trailing window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify
from . import ordered

# Gates of the ingest endpoint.
LIVE_SKEW_S, LEGACY_SKEW_S = 15 * 60, 90
LIVE_BYTES, LEGACY_BYTES = 2 << 20, 50_000
VERSION = "1"
RATE_CALLS, RATE_SECONDS = 10, 60
SESSION_TTL_S = 3600


def fresh(ts: Column, now: Column, skew_s: int = LIVE_SKEW_S) -> Column:
    """Neither late nor from the future by more than the skew."""
    return F.abs(F.unix_timestamp(ts) - F.unix_timestamp(now)) <= skew_s


def valid_payload(version: Column, content: Column, limit: int = LIVE_BYTES) -> Column:
    return (version == VERSION) & (F.octet_length(content) <= limit)


def signed(df: DataFrame, secret: bytes, fields: list[str], signature: str = "sig") -> DataFrame:
    """Rows whose signature is the HMAC-SHA256 of the fields, joined by line ends, in hex."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import hmac

        for pdf in batches:
            told = ["\n".join("" if v is None else str(v) for v in row) for row in pdf[fields].itertuples(index=False)]
            good = [hmac.compare_digest(hmac.new(secret, t.encode(), hashlib.sha256).hexdigest(), s or "") for t, s in zip(told, pdf[signature], strict=True)]
            yield pdf[good]

    return df.mapInPandas(check, df.schema)


def first_use(df: DataFrame, nonce: str = "nonce", ts: str = "ts", memory: str = "15 minutes", tie: str | None = None) -> DataFrame:
    """The first row of each nonce, of equal times that with the smallest ``tie``, or hash of its columns; a stream forgets nonces after the memory.

    The memory is the time gate's width.
    """
    if df.isStreaming:
        return df.withWatermark(ts, memory).dropDuplicatesWithinWatermark([nonce])
    own = Window.partitionBy(nonce).orderBy(ts, tie or F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def accepted_times(times: list[float], held: list[float], calls: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which calls in order of time are accepted: fewer than ``calls`` accepted ones lie less than ``seconds`` back; rejected ones do not count."""
    out = []
    for t in times:
        held = [h for h in held if t - h < seconds]
        out.append(len(held) < calls)
        if out[-1]:
            held.append(t)
    return out, held


def rate_limited(df: DataFrame, client: str = "client", ts: str = "ts", calls: int = RATE_CALLS, seconds: int = RATE_SECONDS) -> DataFrame:
    """``client, ts, id, accepted`` for batches of ``client, ts, id``, client by client in order of time, then id.

    A client's rows are streamed through the fold in sorted batches; only the accepted times of the
    trailing window are kept between batches, so a client with many calls needs no more memory than others.
    """
    rows = df.select(F.col(client).alias("client"), F.col(ts).alias("ts"), F.col("id"))
    return ordered.fold_table(rows, ordered.RateLimit(calls, seconds), "client")


def rate_limited_stream(df: DataFrame, client: str = "client", ts: str = "ts", calls: int = RATE_CALLS, seconds: int = RATE_SECONDS) -> DataFrame:
    """The same on a stream, for calls that must be answered at once: each micro-batch is judged as it arrives, in order of time.

    State is the list of accepted times, which expires when the watermark is past the window. Calls that
    come late are judged late; ``ordered.fold_stream`` waits for them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        # only times and ids of a client's batch are sorted, and only the accepted times of the window are kept
        calls_of = sorted((t, i) for pdf in batches for t, i in zip(pdf["ts"], pdf["id"], strict=True))
        flags, held = accepted_times([t.timestamp() for t, _ in calls_of], held, calls, seconds)
        last = max(held, default=calls_of[-1][0].timestamp())
        state.update((held,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "ts": [t for t, _ in calls_of], "id": [i for _, i in calls_of], "accepted": flags})

    rows = df.select(F.col(client).alias("client"), F.col(ts).alias("ts"), F.col("id")).withWatermark("ts", f"{seconds} seconds")
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    return rows.groupBy("client").applyInPandasWithState(step, schema, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def expired(created: Column, now: Column, ttl_s: int = SESSION_TTL_S) -> Column:
    """Counts from creation, not from the last use."""
    return F.unix_timestamp(now) - F.unix_timestamp(created) > ttl_s


def debounced(df: DataFrame, key: str, ts: str = "ts", gap: str = "300 milliseconds") -> DataFrame:
    """The last event of each burst of a key: ``key, ts, id, events``."""
    last = F.max_by("id", F.struct(ts, "id"))
    return df.groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias("ts"), last.alias("id"), F.count("*").alias("events")).drop("session_window")


def spaced(df: DataFrame, key: str, ts: str = "ts", seconds: int = 5) -> DataFrame:
    """Events at least so many seconds after the last accepted one of the key."""
    rows = df.select(F.col(key).alias("client"), F.col(ts).alias("ts"), F.col("id"))
    return ordered.fold_table(rows, ordered.RateLimit(1, seconds, rejects=False), "client").drop("accepted")


def stable(df: DataFrame, key: str, ts: str = "ts", size: str = "size", change: int = 100, times: int = 2) -> DataFrame:
    """``key, ts, size``: the first look at each key whose size has changed by less than ``change`` so many times in a row.

    Looks are ordered by time, then size; keys that never settle are left out.
    """
    looks = Window.partitionBy(key).orderBy(ts, size)
    calm = (F.abs(F.col(size) - F.lag(size).over(looks)) < change).cast("int")
    run = F.sum(F.coalesce("_calm", F.lit(0))).over(looks.rowsBetween(-(times - 1), 0))
    settled = df.withColumn("_calm", calm).withColumn("_run", run).where(F.col("_run") >= times)
    return settled.groupBy(key).agg(F.min_by(F.struct(ts, size), F.struct(ts, size)).alias("_l")).select(key, f"_l.{ts}", f"_l.{size}")


def worth_extracting(kind: Column, since_s: Column, content: Column, gap_s: int = 5, least: int = 500) -> Column:
    """Not on mere changes of focus, not within the gap after the last extraction, and not for short contents."""
    return ~kind.isin("visibility", "focus") & (since_s.isNull() | (since_s >= gap_s)) & (F.length(content) >= least)


def accepted_events(df: DataFrame, now: Column, calls: int = RATE_CALLS, seconds: int = RATE_SECONDS) -> DataFrame:
    """The gates of the ingest endpoint in one pipeline: ``nonce, client, ts, url, content`` of the events that pass.

    ``df (nonce, client, ts, version, url, content)`` may stream: version and size, time gate, domain,
    first use of a nonce, then the rate of each client, of which rejected calls do not count. ``now`` may
    be the column of arrival. A stream judges an event when the watermark has passed it. The watermark
    lies back by the width of the time gate on both sides, so no event that passes the gate on its
    arrival is behind it, and the result is that of the table.
    """
    good = df.where(valid_payload(F.col("version"), F.col("content")) & fresh(F.col("ts"), now) & ~classify.blocked_domain(F.col("url")))
    used = first_use(good, "nonce", "ts", f"{2 * LIVE_SKEW_S} seconds").select("nonce", "client", "ts", "url", "content")
    if df.isStreaming:
        rated = ordered.fold_stream(used, ordered.RateLimit(calls, seconds, rejects=False), "client", "ts", "nonce", ["url", "content"])
        return rated.select(used.columns)
    rated = rate_limited(used.withColumn("id", F.col("nonce")), "client", "ts", calls, seconds).where("accepted").select(F.col("id").alias("_id"))
    return used.join(rated, F.col("nonce") == F.col("_id"), "left_semi")


def telemetry(df: DataFrame, ts: str = "ts", window: str = "1 minute", by: str = "method") -> DataFrame:
    return df.groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
