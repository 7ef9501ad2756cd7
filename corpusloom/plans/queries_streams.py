"""Queries that replay the events as a stream, in slices with a restart between them; their SQL folds the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import guards, ordered
from ..streaming.replay import replay
from .registry import query, table

#: Watermark of the folds of these queries.
WAIT = "30 minutes"


def _closing(rows: DataFrame, **values) -> DataFrame:
    """One event behind all others by more than the watermark's delay, and at whose time no other is judged any more."""
    last = rows.agg(F.max("ts").alias("ts")).select((F.coalesce("ts", F.lit("2024-01-01").cast("timestamp")) + F.expr("INTERVAL '0 00:30:00.001' DAY TO SECOND")).alias("ts"))
    return last.withColumns(values)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with times that a watermark can be laid on."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _sql_fold(rows: str, fields: str, start: str, step: str, then: str = "") -> str:
    """A fold over the rows of each key, in order: ``a`` is the state, ``x`` the row."""
    return f"""list_reduce(list_prepend({start}, list({fields} ORDER BY ts, tie)), lambda a, x: {step}){then} FROM ({rows}) GROUP BY client"""


def _limited(rows: str, calls: int, seconds: int) -> str:
    """``client, i, t``: the accepted calls of ``client, ts, tie``."""
    held = f"list_filter(a.h, lambda v: x.t - v < {seconds * 1_000_000})"
    start = "{'h': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(i VARCHAR, t BIGINT)[]), 't': CAST(0 AS BIGINT), 'i': ''}"
    row = "{'h': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(i VARCHAR, t BIGINT)[]), 't': epoch_us(ts), 'i': tie}"
    step = f"""CASE WHEN len({held}) < {calls} THEN {{'h': list_append({held}, x.t), 'o': list_append(a.o, {{'i': x.i, 't': x.t}}), 't': x.t, 'i': x.i}}
      ELSE {{'h': {held}, 'o': a.o, 't': x.t, 'i': x.i}} END"""
    return f"SELECT client, r.i AS i, r.t AS t FROM (SELECT client, unnest({_sql_fold(rows, row, start, step, '.o').replace(' FROM (', ') AS r FROM (', 1)})"


_POSTED = """SELECT user_id % 50 AS client, ts, CAST(event_id AS VARCHAR) AS tie FROM events
  WHERE event_id % 10 <> 0 AND event_id % 7 <> 0 AND event_id % 25 <= 20"""


@query(f"SELECT i AS nonce, client, make_timestamp(t) AS ts, 'https://x.org/' || i AS url FROM ({_limited(_POSTED, 3, 7200)})")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the ingest endpoint as one streaming query: events arrive up to 19 minutes late or 5 early, and each is sent again a minute later."""
    n = F.col("event_id")
    posted = _events(spark, sf_dir).select(
        n.cast("string").alias("nonce"), (F.col("user_id") % 50).alias("client"), "ts", (F.col("ts") + F.make_dt_interval(mins=(n % 25 - 5).cast("int"))).alias("arrived"),
        F.when(n % 10 == 0, "0").otherwise("1").alias("version"), F.when(n % 7 == 0, "https://paypal.com").otherwise(F.concat(F.lit("https://x.org/"), n.cast("string"))).alias("url"),
        F.lit("text").alias("content"),
    )
    again = posted.withColumn("arrived", F.col("arrived") + F.expr("INTERVAL 1 MINUTE"))
    last = {"nonce": F.lit("last"), "client": F.lit(-1).cast("long"), "arrived": F.col("ts"), "version": F.lit("1"), "url": F.lit("https://x.org"), "content": F.lit("text")}
    closing = _closing(posted, **last)
    passed = replay(posted.unionByName(again), lambda rows: guards.accepted_events(rows, F.col("arrived"), calls=3, seconds=7200), closing, by="arrived")
    return _plain(passed.select("nonce", "client", "ts", "url"))


_TTL = 2 * 86400
_END = f"(a.c // 1000000 + {_TTL} + 1) * 1000000"
_LIVES = f"""WITH m AS (SELECT (epoch_ms(max(ts)) + 1) * 1000 AS stop FROM events),
  e AS (SELECT user_id AS client, ts, CAST(event_id AS VARCHAR) AS tie, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'read' END AS action FROM events),
  f AS (SELECT client, list_reduce(list_prepend({{'c': CAST(NULL AS BIGINT), 'o': CAST([] AS STRUCT(t BIGINT, i VARCHAR, w VARCHAR)[]), 't': CAST(0 AS BIGINT), 'i': '', 'k': ''}},
      list({{'c': CAST(NULL AS BIGINT), 'o': CAST([] AS STRUCT(t BIGINT, i VARCHAR, w VARCHAR)[]), 't': epoch_us(ts), 'i': tie, 'k': action}} ORDER BY ts, tie)),
      lambda a, x: {{'c': CASE WHEN x.k = 'close' THEN NULL WHEN a.c IS NOT NULL AND {_END} > x.t THEN a.c WHEN x.k = 'open' THEN x.t END,
        'o': list_concat(CASE WHEN {_END} <= x.t THEN list_append(a.o, {{'t': {_END}, 'i': CAST(NULL AS VARCHAR), 'w': 'expired'}}) ELSE a.o END, [{{'t': x.t, 'i': x.i, 'w':
          CASE WHEN a.c IS NOT NULL AND {_END} > x.t THEN CASE x.k WHEN 'open' THEN 'exists' WHEN 'close' THEN 'closed' ELSE 'found' END WHEN x.k = 'open' THEN 'opened' ELSE 'missing' END}}]),
        't': x.t, 'i': x.i, 'k': x.k}}) AS a FROM e GROUP BY client),
  r AS (SELECT client, unnest(a.o) AS r FROM f UNION ALL SELECT client, {{'t': {_END}, 'i': NULL, 'w': 'expired'}} FROM f, m WHERE a.c IS NOT NULL AND {_END} <= stop)
SELECT client AS session, make_timestamp(r.t) AS ts, r.i AS event, r.w AS outcome FROM r"""


@query(_LIVES)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are opened, read, closed and expired by two days of age, as rows of one stream."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("read")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("session"), "ts", F.col("event_id").cast("string").alias("event"), kind.alias("action"))
    closing = _closing(rows, session=F.lit(-1).cast("long"), event=F.lit("last"), action=F.lit("read"))
    return _plain(replay(rows, lambda s: ordered.fold_stream(s.withWatermark("ts", WAIT), ordered.SessionLife(_TTL), "session", "ts", "event"), closing))


_LOOKED = "SELECT user_id AS client, ts, CAST(event_id AS VARCHAR) AS tie FROM events WHERE event_type NOT IN ('error', 'signup') AND floor(value * 10) >= 100"


@query(f"SELECT client AS page, make_timestamp(t) AS ts, CAST(i AS BIGINT) AS event FROM ({_limited(_LOOKED, 1, 3 * 86400)})")
def streamed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages extracted on navigation, with three days between extractions; focus and short contents do not count."""
    kind = F.when(F.col("event_type") == "error", "focus").when(F.col("event_type") == "signup", "visibility").otherwise("navigation")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("page"), "ts", F.col("event_id").alias("event"), kind.alias("kind"), F.floor(F.col("value") * 10).alias("length"))
    closing = _closing(rows, page=F.lit(-1).cast("long"), event=F.lit(-1).cast("long"), kind=F.lit("navigation"), length=F.lit(100).cast("long"))
    fold = ordered.Extraction(3 * 86400, 100)
    return _plain(replay(rows, lambda s: ordered.fold_stream(s.withWatermark("ts", WAIT), fold, "page", "ts", "event"), closing)).select("page", "ts", "event")


@query("""WITH l AS (SELECT user_id, ts, event_id, CAST(floor(value * 10) AS BIGINT) AS size, abs(CAST(floor(value * 10) AS BIGINT) - lag(CAST(floor(value * 10) AS BIGINT)) OVER w) < 100 AS calm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR))),
  r AS (SELECT *, coalesce(calm, false) AND coalesce(lag(calm) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)), false) AS settled FROM l)
  SELECT user_id AS page, min(ts) AS ts, arg_min(size, ts) AS size FROM r WHERE settled GROUP BY user_id""")  # fmt: skip
def streamed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time that a page's sizes have changed little twice in a row; pages are forgotten after 40 days."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("page"), "ts", F.col("event_id").alias("event"), F.floor(F.col("value") * 10).alias("size"))
    closing = _closing(rows, page=F.lit(-1).cast("long"), event=F.lit(-1).cast("long"), size=F.lit(0).cast("long"))
    fold = ordered.Stability(100, 2, 40 * 86400)
    return _plain(replay(rows, lambda s: ordered.fold_stream(s.withWatermark("ts", WAIT), fold, "page", "ts", "event"), closing)).select("page", "ts", "size")
