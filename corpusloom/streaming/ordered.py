"""Folds over the events of a key in order of event time, on streams as on tables.

A fold has a small state for each key, a step for each event, and may wake by itself when time comes
to it. On a table the rows of a key are sorted and streamed through it. On a stream they wait in state
until the watermark has passed them, so rows that arrive late, but not behind the watermark, take
their place, and the results are those of the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
#: Rows that are told at once.
MOVED_ROWS = 2000
#: Bytes of a chunk of waiting rows, and chunks that are moved at once when a bucket's state is rewritten.
CHUNK_BYTES, MOVED_CHUNKS = 256 << 10, 16
#: Buckets of keys of a stream. State, timers and messages to the state store are those of buckets, not of keys.
BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """``fields``: columns that a step reads, with their types (string or long; null is empty or 0).

    ``held`` and ``out`` are the columns of the state and of the results. Times are microseconds. The state is kept
    as JSON, so its values are strings, numbers, booleans and lists of them.
    """

    fields: dict[str, str] = {}
    held = ""
    out = ""

    def step(self, held: tuple | None, t: int, row: tuple) -> tuple[tuple | None, tuple | None]:
        """The state and the result, if any, after an event."""
        raise NotImplementedError

    def due(self, held: tuple | None) -> int | None:
        """When the fold wakes if no event comes before."""
        return None

    def wake(self, held: tuple) -> tuple[tuple | None, tuple | None]:
        return None, None

    def until(self, held: tuple | None, t: int) -> tuple[tuple | None, list[tuple[int, tuple]]]:
        """The state after all wakes up to ``t``, and their times and results."""
        told = []
        while held is not None and (at := self.due(held)) is not None and at <= t:
            held, out = self.wake(held)
            if out is not None:
                told.append((at, out))
        return held, told


@dataclass(frozen=True)
class RateLimit(Fold):
    """Accepts a call if fewer than ``calls`` accepted ones lie less than ``seconds`` back; rejected ones do not count."""

    calls: int
    seconds: float
    #: Whether rejected calls have a result.
    rejects: bool = True
    held = "times array<long>"
    out = "accepted boolean"

    def step(self, held, t, row):
        times = [h for h in (held[0] if held else ()) if t - h < self.seconds * SECOND]
        good = len(times) < self.calls
        return ((times + [t] if good else times),), ((good,) if good or self.rejects else None)

    def due(self, held):
        return int(max(held[0], default=0) + self.seconds * SECOND)


@dataclass(frozen=True)
class SessionLife(Fold):
    """A session from its opening to its end: closed, or expired by its age, however often it is read.

    Actions: ``open`` (opened, or exists), ``read`` (found, or missing), ``close`` (closed, or missing). A
    session is older than ``ttl_s`` whole seconds at the first full second that says so, and expires then.
    """

    ttl_s: int
    fields = {"action": "string"}
    held = "created long"
    out = "outcome string"

    def step(self, held, t, row):
        action = row[0]
        if action == "open":
            return held or (t,), ("exists" if held else "opened",)
        if action == "close":
            return None, ("closed" if held else "missing",)
        return held, ("found" if held else "missing",)

    def due(self, held):
        return (held[0] // SECOND + self.ttl_s + 1) * SECOND

    def wake(self, held):
        return None, ("expired",)


@dataclass(frozen=True)
class Stability(Fold):
    """The first look at which a page's size has changed by less than ``change`` so many times in a row.

    A page that nobody looks at for ``idle_s`` is forgotten, and begins anew.
    """

    change: int
    times: int
    idle_s: float
    fields = {"size": "long"}
    held = "size long, calm int, told boolean, last long"
    out = "size long"

    def step(self, held, t, row):
        (size,) = row
        calm = held[1] + 1 if held and abs(size - held[0]) < self.change else 0
        told = bool(held and held[2])
        settled = calm >= self.times and not told
        return (size, calm, told or settled, t), ((size,) if settled else None)

    def due(self, held):
        return int(held[3] + self.idle_s * SECOND)


@dataclass(frozen=True)
class Extraction(Fold):
    """Navigations after which a page is extracted: neither mere changes of focus, nor short contents, nor within the gap after the last one."""

    gap_s: float
    least: int
    fields = {"kind": "string", "length": "long"}
    held = "last long"
    out = "length long"

    def step(self, held, t, row):
        kind, length = row
        if kind in ("visibility", "focus") or length < self.least or (held and t - held[0] < self.gap_s * SECOND):
            return held, None
        return (t,), (length,)

    def due(self, held):
        return int(held[0] + self.gap_s * SECOND)


def _inner(df: DataFrame, key: str, ts: str, tie: str, fold: Fold, carried: list[str]) -> DataFrame:
    own = [F.coalesce(F.col(c).cast(kind), F.lit("" if kind == "string" else 0)).alias(f"f{n}") for n, (c, kind) in enumerate(fold.fields.items())]
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k")
    told = F.array(*[F.col(c).cast("string") for c in carried]) if carried else F.array().cast("array<string>")
    time = F.unix_micros(F.col(ts).cast("timestamp")).alias("t")
    return df.where(F.col(ts).isNotNull()).select(name, F.col(ts).alias("at"), time, F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"), *own, told.alias("carried"))


def _outer(out: DataFrame, df: DataFrame, key: str, ts: str, tie: str, fold: Fold, carried: list[str]) -> DataFrame:
    def typed(c: Column, name: str) -> Column:
        return c.cast(df.schema[name].dataType).alias(name)

    names = T.StructType.fromDDL(fold.out).names
    return out.select(
        typed(F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)), key), typed(F.timestamp_micros("t"), ts), typed(F.col("tie"), tie),
        *[F.col(f"o{n}").alias(c) for n, c in enumerate(names)], *[typed(F.try_element_at("carried", F.lit(n + 1)), c) for n, c in enumerate(carried)],
    )


def _schema(fold: Fold) -> T.StructType:
    fields = [T.StructField(f"o{n}", f.dataType) for n, f in enumerate(T.StructType.fromDDL(fold.out).fields)]
    ends = T.StructType.fromDDL("k string, t long, tie string"), T.StructType.fromDDL("carried array<string>")
    return T.StructType([*ends[0].fields, *fields, *ends[1].fields])


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names).astype({f.name: object for f in schema.fields})


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    """``t, tie, fields..., carried`` of each row."""
    rest = [pdf[c].tolist() for c in pdf.columns if c not in ("k", "at", "carried")]
    return zip(*rest, [list(x) for x in pdf["carried"]], strict=True)


class OrderedFold(StatefulProcessor):
    """The folds of a bucket of keys. Rows wait in chunks in one of two lists until the watermark has passed them; when some are due, the others move to the other list.

    A chunk is a piece of an Arrow stream, and the states of a bucket's keys are one value, so that the messages
    to the state store do not grow with rows and keys. The times and fields of a bucket's due rows are sorted in
    memory, the carried columns are not held.
    """

    def __init__(self, fold: Fold, schema: T.StructType) -> None:
        self.fold, self.schema = fold, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = [(f"f{n}", pa.string() if kind == "string" else pa.int64()) for n, kind in enumerate(self.fold.fields.values())]
        self.own = ["k", "t", "tie", *(name for name, _ in kinds)]
        self.rows = pa.schema([("k", pa.string()), ("t", pa.int64()), ("tie", pa.string()), *kinds, ("carried", pa.list_(pa.string()))])
        self.handle = handle
        self.lists = [handle.getListState(f"chunks{n}", "low long, high long, rows binary") for n in range(2)]
        self.place = handle.getValueState("place", "now int, timer long")
        self.state = handle.getValueState("states", "held string")

    def _chunks(self, rows: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        """The least and the greatest time, and the rows, of pieces of ``rows``."""
        step = max(1, rows.num_rows * CHUNK_BYTES // max(rows.nbytes, 1))
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            times = pc.min_max(part.column("t"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(part)
            yield times["min"].as_py(), times["max"].as_py(), sink.getvalue().to_pybytes()

    @staticmethod
    def _unpacked(chunk: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(bytes(chunk)).read_next_batch()

    def _timer(self, now: int, old: int | None, at: int | None) -> None:
        """Wakes the bucket when the watermark is past ``at`` microseconds."""
        new = None if at is None else -(-at // 1000)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.place.update((now, new))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, timer = self.place.get() if self.place.exists() else (0, None)
        first = None
        for pdf in rows:
            chunks = list(self._chunks(pa.RecordBatch.from_pandas(pdf, schema=self.rows, preserve_index=False)))
            self.lists[now].appendList(chunks)
            first = min([low for low, _, _ in chunks] + ([] if first is None else [first]))
        if first is not None and (timer is None or -(-first // 1000) < timer):
            self._timer(now, timer, first)
        return iter(())

    def _judged(self, held: dict[str, list], due: list[tuple[tuple, int]], mark: int) -> tuple[dict[int, tuple], list[tuple]]:
        """Takes ``held``, the states by key, to ``mark``: the results of the due rows by their numbers, and those of wakes."""
        made: dict[int, tuple] = {}
        alone: list[tuple] = []

        def put(k: str, own: tuple | None, woken: list[tuple[int, tuple]]) -> None:
            alone.extend((k, t, None, *out, []) for t, out in woken)
            if own is None:
                held.pop(k, None)
            else:
                held[k] = own

        for (k, t, _, *row), n in due:
            own, woken = self.fold.until(held.get(k), t)
            own, out = self.fold.step(own, t, tuple(row))
            put(k, own, woken)
            if out is not None:
                made[n] = out
        for k in list(held):
            put(k, *self.fold.until(held[k], mark))
        return made, alone

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        now, timer = self.place.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        source, target = self.lists[now], self.lists[1 - now]
        due, waiting, n = [], [], 0
        for low, _, chunk in source.get() if source.exists() else ():
            if low > mark:
                waiting.append(low)
                continue
            rows = self._unpacked(chunk)
            due += [(r, n + i) for i, r in enumerate(zip(*(rows.column(c).to_pylist() for c in self.own), strict=True)) if r[1] <= mark]
            n += rows.num_rows
        due.sort()
        held = json.loads(self.state.get()[0]) if self.state.exists() else {}
        made, alone = self._judged(held, due, mark)
        if held:
            self.state.update((json.dumps(held),))
        else:
            self.state.clear()
        for at in range(0, len(alone), MOVED_ROWS):
            yield _frame(alone[at : at + MOVED_ROWS], self.schema)
        if due:
            told, left, n = [], [], 0
            for low, high, chunk in source.get():
                if low > mark:
                    left.append((low, high, bytes(chunk)))
                else:
                    rows = self._unpacked(chunk)
                    wanted = [i for i in range(rows.num_rows) if n + i in made]
                    if wanted:
                        part = rows.take(pa.array(wanted, pa.int64())).to_pydict()
                        told += [(k, t, tie, *made[n + i], more) for i, k, t, tie, more in zip(wanted, part["k"], part["t"], part["tie"], part["carried"], strict=True)]
                    if high > mark:
                        left += (rest := list(self._chunks(rows.filter(pc.greater(rows.column("t"), mark)))))
                        waiting += [r[0] for r in rest]
                    n += rows.num_rows
                if len(left) >= MOVED_CHUNKS:
                    target.appendList(left)
                    left = []
                if len(told) >= MOVED_ROWS:
                    yield _frame(told, self.schema)
                    told = []
            if left:
                target.appendList(left)
            if told:
                yield _frame(told, self.schema)
            source.clear()
            now = 1 - now
        first = min(waiting + [at for own in held.values() if (at := self.fold.due(own)) is not None], default=None)
        if first is None:
            self.place.clear()
        else:
            self._timer(now, None, first)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, fold: Fold, key: str, ts: str = "ts", tie: str = "id", carried: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``key, ts, tie``, the fold's results and the carried columns, of the events that have a result and of the wakes.

    ``df`` streams and has a watermark on ``ts``, a timestamp. Events of a key come in order of time, then of the
    tie as a string; one behind the watermark is dropped, as is one without a time. A null key is a key.
    Carried columns are of plain types; they and the tie are null for a wake. Appends, with state in RocksDB.
    Keys lie in ``buckets`` by a hash, whose number must stay as it is while a stream is started again from its checkpoint; more keys ask for more.
    """
    carried = carried or []
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = _schema(fold)
    rows = _inner(df, key, ts, tie, fold, carried).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    out = rows.groupBy("bucket").transformWithStateInPandas(OrderedFold(fold, schema), schema, "append", "eventTime")
    return _outer(out, df, key, ts, tie, fold, carried)


def fold_table(df: DataFrame, fold: Fold, key: str, ts: str = "ts", tie: str = "id", carried: list[str] | None = None, until: int | None = None) -> DataFrame:
    """The same of a table, key by key in sorted Arrow batches; ``until`` (microseconds) is when the last wakes are looked for.

    No group is gathered: a key with very many rows needs no more memory than another.
    """
    carried = carried or []
    schema = _schema(fold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, held, told = None, None, []

        def ends() -> None:
            if who is not None and until is not None:
                told.extend((who, t, None, *out, []) for t, out in fold.until(held, until)[1])

        for pdf in batches:
            for k, (t, tie_of, *row, more) in zip(pdf["k"], _rows(pdf), strict=True):
                if k != who:
                    ends()
                    who, held = k, None
                held, woken = fold.until(held, t)
                told += [(k, at, None, *out, []) for at, out in woken]
                held, out = fold.step(held, t, tuple(row))
                if out is not None:
                    told.append((k, t, tie_of, *out, more))
            if told:
                yield _frame(told, schema)
                told = []
        ends()
        if told:
            yield _frame(told, schema)

    out = _inner(df, key, ts, tie, fold, carried).repartition("k").sortWithinPartitions("k", "t", "tie", *[f"f{n}" for n in range(len(fold.fields))]).mapInPandas(run, schema)
    return _outer(out, df, key, ts, tie, fold, carried)
