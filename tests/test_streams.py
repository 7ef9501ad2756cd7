from datetime import datetime, timedelta

from corpusloom.streaming import guards

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def collected(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        query.stop()


def test_replayed_nonces(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(seconds=5)), ("b", START)]
    out = collected(spark, guards.first_use(stream(spark, tmp_path, rows, "nonce string, ts timestamp")), "nonces")
    assert sorted(r.nonce for r in out) == ["a", "b"]
    batch = spark.createDataFrame(rows, "nonce string, ts timestamp")
    assert sorted((r.nonce, r.ts) for r in guards.first_use(batch).collect()) == [("a", START), ("b", START)]


def test_rate_limit_on_a_stream(spark, tmp_path):
    rows = [(1, START + timedelta(seconds=i), i) for i in range(12)] + [(2, START, 99)]
    out = collected(spark, guards.rate_limited_stream(stream(spark, tmp_path, rows, "client long, ts timestamp, id long")), "limited")
    got = {r.id: r.accepted for r in out}
    assert got == {i: i < 10 for i in range(12)} | {99: True}


def test_gates(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    sig = hmac.new(b"k", b"1\nn", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("1", "n", sig), ("1", "m", sig)], "v string, nonce string, sig string")
    assert [r.nonce for r in guards.signed(df, b"k", ["v", "nonce"]).collect()] == ["n"]
    times = spark.createDataFrame([(START,), (START + timedelta(minutes=16),), (START - timedelta(minutes=16),)], "ts timestamp")
    assert [r[0] for r in times.select(guards.fresh(F.col("ts"), F.lit(START))).collect()] == [True, False, False]
    spaced = spark.createDataFrame([(1, START + timedelta(seconds=s), s) for s in (0, 3, 5, 9, 10)], "client long, ts timestamp, id long")
    assert sorted(r.id for r in guards.spaced(spaced, "client").collect()) == [0, 5, 10]


def test_clients_of_any_type(spark, tmp_path):
    rows = [("c", START + timedelta(seconds=i), f"id{i:02d}") for i in range(12)]
    schema = "client string, ts timestamp, id string"
    want = {f"id{i:02d}": i < 10 for i in range(12)}
    assert {r.id: r.accepted for r in guards.rate_limited(spark.createDataFrame(rows, schema)).collect()} == want
    out = collected(spark, guards.rate_limited_stream(stream(spark, tmp_path, rows, schema)), "any_type")
    assert {r.id: r.accepted for r in out} == want


def test_events_pass_all_gates_as_a_stream(spark, tmp_path):
    import json

    from corpusloom.sources import events
    from pyspark.sql import functions as F

    base = {"client": "c", "ts": "2024-01-01T00:00:00Z", "version": "1", "url": "https://x.org", "content": "text"}
    posted = [base | {"nonce": "a"}, base | {"nonce": "a"}, base | {"nonce": "b", "version": "2"}, base | {"nonce": "c", "url": "https://paypal.com"}, base | {"nonce": "d", "ts": "2024-01-01T01:00:00Z"}, base | {"nonce": "e"}]
    posted += [base | {"nonce": f"f{n:02d}", "client": "busy", "ts": f"2024-01-01T00:00:{n:02d}Z"} for n in range(30)]
    posted += [base | {"nonce": "last", "client": "none", "ts": "2024-01-01T02:00:00Z"}]  # moves the watermark past the others
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join(map(json.dumps, posted)) + "\nno event\n")
    now = F.when(F.col("nonce") == "last", F.col("ts")).otherwise(F.lit(START))
    want = ["a", "e", *[f"f{n:02d}" for n in range(10)]]
    assert sorted(r.nonce for r in collected(spark, guards.accepted_events(events.event_stream(spark, str(tmp_path / "in")), now), "gates")) == want
    assert sorted(r.nonce for r in guards.accepted_events(events.events(spark, str(tmp_path / "in")), now).collect() if r.nonce != "last") == want
    one = [r.nonce for r in guards.accepted_events(events.events(spark, str(tmp_path / "in")), now, calls=1).collect()]
    assert sorted(one) == ["a", "f00", "last"]


def test_late_and_replayed_events_over_restarts(spark):
    """What a stream accepts, slice by slice with restarts, is what a table of the same events gives; one client has no name."""
    import random

    from corpusloom.streaming.replay import replay
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for n in range(400):
        ts = START + timedelta(seconds=rng.randrange(7200), microseconds=rng.randrange(10**6))
        arrived = ts + timedelta(minutes=rng.choice([-14, -5, 0, 0, 0, 3, 14, 16]))
        who = rng.choice(["a", "b", None])  # a replay repeats the signed fields
        rows += [(f"n{n}", who, ts, arrived + timedelta(seconds=9 * k), "1", "https://x.org", f"content {n}") for k in range(rng.choice([1, 1, 2]))]
    schema = "nonce string, client string, ts timestamp, arrived timestamp, version string, url string, content string"
    table = spark.createDataFrame(rows, schema)
    end = START + timedelta(hours=9)
    closing = spark.createDataFrame([("last", "c", end, end, "1", "https://x.org", "")], schema)
    got = replay(table, lambda s: guards.accepted_events(s, F.col("arrived"), calls=2, seconds=300), closing, by="arrived", slices=2)
    want = guards.accepted_events(table, F.col("arrived"), calls=2, seconds=300)
    assert 20 < want.count() < 200 and sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_session_life(spark):
    """Opened, read, closed and expired, on a stream, on a table and by hand."""
    from corpusloom.streaming import ordered
    from corpusloom.streaming.replay import replay

    at = lambda s: START + timedelta(seconds=s)
    rows = [
        ("s", at(0.5), "1", "open"), ("s", at(9.9), "2", "read"), ("s", at(10), "3", "open"), ("s", at(11.0), "4", "read"), ("s", at(30), "5", "close"), ("s", at(40), "6", "open"),
        ("s", at(41), "7", "close"), ("s", at(42), "8", "read"), ("t", at(5), "9", "read"), ("t", at(6), "a", "open"), (None, at(1), "b", "open"), ("t", None, "c", "open"),
    ]
    schema = "session string, ts timestamp, event string, action string"
    table = spark.createDataFrame(rows, schema)
    until = 1704067200_000_000 + 100_000_000
    want = [
        ("s", at(0.5), "1", "opened"), ("s", at(9.9), "2", "found"), ("s", at(10), "3", "exists"), ("s", at(11), None, "expired"), ("s", at(11), "4", "missing"), ("s", at(30), "5", "missing"),
        ("s", at(40), "6", "opened"), ("s", at(41), "7", "closed"), ("s", at(42), "8", "missing"), ("t", at(5), "9", "missing"), ("t", at(6), "a", "opened"), ("t", at(17), None, "expired"),
        (None, at(1), "b", "opened"), (None, at(12), None, "expired"),
    ]
    life = ordered.SessionLife(10)
    assert sorted(map(repr, map(tuple, ordered.fold_table(table, life, "session", "ts", "event", until=until).collect()))) == sorted(map(repr, want))
    closing = spark.createDataFrame([("end", at(160), "z", "read")], schema)
    got = replay(table.where("ts IS NOT NULL"), lambda s: ordered.fold_stream(s.withWatermark("ts", "1 minute"), life, "session", "ts", "event"), closing, slices=1)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_page_gates(spark):
    from corpusloom.streaming import ordered

    at = lambda s: START + timedelta(seconds=s)
    looks = [(1, at(s), f"{s:02d}", size) for s, size in ((0, 100), (1, 250), (2, 300), (3, 390), (4, 395), (90, 390), (91, 380), (92, 370))]
    table = spark.createDataFrame(looks, "page long, ts timestamp, event string, size long")
    settled = ordered.fold_table(table, ordered.Stability(100, 2, 60), "page", "ts", "event").collect()
    assert [(r.event, r.size) for r in sorted(settled)] == [("03", 390), ("92", 370)]
    moves = [(1, at(0), "a", "navigation", 400), (1, at(1), "b", "navigation", 500), (1, at(5.9), "c", "navigation", 900), (1, at(6), "d", "focus", 900), (1, at(6.5), "e", "navigation", 501), (2, at(0), "f", None, None)]
    table = spark.createDataFrame(moves, "page long, ts timestamp, event string, kind string, length long")
    assert sorted(r.event for r in ordered.fold_table(table, ordered.Extraction(5, 500), "page", "ts", "event").collect()) == ["b", "e"]


def test_first_use_of_equal_times(spark):
    rows = [("a", START, 3), ("a", START, 1), ("a", START, 2)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "nonce string, ts timestamp, id int").repartition(n)
        assert [r.id for r in guards.first_use(df, tie="id").collect()] == [1]
        assert len({r.id for r in guards.first_use(df).collect()}) == 1


def test_state_of_a_stream_is_that_of_buckets(spark, tmp_path):
    """Many keys share a bucket: results, with carried texts and late rows, are those of the table, and the rows of the state do not grow with the keys."""
    import random

    from corpusloom.streaming import ordered

    rng = random.Random(5)
    rows = [(rng.choice([None, *map(str, range(300))]), START + timedelta(seconds=rng.randrange(7200)), f"e{n:04d}", f"{n}" * rng.randrange(1000)) for n in range(2000)]
    schema = "page string, ts timestamp, event string, text string"
    fold = ordered.RateLimit(2, 900, rejects=False)
    late = [r for r in rows[1500:] if r[1] > START + timedelta(minutes=91)]
    end = [("end", START + timedelta(hours=9), "z", "")]
    (tmp_path / "in").mkdir()
    stream = ordered.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "30 minutes"), fold, "page", "ts", "event", ["text"], buckets=3)
    held = []
    for part in (rows[:1500], late, end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = ordered.fold_table(spark.createDataFrame(rows[:1500] + late, schema), fold, "page", "ts", "event", ["text"]).collect()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("page IS NULL OR page <> 'end'").collect()
    assert 500 < len(want) < 1950 and sorted(map(repr, got)) == sorted(map(repr, want))
    assert 0 < held[0] < 100


def test_pages_of_one_bucket_are_extracted_apart(spark):
    """Pages that share a bucket, one of them without a name, keep their own gaps over slices, on a stream as on a table."""
    from corpusloom.streaming import ordered
    from corpusloom.streaming.replay import replay

    kinds = ("navigation", "focus", "navigation", None)
    rows = [(None if n % 7 == 0 else n % 7, START + timedelta(seconds=17 * n % 3600), f"{n:03d}", kinds[n % 4], 90 + n % 30) for n in range(210)]
    schema = "page long, ts timestamp, event string, kind string, length long"
    table, fold = spark.createDataFrame(rows, schema), ordered.Extraction(300, 100)
    closing = spark.createDataFrame([(-1, START + timedelta(hours=9), "z", "navigation", 100)], schema)
    got = replay(table, lambda s: ordered.fold_stream(s.withWatermark("ts", "5 minutes"), fold, "page", "ts", "event", buckets=1), closing, slices=2)
    want = ordered.fold_table(table, fold, "page", "ts", "event").collect()
    assert len(want) > 20 and sorted(map(repr, got.collect())) == sorted(map(repr, want))
