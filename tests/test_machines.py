"""Job lanes, the answer cache and late results: streams against batch, both against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.streaming import machines as M

START = 1_700_000_000_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def drain(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


def files(spark, rows, schema, folder, parts):
    """The rows in several files, in their order of arrival; a stream reads a file a time."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/{i:03}")
    schema = spark.createDataFrame([], schema).schema
    return spark.read.schema(schema).parquet(f"{folder}/*"), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def lanes_by_loop(rows, caps):
    """Every request with its times, simulated second by second over sorted events."""
    out = []
    for key in {r[0] for r in rows}:
        active = pending = None

        def expire(now):
            nonlocal active, pending
            while active and active[2] <= now:
                out.append((key, active[0], "timeout", active[2]))
                end = active[2]
                active, pending = (pending[0], pending[1], end + caps[pending[1]]) if pending else None, None

        for _, at, _, kind, action, job in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            expire(at)
            if action == "result":
                if active and active[0] == job:
                    out.append((key, job, "done", at))
                    active, pending = (pending[0], pending[1], at + caps[pending[1]]) if pending else None, None
                else:
                    out.append((key, job, "late", at))
            elif action == "cancel":
                out.extend((key, x[0], "cancelled", at) for x in (pending, active) if x)
                active = pending = None
            elif active is None:
                active = (job, kind, at + caps[kind])
            else:
                if pending:
                    out.append((key, pending[0], "stale", at))
                    pending = None
                if action == "supersede":
                    out.append((key, active[0], "superseded", at))
                    active = (job, kind, at + caps[kind])
                else:
                    pending = (job, kind)
        expire(M.FOREVER)
    return sorted(out)


def lane_rows(seed, n=250):
    rng = random.Random(seed)
    rows, jobs, clock = [], {}, START
    for i in range(n):
        clock += rng.choice([500, 500, 1500, 9000])
        key, at = rng.choice(["a", "b", "b", "b"]), clock + rng.randint(0, 4000)
        action = rng.choice(["request"] * 4 + ["supersede", "result", "result", "result", "cancel"])
        job = rng.choice(jobs.get(key, [0])[-3:]) if action == "result" else i
        if action in ("request", "supersede"):
            jobs.setdefault(key, []).append(i)
        rows.append((key, at, i, rng.choice(list(M.CAPS)), action, job))
    return rows


SCHEMA = "key string, at long, id long, kind string, action string, job long"


def lane_events(df):
    return M.events_for(M.Lane, df, F.col("key"), F.timestamp_millis("at"), F.col("id"), F.col("kind"), F.col("action"), F.col("job"))


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_in_batch_equal_the_loop(spark, seed):
    rows = lane_rows(seed)
    got = sorted(map(tuple, M.replayed(lane_events(spark.createDataFrame(rows, SCHEMA)), M.Lane).collect()))
    assert got == lanes_by_loop(rows, M.CAPS)
    assert {o for _, _, o, _ in got} == {"done", "late", "stale", "superseded", "timeout", "cancelled"}
    odd = spark.createDataFrame([(None, START, 1, "scan", "request", 1), ("a", None, 2, "scan", "request", 2), ("a", START, 3, None, "request", 3)], SCHEMA)
    assert [tuple(r) for r in M.replayed(lane_events(odd), M.Lane).collect()] == [("a", 3, "timeout", START + M.OTHER_CAP)]
    assert M.replayed(lane_events(odd.limit(0)), M.Lane).collect() == []


def test_lanes_on_a_stream_equal_the_loop(rocks, tmp_path):
    rows = lane_rows(3, 160)
    end = ("end", START + 10_000_000, 9999, "scan", "request", 9999)
    _, stream = files(rocks, [*rows, end, ("end", START + 10_000_001, 10000, "scan", "cancel", 0)], SCHEMA, tmp_path / "in", 6)
    got = drain(M.streamed(lane_events(stream), M.Lane, "20 seconds"), "lanes_s", tmp_path / "c")
    assert [r for r in got if r[0] != "end"] == lanes_by_loop(rows, M.CAPS)


def cache_by_loop(rows, ttl):
    out, held = [], {}
    for key, at, _, item, action, answer in sorted(rows, key=lambda r: (r[1], r[2])):
        if action == "purge":
            held = {k: v for k, v in held.items() if k[0] != key}
        elif (key, item) in held and at - held[key, item][1] < ttl:
            out.append((key, item, True, held[key, item][0], at))
        else:
            held[key, item] = answer, at
            out.append((key, item, False, answer, at))
    return sorted(out)


CACHE = "key string, at long, id long, item string, action string, answer string"


def cache_rows(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["pc", "cs"]), START + i * 1000 + rng.randint(0, 5000), i, rng.choice("xyz"), "purge" if rng.random() < 0.05 else "lookup", f"v{i}") for i in range(n)]


def cache_events(df):
    return M.events_for(M.Cache, df, F.col("key"), F.timestamp_millis("at"), F.col("id"), F.col("item"), F.col("action"), F.col("answer"))


def test_cache_in_batch_equals_the_loop(spark):
    rows = cache_rows(1)
    got = sorted(map(tuple, M.replayed(cache_events(spark.createDataFrame(rows, CACHE)), lambda: M.Cache(20_000)).collect()))
    assert got == cache_by_loop(rows, 20_000)
    assert {h for _, _, h, _, _ in got} == {True, False}


def test_cache_on_a_stream_is_restarted_from_its_checkpoint(rocks, tmp_path):
    rows = cache_rows(2, 200)
    folder = tmp_path / "in"
    end = [("end", START + 10_000_000 + i, 9999 + i, "x", "lookup", "e") for i in range(2)]
    half = len(rows) // 2
    _, stream = files(rocks, rows[:half], CACHE, folder / "a", 3)
    all_of = rocks.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*/*")

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{epoch:05}")

    def go():
        q = M.streamed(cache_events(all_of), lambda: M.Cache(20_000), "10 seconds").writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    go()
    files(rocks, rows[half:] + end, CACHE, folder / "b", 3)
    go()
    got = sorted(map(tuple, rocks.read.parquet(f"{tmp_path}/out/*").collect()))
    assert [r for r in got if r[0] != "end"] == cache_by_loop(rows, 20_000)


def test_late_results_on_streams_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    asks = [(rng.choice("ab"), i, START + i * 20_000 + rng.randint(0, 5000)) for i in range(60)]
    came = [(k, r, at + rng.randint(1000, 90_000)) for k, r, at in asks] + [("a", 777, START + 5000), ("b", 0, START + 900_000)]
    end = START + 50_000_000
    schema = "key string, revision long, at long"
    a_batch, a_stream = files(spark, [*asks, ("end", 1, end), ("end", 2, end + 1)], schema, tmp_path / "a", 4)
    c_batch, c_stream = files(spark, [*came, ("end", 9, end), ("end", 9, end + 1)], schema, tmp_path / "c", 4)
    q = lambda d: d.select("key", "revision", F.timestamp_millis("at").alias("asked"))
    r = lambda d: d.select("key", "revision", F.timestamp_millis("at").alias("came"), "at")
    want = set()
    for k, rev, at in came:
        own = [t for k2, r2, t in asks if (k2, r2) == (k, rev) and at - 3_600_000 <= t <= at]
        if own and not any(k2 == k and r2 > rev and at - 3_600_000 <= t <= at for k2, r2, t in asks):
            want.add((k, rev, at))
    got = {(x.key, x.revision, x["at"]) for x in M.current_results(q(a_batch), r(c_batch)).collect()}
    assert got == want and len(want) < len(came)
    out = M.current_results(q(a_stream).withWatermark("asked", "2 minutes"), r(c_stream).withWatermark("came", "2 minutes")).select("key", "revision", "at")
    query = out.writeStream.format("memory").queryName("late_s").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).start()
    try:
        query.processAllAvailable()
        held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    finally:
        query.stop()
    assert {tuple(x) for x in spark.table("late_s").collect() if x.key != "end"} == want
    assert held[-1] < max(held)
