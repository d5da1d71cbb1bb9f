import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.plans import landing
from assayer.sources import files, sinks
from assayer.streaming import latest as S


def test_lists_logs_and_folders(spark, tmp_path):
    (tmp_path / "test_a_certs.txt").write_text("AAAAAA1 BBBBBB2\n\nCCCCCC3\n")
    (tmp_path / "excluded.txt").write_text("# note\nBBBBBB2 broken scan # why\n")
    (tmp_path / "log").write_text("2026-01-01T13:00:00\tx\tu1\nbad\tx\tu\n")
    (tmp_path / "d" / "DDDDDD4").mkdir(parents=True)
    (tmp_path / "d" / "DDDDDD4" / "f").write_text("1")
    (tmp_path / "d" / "short").mkdir()
    (tmp_path / "d" / "short" / "f").write_text("1")
    keys = files.token_list(spark, str(tmp_path / "test_*certs.txt"))
    out = files.exclusions(spark, str(tmp_path / "excluded.txt"))
    found = files.folders(spark, str(tmp_path / "d"))
    assert out.first() == ("BBBBBB2", "broken scan")
    assert sorted(r.key for r in files.pools([keys], found, out).collect()) == ["AAAAAA1", "CCCCCC3", "DDDDDD4"]
    assert files.in_two_pools(keys, found).count() == 0
    assert files.event_log(spark, str(tmp_path / "log")).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","defects":[{"side":"front","confirmed":false}]}\n\nbroken\n')
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), files.ASSESSMENT).collect()
    assert [r.id for r in rows if r.id] == ["x"] and sum(r._corrupt_record is not None for r in rows) == 1
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": "1"}, {"id": "2"}], "total": 2, "page": 1, "size": 2, "pages": 1}))
    assert files.pages(spark, str(tmp_path / "p.json"), "id: string").count() == 2
    (tmp_path / "b1.json").write_text('[{"id":"1"}]')
    (tmp_path / "b2.json").write_text('{"app":"a","cards":[{"id":"2"},{"id":"3"}]}')
    got = files.backup(spark, str(tmp_path / "b*.json"), "id: string")
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3"]


def test_overlay(spark):
    base = spark.createDataFrame([("1", "scan", "pass"), ("1", "identify", "warn"), ("1", "other", "warn")], "id string, step string, status string")
    again = spark.createDataFrame([("1", "scan", "skipped"), ("1", "identify", "fail"), ("1", "other", "pass")], "id string, step string, status string")
    got = files.overlay(base, again, ["id", "step"], ["scan"], "step", "status", {"fail": 3, "warn": 2, "pass": 1, "skipped": 0})
    assert {r.step: r.status for r in got.collect()} == {"scan": "skipped", "identify": "fail", "other": "warn"}


def test_canonical_lines_are_stable(spark, tmp_path):
    df = spark.createDataFrame([("b", None, (2, "é")), ("a", 1, (1, None))], "cert string, z int, n struct<y:int,x:string>")
    sinks.write_canonical(df.repartition(3), "cert", str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).orderBy("value").collect()]
    assert lines == ['{"cert":"a","n":{"x":null,"y":1},"z":1}', '{"cert":"b","n":{"x":"é","y":2},"z":null}']


def test_guards(spark, tmp_path):
    assert not sinks.write_unless_empty(spark.range(0), str(tmp_path / "p"))
    assert sinks.write_unless_empty(spark.range(3), str(tmp_path / "p")) and spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.write_csv(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "c"), ["k", "v"])
    assert sinks.without_key(spark.range(3), "id", 1).count() == 2
    members = spark.createDataFrame([("a", "test"), ("b", "dev")], "cert string, split string")
    with pytest.raises(PermissionError):
        sinks.eval_config(members, {}, {}, "test")
    assert json.loads(sinks.eval_config(members, {"x": "1"}, {}, "dev"))["certs"] == 1


@pytest.fixture
def events(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + ((F.col("id") * 37) % 60) * 3_600_000_000).alias("ts"), F.lit(1.0).alias("value"), (F.col("id") % 3).cast("string").alias("event_type"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    return spark.read.parquet(str(tmp_path / "e")), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))


def run(stream, name, mode, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_latest_by_aggregate_equals_batch(events, tmp_path):
    batch, stream = events
    got = run(S.latest_by_aggregate(stream, "user_id", "ts", "event_id"), "latest_a", "complete", tmp_path / "c")
    want = S.latest(batch, "user_id", "ts", "event_id")
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == sorted((r.user_id, r.event_id) for r in want.collect())


def test_windows_and_sessions_on_streams(events, tmp_path):
    batch, stream = events
    got = run(S.hourly(stream, "ts", "event_type", "6 hours", "400 hours"), "hourly_a", "append", tmp_path / "h")
    assert got.count() <= S.hourly(batch, "ts", "event_type", "6 hours").count()
    run(S.bursts(stream, "user_id", "ts", "2 hours"), "bursts_a", "append", tmp_path / "b")
    assert S.bursts(batch, "user_id", "ts", "2 hours").agg(F.sum("n")).first()[0] == 60
    seen = run(S.ttl_dedup_stream(stream, ["user_id"]), "ttl_a", "append", tmp_path / "t")
    assert 7 <= seen.count() <= 60


def test_micro_batch_merge_is_idempotent(events, tmp_path):
    batch, _ = events
    for _ in range(2):
        S.merged(batch, 0, str(tmp_path / "m"), "user_id", "ts")
    assert batch.sparkSession.read.parquet(str(tmp_path / "m")).count() == 7


def test_paced_slots_equal_the_recurrence(spark):
    rows = [("a", 0), ("a", 1), ("a", 2), ("a", 10), ("b", 5)]
    df = spark.createDataFrame(rows, "lane string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sorted((r.lane, r.start_us) for r in S.paced_slots(df, "lane", "ts", 2000).collect())
    assert got == [("a", 0), ("a", 2_000_000), ("a", 4_000_000), ("a", 10_000_000), ("b", 5_000_000)]


def test_paced_slots_of_a_hot_lane_and_of_none(spark):
    rng = random.Random(5)
    rows = [(lane, rng.randint(0, 900)) for lane in ["hot"] * 400 + ["b", None, None, None]]
    df = spark.createDataFrame(rows, "lane string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("s", F.monotonically_increasing_id())
    got = sorted((r.lane or "", r.start_us) for r in S.paced_slots(df, "lane", "ts", 2000).collect())
    want = []
    for lane in ("hot", "b", None):
        last = None
        for s in sorted(s for x, s in rows if x == lane):
            last = s if last is None else max(s, last + 2)
            want.append((lane or "", last * 1_000_000))
    assert got == sorted(want)
    assert S.paced_slots(df.limit(0), "lane", "ts", 2000).collect() == []


def test_rate_slots_of_equal_times_go_by_event_and_those_without_a_time_last(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["click", "view"]), rng.choice([None, *range(1000, 4000, 400)])) for i in rng.sample(range(9000), 300)]
    spark.createDataFrame(rows, "event_id long, event_type string, s long").select("event_id", "event_type", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for kind in ("click", "view"):
        last = None
        for s, i in sorted((float("inf") if s is None else s, i) for i, x, s in rows if x == kind):
            last = s if last is None else last + 1100 if s == float("inf") else max(s, last + 1100)
            want[i] = last * 1_000_000
    assert {r.event_id: r.start_us for r in landing.rate_slots(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_ttl_dedup_equals_the_recurrence(spark, batch):
    rng = random.Random(batch)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([rng.randint(0, 5000), rng.randint(0, 5000), None])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in ("hot", "b", None):
        last = None
        for s in sorted(s for _, k, s in rows if k == key and s is not None):
            if last is None or s - last >= 60:
                want.append((key or "", s))
                last = s
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.k or "", r.s) for r in S.ttl_dedup(df, ["k"], "ts", 60).collect())
        assert got == sorted(want)
        assert S.ttl_dedup(df.limit(0), ["k"], "ts", 60).collect() == []
        assert S.ttl_dedup(df.where("s is not null"), ["k"], "ts", 0).count() == sum(s is not None for *_, s in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_latest_with_state_equals_batch(events, tmp_path):
    batch, stream = events
    spark = batch.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = run(S.latest_stream(stream, "user_id", "ts", "event_id"), "latest_s", "update", tmp_path / "s")
        got = {k: max((r.micros, r.id) for r in rows)[1] for k, rows in _by_key(seen.collect()).items()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {r.user_id: r.event_id for r in S.latest(batch, "user_id", "ts", "event_id").collect()}


def _by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r.key, []).append(r)
    return out
