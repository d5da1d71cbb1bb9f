"""The smaller operators against literal expectations and plain versions."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer.operators import details as D
from assayer.operators import records as R
from assayer.sources import sinks

GOOD = {"blur": 1.0, "px_per_mm": 11.9, "glare": 0.0, "glare_zones": [0.0] * 8, "card_px": 800.0, "inset": [50.0] * 4, "photo_px": 1000.0, "full_frame": False, "cropped": False, "rounded": [1.0] * 4, "keystone": 0.0, "aspect_error": 0.0, "angle_error": 0.0, "detection": 0.9, "sleeve": False}
SCHEMA = "blur double, px_per_mm double, glare double, glare_zones array<double>, card_px double, inset array<double>, photo_px double, full_frame boolean, cropped boolean, rounded array<double>, keystone double, aspect_error double, angle_error double, detection double, sleeve boolean"


def test_photo_gate(spark):
    zones = lambda i: [0.03 if j == i else 0.0 for j in range(8)]
    far = lambda i, v: [v if j == i else 50.0 for j in range(4)]
    cases = [
        ({}, "ok", {}),
        ({"blur": None}, "warn", {}),
        ({"blur": 1.5}, "warn", {}),
        ({"blur": 2.01}, "rescan", {i: ["sharpness"] for i in D.ITEMS if i != "centering"}),
        ({"glare_zones": zones(1), "glare": 0.2}, "rescan", {"centering": ["glare"], "surface": ["glare"], "edges:right": ["glare"]}),
        ({"glare_zones": zones(7)}, "warn", {"corners:bottom_left": ["glare"]}),
        ({"card_px": 599.4}, "warn", {i: ["resolution"] for i in D.ALL_EDGES + D.ALL_CORNERS}),
        ({"card_px": 300.0}, "rescan", {i: ["resolution"] for i in ["surface", *D.ALL_EDGES, *D.ALL_CORNERS]}),
        ({"inset": far(2, 1.0)}, "rescan", {"centering": ["boundary"], "edges:right": ["boundary"], "edges:bottom": ["boundary"], "corners:bottom_right": ["boundary"]}),
        ({"inset": far(0, 9.0)}, "warn", {"corners:top_left": ["boundary"]}),
        ({"rounded": [0.0, 0.0, 1.0, 1.0]}, "warn", {"corners:top_left": ["boundary"], "corners:top_right": ["boundary"]}),
        ({"rounded": [0.0, 0.0, 0.0, 1.0]}, "rescan", {i: ["boundary"] for i in ["centering", *D.ALL_EDGES, *D.ALL_CORNERS[:3]]}),
        ({"full_frame": True, "keystone": 1.0, "rounded": [0.0] * 4}, "rescan", {i: ["boundary"] for i in ["centering", *D.ALL_EDGES, *D.ALL_CORNERS]}),
        ({"full_frame": True, "cropped": True}, "warn", {}),
        ({"keystone": 0.2, "detection": 0.4, "sleeve": True}, "rescan", {"centering": ["detection"]} | {i: ["perspective", "detection"] for i in D.ALL_EDGES + D.ALL_CORNERS}),
        ({"angle_error": 9.0, "detection": None}, "rescan", {i: ["detection"] for i in ["centering", *D.ALL_EDGES, *D.ALL_CORNERS]}),
    ]
    rows = [tuple((GOOD | c[0]).values()) for c in cases]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, m struct<{', '.join(f.replace(' ', ':', 1) for f in SCHEMA.split(', '))}>")
    got = df.select("i", D.photo_gate(F.col("m")).alias("g")).orderBy("i").collect()
    for r, (_, verdict, why) in zip(got, cases, strict=True):
        assert r.g.verdict == verdict and dict(r.g.reasons) == why and list(r.g.blocked) == [i for i in D.ITEMS if i in why], (r, why)


def test_photo_gates_equal_the_expression_and_round_each_zone_once(spark):
    rng = random.Random(4)
    some = lambda *v: rng.choice([None, *v, *v, *v])
    row = lambda: (some(1.0, 1.5, 2.01), some(11.9), some(0.0, 0.2), some([some(0.0, 0.03) for _ in range(8)]), some(800.0, 400.0, 300.0), some([some(50.0, 9.0, 1.0) for _ in range(rng.choice((3, 4, 5)))]), some(1000.0), some(False, False, True), some(False, False, True), some([some(0.0, 1.0) for _ in range(4)]), some(0.0, 0.2), some(0.0), some(0.0, 9.0), some(0.9, 0.4), some(False, True))
    df = spark.createDataFrame([(i, row()) for i in range(300)], f"i int, m struct<{', '.join(f.replace(' ', ':', 1) for f in SCHEMA.split(', '))}>")
    gates = D.photo_gates(df, F.col("m"))
    assert gates.columns == ["i", "m", "gate"]
    got, want = gates.drop("m").orderBy("i").collect(), df.select("i", D.photo_gate(F.col("m")).alias("gate")).orderBy("i").collect()
    assert got == want and {r.gate.verdict for r in got} == {"rescan", "warn"} and any(r.gate.reasons for r in got)
    # all of the query's tests once each: 3 rounded values of sharpness, the width and the zones (thousands when each item tested them anew)
    plan = entry.queries()["q_photo_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FLOOR") < 20 and plan.count("map_filter") <= 2, (plan.count("FLOOR"), plan.count("map_filter"))


def test_cautions_subgrades_and_places(spark):
    m = lambda **x: F.create_map(*[F.lit(y) for p in x.items() for y in p]) if x else F.lit(None).cast("map<string,string>")
    got = spark.range(1).select(
        D.cautions("front", F.lit("rescan"), m(sleeve="s", glare="g"), m(edges="dark")), D.cautions("back", F.lit("ok"), m(), m()),
        D.shown_subgrades({"centering": F.lit(9.0), "corners": F.lit(8.0)}, {"corners": F.lit(None).cast("double")}), D.allowed_locations(F.array(F.lit("surface"), F.lit("corners"))),
        D.extended(F.array(F.struct(F.lit("Number").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("Number").alias("name"), F.lit("2").alias("value"))), "Number"), D.extended(F.lit(None).cast("array<struct<name:string,value:string>>"), "x"),
        D.membership(F.lit('{"membership":{"A":"dev"}}')), D.membership(F.lit("{")),
    ).first()
    assert list(got[0]) == ["front|retake||", "front|note|glare|g", "front|note|sleeve|s", "front|unjudged|edges|dark"] and list(got[1]) == []
    assert got[2] == {"centering": 9.0, "corners": None} and list(got[3]) == [*D.LOCATIONS["corners"], "surface"] and (got[4], got[5]) == ("1", "") and (got[6], got[7]) == ({"A": "dev"}, {})
    members = spark.createDataFrame([("A", "dev"), ("B", "test")], "cert string, split string")
    assert [r.cert for r in D.members_of(members, "dev").collect()] == ["A"]
    with pytest.raises(ValueError):
        D.members_of(members.limit(0), "dev")


def test_times(spark):
    texts = ["2026-01-02T03:04:05Z", "2026-01-02 03:04:05.5+01:00", "2026-01-02T03:04:05", "2026-01-02", "soon", None, "2026-13-02"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", F.unix_micros(D.iso_time(F.col("s"))).alias("t")).orderBy("i").collect()]
    at = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1e6)
    assert got == [at(2026, 1, 2, 3, 4, 5), at(2026, 1, 2, 2, 4, 5) + 500_000, at(2026, 1, 2, 3, 4, 5), at(2026, 1, 2), None, None, None]
    m = lambda a, b: D.minutes_between(F.timestamp_seconds(F.lit(a)), F.timestamp_seconds(F.lit(b)))
    assert list(spark.range(1).select(m(0, 90), m(0, 93), m(60, 0), D.minutes_between(F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(1)))).first()) == [1.5, 1.6, -1.0, None]


def test_found_prices(spark):
    listed = spark.createDataFrame([("1", "OGN", "001/298", "Jinx (Alt)"), ("2", "OGN", "1/298", "Jinx"), ("3", "SFD", "1/298", "Vi"), ("4", "OGN", "7/298", "Ekko (Foil)"), ("5", "OGN", "7/298", "Other")], "id string, set string, number string, name string")
    items = spark.createDataFrame([(1, "3", "", "", "Jinx"), (2, None, "ogn", "01/298", "jinx"), (3, "9", "", "1/298", "Vi"), (4, None, "OGN", "7/298", "Ekko"), (5, None, "", "", "x"), (6, "", "OGN", "9/298", ""), (7, None, None, "1/298", "")], "item int, id string, set string, number string, name string")
    got = {r.item: (r.id, r.how, r.name_matches, r.others) for r in D.found_prices(items, listed).collect()}
    assert got == {1: ("3", "id", False, 0), 2: ("2", "number", True, 1), 3: ("3", "number", True, 2), 4: ("4", "number", True, 1), 7: ("2", "number", True, 2)}


def test_found_prices_compares_names_not_copies(spark):
    """1,200 copies of two cards and as many items: rows between the joins stay below the 1,440,000 pairs."""
    listed = spark.range(1200).select(F.col("id").cast("string").alias("id"), F.lit("OGN").alias("set"), F.lit("1/298").alias("number"), F.when(F.col("id") % 2 == 0, "Jinx (Alt)").otherwise("Vi").alias("name"))
    items = spark.range(1200).select((F.col("id") + 5000).alias("item"), F.lit(None).cast("string").alias("id"), F.when(F.col("id") % 3 != 0, "ogn").alias("set"), F.lit("1/298").alias("number"), F.when(F.col("id") % 2 == 0, "Jinx").otherwise("Vi").alias("name"))
    found = D.found_prices(items, listed)
    got = {(r.item % 2, r.id, r.how, r.name_matches, r.others) for r in found.collect()}
    assert got == {(0, "0", "number", True, 1199), (1, "1", "number", True, 1199)} and found.count() == 1200
    # what the joins and the steps between them made, by the executed plan's own counters
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    found._jdf.queryExecution().executedPlan().executeCollect()
    while todo:
        plan = todo.pop()
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            plan = plan.plan()
        rows = plan.metrics().get("numOutputRows")
        made += [rows.get().value()] if rows.isDefined() else []
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    assert 1200 <= max(made) <= 5000


def test_hashes_of_near_copies_are_near(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 32, 32)).cumsum(1).cumsum(2)
    near = base * 1.01 + 3 + rng.normal(scale=1e-4, size=base.shape)
    rows = [(i, m.ravel().tolist()) for i, m in enumerate([*base, *near])] + [(200, None), (201, [1.0]), (202, [float("nan")] * 1024)]
    hashed = D.perceptual_hashes(spark.createDataFrame(rows, "k long, m array<double>"), "k", "m").withColumnRenamed("phash", "v")
    got = {r.k: r.v for r in hashed.collect()}
    d = D.cosines()
    assert np.allclose(d @ d.T, np.eye(8)) and got[200] is None and got[201] is None and got[202] is None
    for i, m in enumerate(base):
        low = (d @ m @ d.T).ravel()
        bits = "".join("1" if x > np.median(low) else "0" for x in low)
        assert got[i] % 2**64 == int(bits, 2)
    pairs = {(r.a, r.b) for r in R.near_pairs(hashed.where("v is not null"), "k", "v", 4).collect()}
    assert all((i, i + 40) in pairs for i in range(40))


def test_jobs_records_and_trackers(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "up", "a"), (2, "count", "abc"), (3, "none", "x"), (4, None, "y")], "job int, kind string, payload string")
    got = D.handled(jobs, {"up": lambda d: d.withColumn("result", F.upper("payload")), "count": lambda d: d.withColumn("result", F.length("payload"))})
    assert sorted(map(tuple, got.collect())) == [(1, "A", None), (2, "3", None), (3, None, "unknown kind: none"), (4, None, "unknown kind: ")]
    assert D.handled(jobs, {}).where("error is null").count() == 0 and D.record_of(jobs, "job", 2).first().payload == "abc" and D.record_of(jobs, "job", 9).count() == 0
    steps = spark.createDataFrame([("b", "x", 1, None), ("a", "y", 2, "s"), ("a", "y", 1, "t")], "agent string, id string, step_order int, detail string")
    sinks.write_trackers({"agent_steps": steps, "tag_reports": spark.createDataFrame([], "tag_grade double")}, str(tmp_path))
    rows = [r.value for r in spark.read.text(f"{tmp_path}/agent_steps").collect()]
    assert [r for r in rows if not r.startswith("agent,")] == ["a,y,1,t", "a,y,2,s", "b,x,1,"] and not (tmp_path / "tag_reports").exists()


def test_blind_test_and_histogram(spark):
    rng = random.Random(1)
    key = [(r, f"c{i}", "s" if i < 12 else "t", rng.choice(["TAG", "PSA"]) if i < 12 else "PSA", rng.randint(2, 20) / 2) for r in ("A", "B") for i in range(14)]
    results = [(r, c, co, rng.choice([10.5, 9.0, 8.5, 5.0]), True) for r, c, *_ in key if c != "c3" for co in ("TAG", "PSA")]
    answers = D.blind_answers(spark.createDataFrame(key, "round string, card string, set string, company string, grade double"), spark.createDataFrame(results, "round string, card string, company string, grade double, complete boolean"))
    own = {(r.round, r.card): r.pred for r in answers.collect()}
    listing = [(r.set, r.true, r.card, r.round) for r in D.blind_listing(answers).collect()]
    assert listing == sorted(listing)
    want = {(r, c): min(10.0, p) if co == "TAG" else p for r, c, _, co, _ in key for r2, c2, co2, p, _ in results if (r, c, co) == (r2, c2, co2)}
    assert own == want and len(own) == 26
    got = {r.set: r for r in D.blind_summary(answers, ["set"]).collect()}
    assert got["s"].n == 22 and got["t"].n == 4 and got["t"].spearman is not None and abs(got["s"].spearman) <= 1
    records = spark.createDataFrame([("a", "k1", 9.5), ("b", "k1", 10.0), ("c", "k2", None), ("d", "k3", 9.5), ("e", "k4", 1.0)], "cert string, card_key string, grade double")
    members = spark.createDataFrame([("a", "dev"), ("b", "dev"), ("c", "dev"), ("d", "dev"), ("e", "test")], "cert string, split string")
    got = {r.split: (r.certs, r.groups, [tuple(g) for g in r.grades]) for r in D.split_histogram(records, members).collect()}
    assert got == {"dev": (4, 3, [(None, 1), ("9.5", 2), ("10.0", 1)]), "test": (1, 1, [("1.0", 1)])}
