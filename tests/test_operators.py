import random
import statistics

import pytest
from pyspark.sql import functions as F

from assayer.operators import evaluation as E
from assayer.operators import pricing as P
from assayer.operators import records as R
from assayer.operators.components import components
from assayer.operators.linkage import keep_best


def brute_components(edges):
    p = {}

    def find(i):
        p.setdefault(i, i)
        while p[i] != i:
            i = p[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in p}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(random.Random(i).randint(0, 80), random.Random(-i).randint(0, 80)) for i in range(60)], [(1, 1)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 1)], "a long, b long")
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert {r.id: r.component for r in components(df).collect()} == want


def test_component_names_can_be_strings(spark):
    got = components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {r.id: r.component for r in got} == {"a": "a", "b": "a", "c": "a"}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(5)]
    values = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 6))) for b in base for _ in range(12)]
    values = list(dict.fromkeys(v & (2**63 - 1) for v in values))
    got = {(r.a, r.b, r.distance) for r in R.near_pairs(spark.createDataFrame(list(enumerate(values)), "k long, v long"), "k", "v", 4).collect()}
    want = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and (x ^ y).bit_count() <= 4}
    assert got == want and want


def test_equal_values_are_chained(spark):
    got = R.near_pairs(spark.createDataFrame([(i, 7) for i in range(20)], "k long, v long"), "k", "v", 2)
    assert {(r.a, r.b) for r in got.collect()} == {(0, i) for i in range(1, 20)}


def test_split_has_no_leak_and_its_share(spark):
    rows = [(i, f"g{i // 2}", float(i // 2 % 5)) for i in range(200)]
    items = spark.createDataFrame(rows, "cert long, grp string, grade double")
    s = R.stratified_split(items, "grp", "grade", 0.3, 1)
    assert s.where("split = 'check'").count() == 30 and s.count() == 100
    assert R.leaked_keys(items.join(s, "grp"), "grp", "split").count() == 0
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, R.stratified_split(items.repartition(7), "grp", "grade", 0.3, 1).collect()))


def test_spearman_without_variance_is_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 3.0, 2.5)], "g string, x double, y double")
    got = {r.g: r.spearman for r in E.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] != got["a"] and abs(got["b"] - 1) < 1e-12


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("b", 0.5, 0), ("b", 1.0, 0)], "g string, s double, l int")
    assert {r.g: r.auc for r in E.auc(df, ["g"], "s", "l").collect()} == {"a": None, "b": 0.75}
    assert {r.g: r.recall for r in E.recall_at_fpr(df, ["g"], "s", "l").collect()} == {"a": None, "b": 0.0}


def test_log_gaps(spark):
    rows = [("x", "2026-01-01 13:00:00"), ("x", "2026-01-01 13:00:05.4"), ("x", "2026-01-01 13:00:09.9"), ("y", "2026-01-01 13:00:00")]
    got = {r.agent: r for r in R.gaps(spark.createDataFrame(rows, "agent string, at string").withColumn("ts", F.col("at").cast("timestamp")), "agent", "ts", 5.0).collect()}
    assert got["x"].min_gap == 4.5 and got["x"].short_gaps == 1 and got["y"].min_gap is None


def test_hash_states(spark):
    df = spark.createDataFrame([([True, True],), ([True, False],), ([True, None],), ([True],)], "c array<boolean>")
    assert [r[0] for r in df.select(R.all_ok(F.col("c"), 2)).collect()] == [True, False, None, None]


def test_precedence_takes_whole_records(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, None, "a")], "k int, x int, y string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 6, "b")], "k int, x int, y string")
    got = {r.k: (r.origin, r.x, r.y) for r in R.precedence(keys, "k", [("a", a, F.lit(True)), ("b", b, F.col("x") < 6)], ["x", "y"]).collect()}
    assert got == {1: ("a", None, "a"), 2: (None, None, None), 3: (None, None, None)}


def test_keep_best_and_merges(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, v int, s string")
    assert sorted(r.s for r in keep_best(df, ["k"], F.col("v").desc()).collect()) == ["b", "c"]
    more = spark.createDataFrame([(1, 7, "d"), (3, 0, "e")], "k int, v int, s string")
    assert sorted(r.s for r in R.upsert_newest(df, more, "k", "v").collect()) == ["c", "d", "e"]
    assert sorted(r.s for r in R.merge_first_wins(df.where("k = 1"), more, "k").collect()) == ["a", "b", "e"]


def test_membership_digest_does_not_depend_on_order(spark):
    a = spark.createDataFrame([("x", "test"), ("y", "dev")], "cert string, split string")
    assert R.membership_digest(a, "cert", "split") == R.membership_digest(a.orderBy("split"), "cert", "split")


def test_sales_stats_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1.5, 2.0, -1.0, None, rng.randint(1, 50) / 4]), rng.randint(0, 9), i, i % 7 == 0) for i in range(400)] + [("one", 3.0, 1, 400, False), ("two", 3.0, 1, 401, False), ("two", 4.0, 1, 402, False)]
    df = spark.createDataFrame(rows, "k string, price double, day int, i long, fixed boolean")
    got = {r.k: tuple(r)[1:] for r in P.sales_stats(df, ["k"], "price", "day", ["i"], F.col("fixed")).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key and not r[4] and r[1] is not None and r[1] > 0]
        prices = [r[1] for r in own]
        want[key] = (len(own), statistics.median(prices), min(prices), max(prices), max(own, key=lambda r: (r[2], r[3]))[1])
    assert got == want
    assert P.sales_stats(df.limit(0), ["k"], "price", "day", ["i"], F.col("fixed")).collect() == []
