"""Runs over several ranges and nested validation, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import runs as R
from assayer.operators import schema as S


def loop(rows, gap, least):
    out = []
    for key in {k for k, _, _ in rows}:
        own = sorted(p for k, p, m in rows if k == key and m)
        run = []
        for p in [*own, None]:
            if run and (p is None or p - run[-1] > gap + 1):
                if run[-1] - run[0] + 1 >= least:
                    out.append((str(key), run[0], run[-1], len(run)))
                run = []
            run.append(p)
    return sorted(out)


@pytest.mark.parametrize(("gap", "least", "share"), [(0, 1, 0.5), (2, 3, 0.4), (1, 2, 0.97), (5, 1, 0.2)])
def test_runs_cross_ranges(spark, gap, least, share):
    """One key holds most rows, so its runs cross several ranges; at a share of 0.97 one run crosses whole ranges."""
    rng = random.Random(gap)
    rows = [(k, p, rng.random() < share) for k, n in (("hot", 900), ("b", 40), (None, 30), ("c", 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, p long, m boolean").repartition(3)
    got = sorted((str(r.k), r.start, r.end, r.marks) for r in R.marked_runs(df, "k", "p", F.col("m"), gap, least).collect())
    assert got == loop(rows, gap, least)
    assert R.marked_runs(df.limit(0), "k", "p", F.col("m"), gap, least).collect() == []


def test_numbers_first_runs_and_stops(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.4, rng.randint(1, 9)) for i, k in enumerate(rng.choice(["hot", "hot", "hot", "b", None]) for _ in range(500))]
    df = spark.createDataFrame(rows, "k string, i long, f boolean, size int")
    numbers, before, stops, sized = [], {}, [], []
    for key in ("hot", "b", None):
        run, over = 0, False
        for n, (_, i, f, size) in enumerate([r for r in rows if r[0] == key], 1):
            numbers.append((i, n))
            run = run + 1 if f else 0
            if not over:
                stops.append(i)
            over = over or run == 3
            if before.get(key, 0) < 60:
                sized.append(i)
            before[key] = before.get(key, 0) + size
    assert sorted((r.i, r.pos) for r in R.numbered(df, "k", "i").collect()) == sorted(numbers)
    assert sorted(r.i for r in R.failure_stop(df, "k", "i", F.col("f"), 3).collect()) == sorted(stops)
    assert sorted(r.i for r in R.size_stop(df, "k", "i", "size", 60).collect()) == sorted(sized)


def test_rows_before_cross_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 300)) for _ in range(400)]
    got = sorted((str(r.k), r.t, -1 if r.p is None else r.p) for r in R.lagged(spark.createDataFrame(rows, "k string, t int"), "k", "t", "p").collect())
    want = []
    for key in ("hot", "b", None):
        own = sorted(t for k, t in rows if k == key)
        want += [(str(key), t, p) for t, p in zip(own, [-1, *own])]
    assert got == sorted(want)


def test_schema_errors(spark):
    rules = [("a", "string", True, "x|y", None), ("m", "object", False, None, None), ("m.*", "object", False, None, None), ("m.*.n", "integer|null", True, None, None), ("l", "array", True, None, None), ("l[]", "object", False, None, None), ("l[].p", "string", True, None, "[a-z]+")]
    document = S.schema_of_rules([dict(zip(("path", "type", "required", "enum", "pattern"), r)) for r in rules])
    cases = [
        ('{"a":"x","l":[]}', []),
        ('{"a":"z","l":[{"p":"ab"},{"p":"A"},{},3]}', ["$.a: not one of x, y", "$.l[1].p: malformed", "$.l[2].p: missing", "$.l[3]: not object"]),
        ('{"l":{}}', ["$.a: missing", "$.l: not array"]),
        ('{"a":null,"l":[],"m":{"u":{"n":1},"v":{"n":null},"w":{"n":1.5},"x":{},"y":[]}}', ["$.a: not string", "$.m.w.n: not integer or null", "$.m.x.n: missing", "$.m.y: not object"]),
        ("[]", ["$: not object"]),
        ("{", ["$: not JSON"]),
        (None, ["$: not JSON"]),
        ('{"a":"x","l":[' + ",".join(['{"p":"q"}'] * 5000) + ',{"p":1}]}', ["$.l[5000].p: not string"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    got = df.select("i", S.schema_errors(F.col("r"), document).alias("e")).orderBy("i").collect()
    assert [sorted(r.e) for r in got] == [sorted(c[1]) for c in cases]
    bounds = {"type": "object", "properties": {"n": {"type": "number", "min": 0, "max": 5}}}
    got = spark.createDataFrame([("{\"n\":-1}",), ("{\"n\":5.5}",), ("{\"n\":3}",)], "r string").select(S.schema_errors(F.col("r"), bounds).alias("e")).collect()
    assert [r.e for r in got] == [["$.n: min is 0"], ["$.n: max is 5"], []]
