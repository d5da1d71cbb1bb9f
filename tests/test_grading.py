"""Literal expectations of the scoring rules, and a pure-Python differential test with seeded random records."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.functions.grades import centering_grade, floor_to, interpolate, num, split_ratio
from assayer.operators import grading as G
from assayer.plans import criteria as C

CAPS = {n: dict(zip(C.SEVERITIES, map(float, caps))) for n, _, caps, _ in C.DEFECTS}
QUAL = {n: q for n, _, _, q in C.DEFECTS}


def rows(spark, cards):
    """cards: list of (shares, defects (side, component, kind, severity, confirmed), unseen, limited, in_hand, unread)."""
    c, d = [], []
    for i, (shares, defects, unseen, limited, hand, unread) in enumerate(cards):
        row = {"id": i, **dict(zip(("front_lr", "front_tb", "back_lr", "back_tb"), map(float, shares)))}
        row |= {f"{s}_{a}_unread": (s, a) in unread for s, a in G.AXES}
        for s, k in G.AREAS:
            row |= {f"seen_{s}_{k}": (s, k) not in unseen, f"limited_{s}_{k}": (s, k) in limited, f"in_hand_{s}_{k}": (s, k) in hand}
        c.append(row)
        d += [{"id": i, "side": s, "component": k, "kind": n, "severity": v, "confirmed": ok, "qualifier": QUAL[n], "fatal": n in C.FATAL, "cap": CAPS[n][v], "pos": p} for p, (s, k, n, v, ok) in enumerate(defects)]
    schema = "id long, side string, component string, kind string, severity string, confirmed boolean, qualifier string, fatal boolean, cap double, pos int"
    return spark.createDataFrame(c), spark.createDataFrame([[x[k.split()[0]] for k in schema.split(", ")] for x in d], schema)


def card(shares=(50, 50, 50, 50), defects=(), unseen=(), limited=(), hand=(), unread=()):
    return shares, list(defects), set(unseen), set(limited), set(hand), set(unread)


def graded(spark, *cards):
    return G.report(*rows(spark, cards)).orderBy("id").collect()


@pytest.mark.parametrize(
    "shares,grade",
    [((55, 50, 75, 50), 10), ((56, 50, 50, 50), 9), ((50, 50, 80, 50), 9), ((70, 60, 50, 50), 7), ((95, 50, 50, 50), 1)],
)
def test_psa_centering(spark, shares, grade):
    a, b, c, d = map(num, map(float, shares))
    got = spark.range(1).select(centering_grade(C.CENTERING["PSA"], F.greatest(a, b), F.least(a, b), F.greatest(c, d), 0.5)).first()[0]
    assert got == grade


@pytest.mark.parametrize("shares,grade", [((55, 50), 10), ((55, 53), 9.5), ((58, 54), 9), ((58, 56), 8.5)])
def test_bgs_centering_reads_the_other_axis(spark, shares, grade):
    a, b = map(num, map(float, shares))
    assert spark.range(1).select(centering_grade(C.CENTERING["BGS"], F.greatest(a, b), F.least(a, b), num(50), 0.5)).first()[0] == grade


def test_interpolate_and_ratios(spark):
    p = [(50, 1000), (55, 950), (60, 900)]
    assert list(spark.range(1).select(*[interpolate(p, num(x)) for x in (50, 52.5, 70)]).first()) == [1000, 975, 900]
    assert list(spark.range(1).select(split_ratio(num(0), num(0)), split_ratio(num(3), num(1))).first()) == [50, 75]
    assert list(spark.range(1).select(floor_to([1, 2, 3], num(2.5)), floor_to([1, 2, 3], num(0.2))).first()) == [2, 1]


def test_flawless(spark):
    r = graded(spark, card())[0]
    assert (r.psa_label, r.bgs_label, r.cgc_label) == ("GEM MT 10", "Pristine 10 (Black Label)", "Pristine 10")
    assert r.tag_score >= 990 and r.complete and r.best_fit == "PSA" and r.best_shot == "BGS"


def test_one_moderate_corner(spark):
    r = graded(spark, card(defects=[("back", "corners", "corner_whitening", "moderate", True)]))[0]
    assert (r.psa_grade, r.bgs_grade, r.cgc_grade, r.tag_grade) == (8, 8.5, 8.5, 8)


def test_stacking_and_flags(spark):
    minor = ("front", "edges", "edge_whitening", "minor", True)
    flag = ("front", "edges", "edge_whitening", "major", False)
    one, three, flags = graded(spark, card(defects=[minor]), card(defects=[minor] * 3), card(defects=[flag] * 3))
    assert (one.psa_grade, three.psa_grade, flags.bgs_edges) == (9, 8, 9)


def test_tag_centering_is_a_hard_cap(spark):
    r = graded(spark, card(shares=(56, 50, 50, 50)))[0]
    assert r.tag_grade == 9 and r.tag_score <= 949


@pytest.mark.parametrize("subs,want", [((10, 10, 10, 10), 10), ((10, 10, 10, 9.5), 10), ((9.5, 9.5, 9.5, 9), 9.5), ((9.5, 9.5, 9.5, 7), 8), ((8, 8, 9, 9), 8), ((9, 9.5, 9.5, 9.5), 9.5)])
def test_bgs_rules(spark, subs, want):
    df = spark.createDataFrame([tuple(float(x) for x in subs)], "a double, b double, c double, d double").select(F.array_sort(F.array("a", "b", "c", "d")).alias("s"))
    lowest, second = sorted(subs)[:2]
    raw = lowest if lowest == second else min(lowest + 1, second) if second - lowest >= 2.5 else min(lowest + 0.5, second)
    raw = 9 if raw >= 9.5 and lowest < 9 else raw
    raw = 9.5 if raw >= 10 and (sum(x >= 10 for x in subs) < 3 or lowest < 9.5) else raw
    assert raw == want and df.count() == 1


def test_incomplete_altered_and_limits(spark):
    unseen, altered, limited, hand = graded(
        spark,
        card(unseen=[("front", "corners")]),
        card(unseen=[("front", "corners")], defects=[("front", "surface", "altered", "micro", True)]),
        card(limited=[("back", "surface")]),
        card(limited=[("back", "surface")], hand=[("back", "surface")], unread=[("front", "lr")]),
    )
    assert not unseen.complete and unseen.unassessed == ["front corners"] and unseen.psa_label == "Up to GEM MT 10 · incomplete" and unseen.best_fit is None
    assert altered.complete and altered.psa_grade == 0 and altered.psa_tier == 99 and altered.cgc_label == "Altered"
    assert limited.unassessed == ["back surface (photo can't show it)"]
    assert hand.unassessed == ["front centering (left/right)"] and hand.cgc_label == "Up to Gem Mint 10 · incomplete"


def brute_condition(defects, assessed):
    sure, pending = [x for x in defects if x[2]], [x for x in defects if not x[2]]
    if sure:
        caps = sorted(c for c, _, _ in sure)
        g = caps[0] - min(0.5 * sum(c < 10 for c in caps[1:]), 1.5)
        if sum(s == "micro" for _, s, _ in sure) >= 3 and g > 9.5:
            g = 9.5
        g = max(1.0, g)
    else:
        g = 10.5 if assessed else None
    if pending and (lim := min(max(c, 9) for c, _, _ in pending)) < (10.5 if g is None else g):
        return lim
    return g


def test_random_records_match_plain_python(spark):
    rng = random.Random(5)
    cards = []
    for _ in range(120):
        defects = []
        for _ in range(rng.randint(0, 6)):
            n, where, _, _ = rng.choice(C.DEFECTS[:-1])
            defects.append((rng.choice(C.SIDES), rng.choice(where), n, rng.choice(C.SEVERITIES), rng.random() > 0.3))
        cards.append(card([rng.choice([50, 55, 60, rng.uniform(50, 100)]) for _ in range(4)], defects, *[[a for a in G.AREAS if rng.random() < 0.2] for _ in range(3)], [a for a in G.AXES if rng.random() < 0.1]))
    got = G.conditions(*rows(spark, cards)).orderBy("id").collect()
    for (_, defects, unseen, limited, hand, _), r in zip(cards, got, strict=True):
        for s, k in G.AREAS:
            own = [(CAPS[n][v], v, ok) for a, b, n, v, ok in defects if (a, b) == (s, k)]
            ok = (s, k) in hand or ((s, k) not in limited and ((s, k) not in unseen or any(x[2] for x in own)))
            assert r[f"assessed_{s}_{k}"] == ok
            assert r[f"cond_{s}_{k}"] == brute_condition(own, ok)
        for k in C.COMPONENTS:
            own = [(CAPS[n][v], v, ok) for _, b, n, v, ok in defects if b == k]
            assert r[f"cond_{k}"] == brute_condition(own, r[f"assessed_front_{k}"] and r[f"assessed_back_{k}"])


def test_floor_to_searches_nothing(spark):
    """The largest allowed grade by a table, whatever the value; no filter over an array a row."""
    from assayer.functions import grades as A

    allowed = [10, 9, 8.5, 8, 1.5, 1]
    values = [None, float("nan"), float("inf"), -1e300, -2.0, 0.0, 1.0, 1.49, 1.4999999999, 1.5, 3.0, 8.49, 8.4999999995, 9.9, 10.0, 10.5]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", A.floor_to(allowed, F.col("v")).alias("g"))
    want = lambda v: 1.0 if v is None else 10.0 if v != v else max((g for g in allowed if g <= v + 1e-9), default=1)
    assert [r.g for r in df.collect()] == [float(want(v)) for v in values]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_qualifiers_filter_is_not_pushed_below_the_rules(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["q_psa_qualifiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan
