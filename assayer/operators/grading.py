"""Scoring: inspection records to per-scheme grades with explicit completeness.

``cards``: one row per card with id, four shares (front_lr, front_tb, back_lr, back_tb), four *_unread flags, and for each
side and component seen, limited and in_hand flags (``seen_front_corners`` and so on). ``defects``: id, side, component,
cap, severity, confirmed, qualifier, fatal, pos. Defects are reduced in one aggregation by id (with map-side combining);
every rule after that is a projection, so a whole report costs one shuffle of each input.

The rules' columns don't depend on a table; they are built once in a process, as stages that add columns one after
another.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.grades import as_of, band, centering_grade, floor_to, format_g, interpolate, label_of, num, place_of
from assayer.plans import criteria as C

AREAS = [(s, c) for s in C.SIDES for c in C.COMPONENTS]
AXES = [(s, a) for s in C.SIDES for a in ("lr", "tb")]


def _parts(test: Column, name: str) -> list[Column]:
    """The partial facts of one group of defects from which its condition follows."""
    sure, open_ = test & F.col("confirmed"), test & ~F.col("confirmed")
    return [
        F.min(F.when(sure, F.col("cap"))).alias(f"worst_{name}"),
        F.count_if(sure & (F.col("cap") < 10)).alias(f"low_{name}"),
        F.count_if(sure & (F.col("severity") == "micro")).alias(f"micro_{name}"),
        F.min(F.when(open_, F.greatest(F.col("cap"), num(C.UNCONFIRMED_FLOOR)))).alias(f"limit_{name}"),
    ]


Stages = tuple[dict[str, Column], ...]


def added(df: DataFrame, stages: Stages) -> DataFrame:
    for columns in stages:
        df = df.withColumns(columns)
    return df


@cache
def _facts() -> tuple[Column, ...]:
    aggs = [F.bool_or(F.col("confirmed") & F.col("fatal")).alias("altered")]
    heavy = F.col("confirmed") & F.col("severity").isin("moderate", "major")
    for side, comp in AREAS:
        aggs += _parts((F.col("side") == side) & (F.col("component") == comp), f"{side}_{comp}")
    for q, comp in C.QUALIFIERS:
        hit = heavy & F.col("qualifier").eqNullSafe(q)
        aggs.append(F.min(F.when(hit, F.col("pos"))).alias(f"first_{q}"))
        for side in C.SIDES:
            aggs += _parts((F.col("side") == side) & (F.col("component") == comp) & ~hit, f"{side}_{comp}_no{q}")
    return tuple(aggs)


def reduced(defects: DataFrame) -> DataFrame:
    """One row per id: the facts of each area, of each area without one qualifier's defects, qualifiers and fatality."""
    return defects.groupBy("id").agg(*_facts())


def is_assessed(side: str, comp: str) -> Column:
    """In hand, or not hidden from the photo and either inspected or with a confirmed defect."""
    hand, limited, seen = (F.col(f"{k}_{side}_{comp}") for k in ("in_hand", "limited", "seen"))
    return hand | (~(limited & ~hand) & (seen | F.col(f"worst_{side}_{comp}").isNotNull()))


def condition(worst: Column, low: Column, micro: Column, limit: Column, assessed: Column) -> Column:
    """A component's grade; null where nothing is listed and nobody looked."""
    others = low - F.when(worst < 10, 1).otherwise(0)
    stacked = worst - F.least(others * C.STACK_PENALTY, num(C.MAX_STACK_PENALTY))
    stacked = F.when((micro >= C.MICRO_STACK_COUNT) & (stacked > C.MICRO_STACK_GRADE), num(C.MICRO_STACK_GRADE)).otherwise(stacked)
    sure = F.when(worst.isNotNull(), F.greatest(num(1), stacked)).when(assessed, num(C.FLAWLESS))
    return F.when(limit.isNotNull() & (limit < F.coalesce(sure, num(C.FLAWLESS))), limit).otherwise(sure)


def _both(comp: str, suffix: str = "") -> Column:
    """Condition of a component over both sides."""
    a, b = (f"{s}_{comp}{suffix}" for s in C.SIDES)
    two = lambda k, f: f(F.col(f"{k}_{a}"), F.col(f"{k}_{b}"))
    plus = lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    assessed = F.col(f"assessed_front_{comp}") & F.col(f"assessed_back_{comp}")
    if suffix:  # without some defects an area may be assessed no longer
        assessed = is_assessed_without("front", comp, suffix) & is_assessed_without("back", comp, suffix)
    return condition(two("worst", F.least), two("low", plus), two("micro", plus), two("limit", F.least), assessed)


def is_assessed_without(side: str, comp: str, suffix: str) -> Column:
    hand, limited, seen = (F.col(f"{k}_{side}_{comp}") for k in ("in_hand", "limited", "seen"))
    return hand | (~(limited & ~hand) & (seen | F.col(f"worst_{side}_{comp}{suffix}").isNotNull()))


@cache
def _condition_stages() -> Stages:
    first = {"altered": F.coalesce("altered", F.lit(False))} | {f"assessed_{s}_{c}": is_assessed(s, c) for s, c in AREAS}
    made = {}
    for s, c in AREAS:
        n = f"{s}_{c}"
        made[f"cond_{n}"] = condition(F.col(f"worst_{n}"), F.coalesce(f"low_{n}", F.lit(0)), F.coalesce(f"micro_{n}", F.lit(0)), F.col(f"limit_{n}"), F.col(f"assessed_{n}"))
    for c in C.COMPONENTS:
        made[f"cond_{c}"] = _both(c)
    for s, a in AXES:
        share = F.col(f"{s}_{a}")
        made[f"graded_{s}_{a}"] = F.when(F.col(f"{s}_{a}_unread"), F.greatest(share, num(C.UNREAD_SHARE))).otherwise(share)
    return first, made, {f"{k}_{s}": f(f"graded_{s}_lr", f"graded_{s}_tb") for s in C.SIDES for k, f in (("most", F.greatest), ("least", F.least))}


def conditions(cards: DataFrame, defects: DataFrame) -> DataFrame:
    """``cards`` with assessed_*, cond_<side>_<component>, cond_<component>, graded shares and worst and best axes."""
    return added(cards.join(reduced(defects), "id", "left"), _condition_stages())


def centering(scheme: str) -> Column:
    return centering_grade(C.CENTERING[scheme], F.col("most_front"), F.col("least_front"), F.col("most_back"), C.TOLERANCE)


def ceiling(c: str) -> Column:
    return F.coalesce(F.col(c), num(C.FLAWLESS))


def missing_areas() -> Column:
    """Names of unread axes and unassessed components, front first."""
    items = []
    for s in C.SIDES:
        items += [F.when(F.col(f"{s}_{a}_unread"), F.lit(f"{s} centering ({'left/right' if a == 'lr' else 'top/bottom'})")) for a in ("lr", "tb")]
        for c in C.COMPONENTS:
            hidden = F.col(f"limited_{s}_{c}") & ~F.col(f"in_hand_{s}_{c}")
            name = F.when(hidden, f"{s} {c} (photo can't show {'it' if c == 'surface' else 'them'})").otherwise(f"{s} {c}")
            items.append(F.when(~F.col(f"assessed_{s}_{c}"), name))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _grades(labels) -> list[float]:
    return [float(g) for g, _ in labels]


@cache
def _psa_stages() -> Stages:
    g = _grades(C.PSA)
    parts = {"psa_centering": centering("PSA")} | {f"psa_{c}": floor_to(g, F.least(num(10), ceiling(f"cond_{c}"))) for c in C.COMPONENTS}
    body = {"psa_body": F.least(*[F.col(f"psa_{c}") for c in C.COMPONENTS])}
    overall = {"psa_overall": floor_to(g, F.least("psa_body", "psa_centering"))}
    alts = {}
    for q, comp in C.QUALIFIERS:
        rest = [F.col(f"psa_{c}") for c in C.COMPONENTS if c != comp]
        without = F.least(floor_to(g, F.least(num(10), F.coalesce(_both(comp, f"_no{q}"), num(C.FLAWLESS)))), *rest)
        alts[f"psa_without_{q}"] = F.when(F.col(f"first_{q}").isNotNull(), floor_to(g, F.least(without, F.col("psa_centering"))))
    found = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"first_{q}").alias("pos"), F.lit(q).alias("q"), F.col(f"psa_without_{q}").alias("alt")) for q, _ in C.QUALIFIERS]), lambda x: x["pos"].isNotNull()))
    off = F.col("psa_centering") < F.col("psa_body")
    better = F.transform(F.filter("psa_found", lambda x: x["alt"] > F.col("psa_overall")), lambda x: F.concat(F.lit("PSA "), format_g(x["alt"]), F.lit(" "), x["q"]))
    return parts, body, overall, alts, {"psa_found": found}, {
        "psa_qualifiers": F.concat(F.when(off, F.array(F.lit("OC"))).otherwise(F.array().cast("array<string>")), F.transform("psa_found", lambda x: x["q"])),
        "psa_alternatives": F.concat(F.when(off, F.array(F.concat(F.lit("PSA "), format_g(F.col("psa_body")), F.lit(" OC")))).otherwise(F.array().cast("array<string>")), better),
        "psa_grade": F.col("psa_overall"),
        "psa_label": label_of(C.PSA, F.col("psa_overall")),
        "psa_tier": place_of(C.PSA, F.col("psa_overall")),
    }


def psa(df: DataFrame) -> DataFrame:
    """Adds psa_centering, psa_<component>, psa_body, psa_overall, psa_label, psa_tier, psa_qualifiers, psa_alternatives."""
    return added(df, _psa_stages())


def _sorted_subs(prefix: str) -> Column:
    return F.array_sort(F.array(*[F.col(f"{prefix}_{k}") for k in ("centering", *C.COMPONENTS)]))


@cache
def _bgs_stages() -> Stages:
    g = _grades(C.BGS)
    sub = lambda x: F.when(x >= C.FLAWLESS, num(10)).otherwise(floor_to(g, F.least(x, num(9.5))))
    parts = {"bgs_centering": centering("BGS")} | {f"bgs_{c}": sub(ceiling(f"cond_{c}")) for c in C.COMPONENTS}
    low, second = F.get("bgs_subs", 0), F.get("bgs_subs", 1)
    raw = F.when(low == second, low).when(second - low >= C.OUTLIER_GAP, F.least(low + C.OUTLIER_BONUS, second)).otherwise(F.least(low + C.MAX_ABOVE_LOWEST, second))
    raw = F.when((raw >= 9.5) & (low < 9), num(9)).otherwise(raw)
    tens = F.size(F.filter("bgs_subs", lambda s: s >= 10))
    raw = F.when((raw >= 10) & ((tens < 3) | (low < 9.5)), num(9.5)).otherwise(raw)
    black = low == 10
    shown = {"bgs_label": F.when(black, C.BLACK_LABEL).otherwise(label_of(C.BGS, F.col("bgs_grade"))), "bgs_tier": F.when(black, 0).otherwise(place_of(C.BGS, F.col("bgs_grade"), 1))}
    return parts, {"bgs_subs": _sorted_subs("bgs")}, {"bgs_grade": floor_to(g, raw)}, shown


def bgs(df: DataFrame) -> DataFrame:
    """Adds bgs_centering, bgs_<component>, bgs_grade, bgs_label, bgs_tier."""
    return added(df, _bgs_stages())


@cache
def _cgc_stages() -> Stages:
    g = _grades(C.CGC)
    parts = {"cgc_centering": centering("CGC")} | {f"cgc_{c}": floor_to(g, ceiling(f"cond_{c}")) for c in C.COMPONENTS}
    low, second = F.get("cgc_subs", 0), F.get("cgc_subs", 1)
    overall = {"cgc_overall": floor_to(g, F.when((low >= 9.5) | (low == second), low).otherwise(F.least(low + C.MAX_ABOVE_LOWEST, second, num(9.5))))}
    return parts, {"cgc_subs": _sorted_subs("cgc")}, overall, {"cgc_grade": F.least("cgc_overall", num(10)), "cgc_label": label_of(C.CGC, F.col("cgc_overall")), "cgc_tier": place_of(C.CGC, F.col("cgc_overall"))}


def cgc(df: DataFrame) -> DataFrame:
    """Adds cgc_centering, cgc_<component>, cgc_overall, cgc_grade, cgc_label, cgc_tier."""
    return added(df, _cgc_stages())


@cache
def _tag_stages() -> Stages:
    points = {f"tag_{s}_centering": interpolate(C.TAG_CENTERING_POINTS[s], F.col(f"most_{s}")) for s in C.SIDES} | {f"tag_{s}_{c}": as_of(C.TAG_CONDITION_POINTS, ceiling(f"cond_{s}_{c}")) for s, c in AREAS}
    areas = [(s, f"tag_{s}_{k}") for s in C.SIDES for k in ("centering", *C.COMPONENTS)]
    mean = num(0)
    for s, a in areas:
        mean = mean + F.col(a) * num(C.TAG_SIDE_WEIGHTS[s] / 4)
    w = C.TAG_WEAKEST_WEIGHT
    raw = {"tag_centering": centering("TAG"), "tag_raw": num(w) * F.least(*[F.col(a) for _, a in areas]) + num(1 - w) * mean}
    cap = None  # a point below the band above the first one that the centering grade reaches
    for above, (_, grade, _) in zip((None, *C.TAG_BANDS), C.TAG_BANDS, strict=False):
        test, value = F.col("tag_centering") >= grade, F.lit(None).cast("double") if above is None else num(above[0] - 1)
        cap = F.when(test, value) if cap is None else cap.when(test, value)
    capped = F.least(F.col("tag_raw"), cap)  # least skips a null cap
    score = {"tag_score": F.rint(F.greatest(num(100), F.least(num(1000), capped))).cast("int")}
    shown = {"tag_grade": F.least(band(C.TAG_BANDS, F.col("tag_score"), 1), num(10)), "tag_label": band(C.TAG_BANDS, F.col("tag_score"), 2), "tag_tier": F.coalesce(*[F.when(F.col("tag_score") >= b[0], i) for i, b in enumerate(C.TAG_BANDS)], F.lit(len(C.TAG_BANDS) - 1))}
    return points, raw, score, shown


def tag(df: DataFrame) -> DataFrame:
    """Adds tag_<area>, tag_score, tag_grade, tag_label, tag_tier. The eight area scores are summed in a fixed order, so
    that the double result is the same everywhere."""
    return added(df, _tag_stages())


GRADERS = {"PSA": psa, "BGS": bgs, "CGC": cgc, "TAG": tag}


@cache
def _report_stages() -> Stages:
    incomplete = (F.size("missing") > 0) & ~F.col("altered")
    out = {"complete": ~incomplete, "unassessed": F.when(incomplete, F.col("missing")).otherwise(F.array().cast("array<string>"))}
    for name in GRADERS:
        k = name.lower()
        label = F.col(f"{k}_label")
        out[f"{k}_grade"] = F.when(F.col("altered"), num(0)).otherwise(F.col(f"{k}_grade"))
        out[f"{k}_label"] = F.when(F.col("altered"), C.ALTERED_LABELS[name]).when(incomplete, F.concat(F.lit("Up to "), label, F.lit(" · incomplete"))).otherwise(label)
        out[f"{k}_tier"] = F.when(F.col("altered"), 99).when(~incomplete, F.col(f"{k}_tier"))
    out["tag_score"] = F.when(~F.col("altered"), F.col("tag_score"))
    ranked = F.array(*[F.struct(F.col(f"{n.lower()}_tier").alias("tier"), F.lit(i).alias("i"), F.lit(n).alias("scheme")) for i, n in enumerate(GRADERS)])
    fit = {"best_fit": F.when(F.col("complete"), F.array_min(ranked)["scheme"])}
    # the display rule differs: Black Label above Pristine above the numeric grade, altered below all
    rank = lambda k: F.when(F.col("altered"), num(-1)).when(F.col(f"{k}_label").contains("Black Label"), num(11)).when(F.col(f"{k}_label").contains("Pristine"), num(10.5)).otherwise(F.col(f"{k}_grade"))
    shots = F.array(*[F.struct(rank(n.lower()).alias("rank"), F.lit(-i).alias("i"), F.lit(n).alias("scheme")) for i, n in enumerate(GRADERS)])
    return {"missing": missing_areas()}, out, fit | {"best_shot": F.array_max(shots)["scheme"], "best_shot_rank": F.array_max(shots)["rank"]}


def report(cards: DataFrame, defects: DataFrame) -> DataFrame:
    """All schemes: <scheme>_grade, _label and _tier as reported, unassessed areas, complete, best_fit, best_shot."""
    df = conditions(cards, defects)
    # schemes don't read each other's columns: their stages of equal depth are added together
    own = [_psa_stages(), _bgs_stages(), _cgc_stages(), _tag_stages()]
    for depth in range(max(map(len, own))):
        df = df.withColumns({k: v for s in own if depth < len(s) for k, v in s[depth].items()})
    return added(df, _report_stages())
