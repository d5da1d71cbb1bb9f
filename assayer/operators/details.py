"""Smaller operators: the photo gate, cautions, shown subgrades, locations, sealed-key joins, price fallback, split
summaries, candidates of both catalogs, data by name, durations, and a perceptual hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.grades import num
from assayer.functions.tables import composed, in_steps
from assayer.functions.text import number_key, plain_any
from assayer.operators import evaluation as E
from assayer.operators.cards import rift_number, rift_parts, rift_variant, year_prefix
from assayer.plans import criteria as C

# ---------------------------------------------------------------- photo gate

# Sides and corners in order; a corner touches the side of its place and the one before.
EDGES = ("top", "right", "bottom", "left")
CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")
ALL_EDGES, ALL_CORNERS = [f"edges:{s}" for s in EDGES], [f"corners:{c}" for c in CORNERS]
ITEMS = ["centering", "surface", *ALL_EDGES, *ALL_CORNERS]
# Limits of the checks.
BLUR_OK_MM, BLUR_FAIL_MM, GLARE_ZONE, GLARE_WARN, GLARE_FAIL = 0.1092, 0.168, 0.02, 0.01, 0.15
RESOLUTION_WARN, RESOLUTION_FAIL, PAD_LEAST, PAD_SHARE, CUT_OFF, ROUNDED = 600, 350, 4.0, 0.01, 2.0, 0.1
KEYSTONE, ASPECT, ANGLE_WARN, DETECTION = (0.06, 0.15), (0.04, 0.08), 8.0, (0.7, 0.5)
CHECKS = ("sharpness", "glare", "resolution", "boundary", "perspective", "detection", "sleeve")


def _hundredths(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def _graded(value: Column, warn: float, fail: float) -> Column:
    return F.when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")


def _some_of(names: tuple[str, ...]) -> Column:
    """All 2 ** n lists of some ``names``, in their order; name i is in those whose place has bit i."""
    lists = [", ".join(f"'{n}'" for i, n in enumerate(names) if k >> i & 1) for k in range(1 << len(names))]
    return F.expr(f"array({', '.join(f'array({x})' for x in lists)})")


def _photo_facts(given: dict[str, Column]) -> dict[str, Column]:
    """Checks that need no other one, the tests of each place, and what later steps need of ``m``, so that it is left here."""
    m = given["m"]
    blur, per_mm, width, seen = _hundredths(m["blur"]), m["px_per_mm"], F.floor(m["card_px"] + 0.5), F.coalesce(m["detection"], num(0))
    tilted = F.when((m["keystone"] > KEYSTONE[1]) | (m["aspect_error"] > ASPECT[1]), "fail").when((m["keystone"] > KEYSTONE[0]) | (m["aspect_error"] > ASPECT[0]) | (m["angle_error"] > ANGLE_WARN), "warn").otherwise("ok")
    near, off = F.slice(m["inset"], 1, 4), lambda x: x < CUT_OFF
    return {
        "glare_share": m["glare"], "cropped": m["cropped"], "full_frame": m["full_frame"],
        "sharpness": F.when(blur.isNull(), "warn").when(blur <= _hundredths(per_mm * BLUR_OK_MM), "ok").when(blur <= _hundredths(per_mm * BLUR_FAIL_MM), "warn").otherwise("fail"),
        "resolution": F.when(width < RESOLUTION_FAIL, "fail").when(width < RESOLUTION_WARN, "warn").otherwise("ok"),
        "perspective": F.when(m["full_frame"], "ok").otherwise(tilted),
        "detection": F.when(seen < DETECTION[1], "fail").when(seen < DETECTION[0], "warn").otherwise("ok"),
        "sleeve": F.when(m["sleeve"], "warn").otherwise("ok"),
        "zone": F.transform(F.slice(m["glare_zones"], 1, 8), lambda x: F.floor(x * 1000 + 0.5) / 1000 >= GLARE_ZONE),
        "cut": F.transform(near, off), "tight": F.transform(near, lambda x: ~off(x) & (x < F.greatest(num(PAD_LEAST), m["photo_px"] * PAD_SHARE))),
        "square": F.transform(F.slice(m["rounded"], 1, 4), lambda x: ~m["full_frame"] & (x < ROUNDED)),
    }


def _photo_cases(f: dict[str, Column]) -> dict[str, Column]:
    """Glare and the kind of boundary, from the tests of places."""
    some = lambda name: F.array_contains(f[name], True)
    squares = reduce(lambda a, b: a + b, [F.get(f["square"], F.lit(i)).cast("int") for i in range(4)])
    case = F.when(f["cropped"], "cropped").when(f["full_frame"], "frame").when(some("cut"), "cut").when(some("tight"), "tight").when(squares >= 3, "square").when(squares == 2, "squarish").otherwise("ok")
    return {"glare": F.when(f["glare_share"] >= GLARE_FAIL, "fail").when(some("zone") | (f["glare_share"] >= GLARE_WARN), "warn").otherwise("ok"), "case": case}


def _photo_gate(f: dict[str, Column]) -> dict[str, Column]:
    """The struct of ``photo_gate``. Reasons are looked up by the bits of their tests, in a constant table."""
    case = f["case"]
    status = {c: f[c] if c in f else F.when(case.isin("frame", "cut", "square"), "fail").when(case == "ok", "ok").otherwise("warn") for c in CHECKS}
    whole, has = case.isin("frame", "square"), lambda name, i: F.get(f[name], F.lit(i))

    def reasons(item: str) -> Column:
        kind, _, place = item.partition(":")
        small = kind in ("edges", "corners")
        found: list[tuple[str, Column]] = []
        if small or kind == "surface":
            found.append(("sharpness", status["sharpness"] == "fail"))
        at = (*EDGES, *CORNERS).index(place) if small else -1
        found.append(("glare", has("zone", at) if small else status["glare"] == "fail"))
        if small or kind == "surface":
            found.append(("resolution", status["resolution"] == "fail" if kind == "surface" else status["resolution"] != "ok"))
        if kind == "centering":
            found.append(("boundary", whole | (case == "cut")))
        elif kind == "edges":  # a side lies between the corner of its own place and the next one
            found.append(("boundary", whole | ((case == "cut") & (has("cut", at) | has("cut", (at + 1) % 4)))))
        elif kind == "corners":
            i = at - 4
            found.append(("boundary", (case == "frame") | ((case == "cut") & has("cut", i)) | ((case == "tight") & has("tight", i)) | (case.isin("square", "squarish") & has("square", i))))
        if small:
            found.append(("perspective", status["perspective"] == "fail"))
        if small or kind == "centering":
            found.append(("detection", status["detection"] == "fail"))
        bits = reduce(lambda a, b: a + b, [F.when(test, 1 << i).otherwise(0) for i, (_, test) in enumerate(found)])
        return F.get(_some_of(tuple(name for name, _ in found)), bits)

    why = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ITEMS)), F.array(*map(reasons, ITEMS))), lambda k, v: F.size(v) > 0)
    any_ = lambda s: reduce(lambda a, b: a | b, [c == s for c in status.values()])
    verdict = F.when(any_("fail"), "rescan").when(any_("warn"), "warn").otherwise("ok")
    return {"gate": F.struct(*[v.alias(k) for k, v in status.items()], F.map_keys(why).alias("blocked"), why.alias("reasons"), verdict.alias("verdict"))}


_PHOTO_STEPS = (_photo_facts, _photo_cases, _photo_gate)


def photo_gate(m: Column) -> Column:
    """status of each of CHECKS, blocked (ITEMS that can't be judged, in their order), reasons (of each of these) and
    verdict. ``m``: blur (null: too little detail) and px_per_mm; glare and glare_zones (share of clipped pixels in all,
    and by EDGES then CORNERS); card_px; inset (distance of each corner to the photo's edge), photo_px (its short side),
    full_frame, cropped and rounded (by corner); keystone, aspect_error, angle_error; detection; sleeve."""
    return composed({"m": m}, _PHOTO_STEPS)["gate"]


def photo_gates(photos: DataFrame, m: Column) -> DataFrame:
    """``photos`` and ``photo_gate(m)`` as the column ``gate``, each test evaluated once a photo."""
    return in_steps(photos, {"m": m}, _PHOTO_STEPS, "gate")


def cautions(side: str, quality: Column, warnings: Column, unjudged: Column) -> Column:
    """What a side's scan warned about that is no photo limit, as ``kind|place|text``: a retake verdict, quality notes
    and the areas that the automatic check couldn't judge, in this order. warnings, unjudged: maps by check or area."""
    say = lambda kind, e: F.concat(F.lit(f"{side}|{kind}|"), e["key"], F.lit("|"), e["value"])
    retake = F.when(quality == "rescan", F.array(F.lit(f"{side}|retake||"))).otherwise(F.array().cast("array<string>"))
    told = lambda kind, c: F.coalesce(F.transform(F.array_sort(F.map_entries(c)), lambda e: say(kind, e)), F.array().cast("array<string>"))
    return F.concat(retake, told("note", warnings), told("unjudged", unjudged))


# ---------------------------------------------------------------- grades and places


def shown_subgrades(parts: dict[str, Column], conditions: dict[str, Column]) -> Column:
    """A map of subgrades; null for an area whose condition is null, as its value is only a ceiling."""
    items = [x for k, v in parts.items() for x in (F.lit(k), F.when(conditions[k].isNotNull(), v) if k in conditions else v)]
    return F.create_map(*items)


# Where a defect of a component can be.
LOCATIONS = {
    "corners": ("top_left", "top_right", "bottom_left", "bottom_right"),
    "edges": ("top", "bottom", "left", "right"),
    "surface": ("surface",),
}


def allowed_locations(components: Column) -> Column:
    """Locations of the components in their order, whatever the order of the array."""
    return F.flatten(F.array(*[F.when(F.array_contains(components, c), F.array(*map(F.lit, LOCATIONS[c]))).otherwise(F.array().cast("array<string>")) for c in C.COMPONENTS]))


# ---------------------------------------------------------------- evaluation


def blind_answers(key: DataFrame, results: DataFrame) -> DataFrame:
    """Answers to a sealed key: key has round, card, set, company, grade and results round, card, company, grade,
    complete; cards without a result are skipped, and one scheme's flawless 10.5 counts as 10."""
    told = results.select("round", "card", "company", F.col("grade").alias("pred"), "complete")
    pred = F.when(F.col("company") == "TAG", F.least("pred", num(10))).otherwise(F.col("pred"))
    return key.withColumnRenamed("grade", "true").join(told, ["round", "card", "company"]).withColumn("pred", pred)


def blind_summary(answers: DataFrame, group: list[str]) -> DataFrame:
    """Counts and errors, and Spearman's correlation of more than two answers."""
    ranked = E.spearman(answers.where("pred is not null and true is not null"), group, "true", "pred").withColumnRenamed("n", "_n")
    out = E.error_summary(answers, group, "true", "pred").join(ranked, group, "left")
    return out.withColumn("spearman", F.when(F.col("n") > 2, F.col("spearman"))).drop("_n", "median_error", "ceiling_ok")


def blind_listing(answers: DataFrame) -> DataFrame:
    """Every answer, by set, true grade, card and round."""
    return answers.orderBy("set", "true", "card", "round")


# ---------------------------------------------------------------- records and jobs


def record_of(records: DataFrame, key: str, value) -> DataFrame:
    """The record of a key, or none."""
    return records.where(F.col(key) == F.lit(value))


def handled(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """job, result, error of jobs (job, kind, payload): each kind's rows go through its own handler, which gives job and
    result; jobs of a kind without a handler have an error. Handlers are transforms of frames, so a new kind is an entry."""
    known = F.coalesce(F.col("kind").isin(*handlers), F.lit(False)) if handlers else F.lit(False)
    out = jobs.where(~known).select("job", F.lit(None).cast("string").alias("result"), F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit(""))).alias("error"))
    for kind, handler in handlers.items():
        out = out.unionByName(handler(jobs.where(F.col("kind") == kind)).select("job", F.col("result").cast("string").alias("result"), F.lit(None).cast("string").alias("error")))
    return out


# ---------------------------------------------------------------- prices and splits


def found_prices(items: DataFrame, listed: DataFrame) -> DataFrame:
    """item, id, how, name_matches, others: the listed card by id, else by number (and set, where one is typed); among
    several one whose name matches first, then one without brackets in its name, then the smallest id. items: item, id,
    set, number, name; listed: id, set, number, name (one row an id). ``others``: how many more had the number."""
    a = items.withColumns({"_key": number_key(F.col("number")), "_name": plain_any(F.col("name")), "_set": F.upper(F.coalesce("set", F.lit("")))}).select("item", F.col("id").alias("_id"), "_key", "_name", "_set")
    own = listed.withColumns({"_number": number_key(F.col("number")), "_plain": plain_any(F.col("name")), "_bare": plain_any(F.get(F.split("name", r" \("), 0))})
    own = own.select("id", F.col("set").alias("_of"), "_number", "_plain", "_bare", F.coalesce(F.contains("name", F.lit("(")), F.lit(False)).alias("_marked"))
    first = F.get(F.split("_name", " "), 0)
    matches = (F.col("_name") == "") | F.contains("_plain", F.col("_name")) | F.contains("_name", F.col("_bare")) | F.startswith("_plain", first)
    by_id = a.join(own, a["_id"] == own["id"]).select("item", "id", F.lit("id").alias("how"), matches.alias("name_matches"), F.lit(0).cast("bigint").alias("others"))
    rest = a.join(by_id.select("item"), "item", "left_anti").where("_key <> ''").drop("_id")
    # a name is compared once for each number and set, whatever the number of items and cards that bear it
    sold = own.select("*", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("_of", F.lit(""))))).alias("_for")).groupBy("_number", "_for", "_plain", "_bare").agg(F.min(F.struct("_marked", "id")).alias("_least"), F.count(F.lit(1)).alias("_n"))
    asked = rest.select("_key", "_set", "_name").distinct()
    hits = asked.join(sold, (F.col("_key") == F.col("_number")) & (F.col("_set") == F.col("_for")))
    hits = hits.groupBy(F.col("_key").alias("_k"), F.col("_set").alias("_s"), F.col("_name").alias("_m")).agg(F.min(F.struct((~matches).alias("n"), "_least")).alias("b"), F.sum("_n").alias("_n"))
    best = rest.join(hits, (F.col("_key") == F.col("_k")) & (F.col("_set") == F.col("_s")) & F.col("_name").eqNullSafe(F.col("_m")))
    best = best.groupBy("item").agg(F.min("b").alias("b"), (F.sum("_n") - 1).alias("others")).select("item", "b.n", "b._least.id", "others")
    return by_id.unionByName(best.select("item", "id", F.lit("number").alias("how"), (~F.col("n")).alias("name_matches"), "others"))


def split_histogram(records: DataFrame, members: DataFrame) -> DataFrame:
    """split, certs, groups, grades: of each split how many records, card keys, and records of each grade (an array in
    the order of the numbers, null first). records: cert, card_key, grade; members: cert, split."""
    own = records.join(members, "cert")
    per = own.groupBy("split", "grade").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("grade").cast("double"), num(-1)).alias("order"), F.col("grade").cast("string").alias("grade"), "n"))).alias("g"))  # a grade has few values
    sizes = own.groupBy("split").agg(F.count(F.lit(1)).alias("certs"), F.count_distinct("card_key").alias("groups"))
    return sizes.join(per, "split").select("split", "certs", "groups", F.transform("g", lambda x: F.struct(x["grade"].alias("grade"), x["n"].alias("n"))).alias("grades"))


def membership(document: Column) -> Column:
    """cert -> split of a splits document's text; empty where there is none."""
    return F.coalesce(F.from_json(document, "membership map<string,string>")["membership"], F.create_map().cast("map<string,string>"))


def members_of(members: DataFrame, split: str) -> DataFrame:
    """The keys of one split; no members at all are an error, as there are no splits then."""
    if members.limit(1).count() == 0:
        raise ValueError("no splits")
    return members.where(F.col("split") == split).select("cert")


# ---------------------------------------------------------------- catalogs


def extended(data: Column, name: str) -> Column:
    """Value of the first entry of that name in an array of (name, value); empty without one."""
    return F.coalesce(F.get(F.filter(data, lambda e: e["name"] == name), 0)["value"], F.lit(""))


def rift_candidate(card: Column, published: Column) -> Column:
    """The second catalog's card (riftbound_id, name, set, set_id, rarity, image_url, tcgplayer_id, signature,
    alternate_art, overnumbered) as a flat candidate."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        text(card["name"]).alias("name"), rift_number(card["riftbound_id"]).alias("number"), text(card["rarity"]).alias("rarity"), rift_variant(card["signature"], card["alternate_art"], card["overnumbered"]).alias("variant"),
        text(card["set"]).alias("set_name"), F.upper(F.coalesce(card["set_id"], rift_parts(card["riftbound_id"])["set"])).alias("set_code"), year_prefix(published).alias("year"), F.lit("EN").alias("language"),
        text(card["image_url"]).alias("image_url"), text(card["image_url"]).alias("thumb_url"), F.lit(False).alias("image_readable"), text(card["riftbound_id"]).alias("source_id"), text(card["tcgplayer_id"]).alias("tcgplayer_id"),
    )


# ---------------------------------------------------------------- times


def iso_time(text: Column) -> Column:
    """A timestamp of ISO 8601 text with any offset (none: UTC); null for what is none."""
    own = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zoned = F.when(own.rlike(r"[T ]\d{2}.*[+-]\d{2}:?\d{2}$"), own).otherwise(F.concat(own, F.when(own.rlike(r"[T ]\d{2}"), F.lit("+00:00")).otherwise(F.lit("T00:00:00+00:00"))))
    return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(zoned))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes with one decimal (half away from zero); null if either time is missing."""
    tenths = (F.unix_micros(end) - F.unix_micros(start)) / num(6_000_000)
    return F.signum(tenths) * F.floor(F.abs(tenths) + 0.5) / 10


# ---------------------------------------------------------------- perceptual hash

SIZE, LOW = 32, 8


def cosines() -> np.ndarray:
    """The LOW lowest rows of the orthonormal cosine transform of SIZE values."""
    u, i = np.arange(LOW)[:, None], np.arange(SIZE)[None]
    return np.cos(np.pi * (2 * i + 1) * u / (2 * SIZE)) * np.where(u == 0, np.sqrt(1 / SIZE), np.sqrt(2 / SIZE))


def perceptual_hashes(landed: DataFrame, key: str, grey: str) -> DataFrame:
    """key and phash: 64 bits of each landed grey matrix (SIZE x SIZE values by row, as one array): bit 63 - (8 u + v) tells
    whether the low-frequency coefficient (u, v) is above the median of all 64. Null for other sizes and for missing
    values. A batch takes two products with a constant matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = cosines()
        for batch in batches:
            values = batch["grey"]
            ok = values.map(lambda v: v is not None and len(v) == SIZE * SIZE)
            out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
            if ok.any():
                m = np.stack(values[ok].to_list()).astype(np.float64).reshape(-1, SIZE, SIZE)
                low = (d @ m @ d.T).reshape(len(m), -1)
                words = np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1).view(">i8").ravel()
                out[ok] = pd.array([None if np.isnan(x).any() else int(w) for x, w in zip(low, words, strict=True)], dtype="Int64")
            yield pd.DataFrame({"key": batch["key"], "phash": out})

    kind = landed.schema[key].dataType.simpleString()
    return landed.select(F.col(key).alias("key"), F.col(grey).alias("grey")).mapInPandas(run, f"key {kind}, phash bigint").withColumnRenamed("key", key)
