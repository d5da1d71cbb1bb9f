"""Identified cards and explained grades: game inference, catalog candidates, order and cut of lists, what a grade says.

All are column functions or one window over a key with a bounded list; nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.grades import format_g
from assayer.functions.reading import SECOND_GAME_SETS, number_parts, text_or_empty
from assayer.functions.text import collector_number, loose_text

# How many candidates get details, and how many are listed.
ENRICHED, LISTED = 12, 8
# Labels of a catalog card's variants, in order of display.
VARIANTS = {"normal": "Normal", "reverse": "Reverse holo", "holo": "Holo", "firstEdition": "1st edition", "wPromo": "W promo"}
# Image types and sizes that a reference may have.
IMAGE_TYPES, MAX_BYTES = ("image/png", "image/jpeg", "image/webp"), 25 * 1024 * 1024
# Points from which an area needs no mention, and the share that an unread side counts as.
STRONG_POINTS, UNREAD_SHARE = 990, 55

# ---------------------------------------------------------------- identification


def game_of(game: Column, set_code: Column, number: Column) -> Column:
    """The game as typed, else by the set's code or the number's form."""
    g = F.lower(F.trim(text_or_empty(game)))
    second = F.upper(text_or_empty(set_code)).isin(*SECOND_GAME_SETS) | text_or_empty(number).rlike("(?i)^SP[0-9]")
    return F.when(F.startswith(g, F.lit("pok")), "pokemon").when(F.startswith(g, F.lit("rift")), "riftbound").when(second, "riftbound").otherwise("pokemon")


# Set ids that may lack the zero before a single digit; letters behind a number; numbers that have a total.
ONE_DIGIT_SET, LETTERS_BEHIND, TOTALLED = r"^(sv|me)(\d)(?=$|\.)", "[a-z*]+$", "^(sp|[0-9])"


def set_guesses(code: Column) -> Column:
    """Spellings of a set's id to try: as typed, lower-cased, with a zero before a single digit."""
    raw = F.trim(text_or_empty(code))
    return F.array_distinct(F.array(raw, F.lower(raw), F.regexp_replace(F.lower(raw), ONE_DIGIT_SET, "$10$2")))


def resolved_sets(wanted: DataFrame, sets: DataFrame, code: str = "code", most: int = 4) -> DataFrame:
    """code, set_id, via of the sets that a code names: by any spelling of the id, else by the exact abbreviation, unless
    more than ``most`` sets contain it. ``sets``: set_id, abbreviation."""
    each = wanted.select(code, F.explode(set_guesses(F.col(code))).alias("set_id"))
    by_id = each.join(sets.select("set_id"), "set_id").select(code, "set_id", F.lit("id").alias("via")).distinct()
    # substrings of abbreviations are few: a set table has some hundred rows, every substring of which is a key
    parts = sets.where("abbreviation is not null").withColumn("_u", F.upper("abbreviation"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_u")), lambda i: F.transform(F.sequence(F.lit(1), F.length("_u") - i + 1), lambda n: F.substring(F.col("_u"), i, n))))
    broad = parts.select("set_id", "_u", F.explode(F.array_distinct(spans)).alias("_part")).where("_part <> ''")
    left = wanted.select(code).distinct().join(by_id.select(code).distinct(), code, "left_anti").withColumn("_part", F.upper(F.trim(F.col(code))))
    hits = left.join(broad, "_part").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(code)))
    return by_id.unionByName(hits.where((F.col("_n") <= most) & (F.col("_u") == F.col("_part"))).select(code, "set_id", F.lit("abbreviation").alias("via")))


def catalog_variant(flags: Column) -> Column:
    """Labels of the true flags of a struct, in order of display."""
    return F.array_join(F.filter(F.array(*[F.when(flags[k], F.lit(v)) for k, v in VARIANTS.items()]), lambda x: x.isNotNull()), " / ")


def catalog_candidate(card: Column) -> Column:
    """A catalog's card (id, localId, name, rarity, image, variants, set, release) as a flat candidate."""
    image = card["image"]
    return F.struct(
        text_or_empty(card["name"]).alias("name"), text_or_empty(card["localId"]).alias("number"), text_or_empty(card["rarity"]).alias("rarity"), catalog_variant(card["variants"]).alias("variant"),
        text_or_empty(card["set"]).alias("set_name"), year_prefix(card["release"]).alias("year"),
        F.coalesce(F.concat(image, F.lit("/high.png")), F.lit("")).alias("image_url"), F.coalesce(F.concat(image, F.lit("/low.webp")), F.lit("")).alias("thumb_url"), image.isNotNull().alias("image_readable"),
        text_or_empty(card["id"]).alias("source_id"),
    )


def year_prefix(c: Column) -> Column:
    """The year that a date starts with; null for none or 0."""
    return F.nullif(F.regexp_extract(text_or_empty(c), "^([0-9]{1,4})", 1).try_cast("int"), F.lit(0))


def rift_parts(id_: Column) -> Column:
    """``ven-sp3-006`` -> set ven, num sp3, total 006."""
    p = F.split(F.lower(text_or_empty(id_)), "-")
    return F.struct(*[text_or_empty(F.get(p, i)).alias(n) for i, n in enumerate(("set", "num", "total"))])


def rift_number(id_: Column) -> Column:
    """The number as shown: with the total where the number is one that has one."""
    p = rift_parts(id_)
    return F.when((p["total"] != "") & p["num"].rlike(TOTALLED), F.upper(F.concat(p["num"], F.lit("/"), p["total"]))).otherwise(F.upper(p["num"]))


def rift_number_matches(id_: Column, number: Column) -> Column:
    """Digits match as numbers, without the letters behind; others match as written."""
    num, wanted = rift_parts(id_)["num"], number_parts(number)
    bare = F.regexp_replace(num, LETTERS_BEHIND, "")
    return F.when(wanted["left_int"].isNotNull(), bare.rlike("^[0-9]+$") & F.coalesce(bare.try_cast("int") == wanted["left_int"], F.lit(False))).otherwise(num == F.lower(wanted["left"]))


def rift_variant(signature: Column, alternate: Column, over: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(signature), "Signature").when(yes(alternate), "Alternate Art").when(yes(over), "Overnumbered").otherwise("Standard")


def exact_total_first(hits: DataFrame, item: str, total: str, wanted: str, order: str, most: int = ENRICHED) -> DataFrame:
    """The first ``most`` hits of an item, those whose set has the printed total before others."""
    w = Window.partitionBy(item).orderBy((~F.col(total).eqNullSafe(F.col(wanted))).cast("int"), order)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def listed(candidates: DataFrame, item: str, score: str, tie: str, most: int = LISTED) -> DataFrame:
    """The ``most`` best candidates of an item, with how many there were and how many are not shown."""
    # only the first ones of each task are sorted together, and the count is an aggregation
    top = candidates.withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy(F.col(score).desc(), tie))).where(F.col("place") <= most)
    totals = candidates.groupBy(F.col(item).alias("_item")).agg(F.count(F.lit(1)).alias("total_matches"))
    out = top.join(totals, F.col(item).eqNullSafe(F.col("_item"))).drop("_item")
    return out.withColumn("not_shown", F.greatest(F.lit(0), F.col("total_matches") - most))


def dedupe_listed_twice(cards: DataFrame, id_: str, price_id: str, order: str) -> DataFrame:
    """One row of a card that is listed twice: the first, unless only a later one has the other shop's id."""
    w = Window.partitionBy(id_).orderBy((F.coalesce(F.col(price_id), F.lit("")) == "").cast("int"), order)
    return cards.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


# Forms of addresses and of keys.
INLINE_IMAGE, ADDRESS = "(?i)^data:image/(png|jpeg|webp);base64,", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+"
SECURE, LOGIN = "(?i)^https://", "(?i)^https://[^/?#]*@"
KEY_FORMS = (("prices", "^[0-9a-fA-F]{40}$"), ("model", r"^\S{30,120}$"), ("catalog", r"^\S{20,200}$"))


def _first(problems: list[tuple[str, Column]]) -> Column:
    """The name of the first problem that a thing has; null without one."""
    return F.coalesce(*[F.when(has, F.lit(name)) for name, has in problems])


def reference_problem(kind: Column, size: Column, url: Column) -> Column:
    """Why a reference image can't be taken; null if it can. A file (kind, size) goes before an address."""
    raw = F.trim(text_or_empty(url))
    inline = raw.rlike(INLINE_IMAGE)
    of_file = [("type", ~F.lower(text_or_empty(kind)).isin(*IMAGE_TYPES)), ("empty", size.isNull() | (size <= 0)), ("too large", size > MAX_BYTES)]
    of_address = [("missing", raw == ""), ("too large", inline & (F.length(raw) > MAX_BYTES * 1.4)), ("address", ~inline & ~raw.rlike(ADDRESS)), ("https", ~inline & ~raw.rlike(SECURE)), ("login", raw.rlike(LOGIN))]
    return F.when(kind.isNotNull() | size.isNotNull(), _first(of_file)).otherwise(_first(of_address))


def key_kind(c: Column) -> Column:
    """Which services a key's form fits: forty hexadecimal digits, 30 to 120 characters, 20 to 200."""
    return F.array_compact(F.array(*[F.when(c.rlike(form), F.lit(name)) for name, form in KEY_FORMS]))


def name_matches(name: Column, names: Column) -> Column:
    """Is the normalised name equal to one of the names, in one, or one in it? Unicode forms need Python."""

    def fits(a: str, others: list) -> bool:
        return bool(a) and any(b and (a in b or b in a) for b in map(loose_text, others))

    @F.pandas_udf("boolean")
    def run(own: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([fits(loose_text(n), [] if xs is None else list(xs)) for n, xs in zip(own, others, strict=True)], dtype=bool)

    return run(name, names)


def number_matches(number: Column, expected: Column) -> Column:
    """Equal left parts without leading zeros; null if nothing is expected."""
    return F.when(text_or_empty(expected) != "", collector_number(number) == collector_number(expected))


# ---------------------------------------------------------------- explanations


def shown_grade(value: Column, flawless: float) -> Column:
    return F.when(value >= flawless, "10 (Pristine)").otherwise(format_g(value))


def binding_factors(overall: Column, parts: Column, flawless: float, slack: float = 0.0) -> Column:
    """What holds a grade where it is: of an array of (name, value, detail) those not above it, weakest first."""
    low = F.filter(F.transform(parts, lambda p, i: F.struct(p["value"].alias("value"), i.alias("i"), p["name"].alias("name"), p["detail"].alias("detail"))), lambda p: p["value"] <= overall + slack)
    text = lambda p: F.concat(F.initcap(p["name"]), F.lit(" "), shown_grade(p["value"], flawless), F.when(text_or_empty(p["detail"]) == "", "").otherwise(F.concat(F.lit(": "), p["detail"])))
    return F.transform(F.array_sort(low), text)


def weakest_areas(areas: Column, most: int = 3) -> Column:
    """The ``most`` weakest of an array of (name, points, detail), up to the first strong one."""
    ordered = F.slice(F.array_sort(F.transform(areas, lambda a, i: F.struct(a["points"].alias("points"), i.alias("i"), a["name"].alias("name"), a["detail"].alias("detail")))), 1, most)
    weak = F.filter(ordered, lambda a: a["points"] < STRONG_POINTS)
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1000)))
    return F.transform(weak, lambda a: F.concat(capital(a["name"]), F.lit(" "), F.bround(a["points"], 0).cast("int").cast("string"), F.lit(" pts"), F.when(text_or_empty(a["detail"]) == "", "").otherwise(F.concat(F.lit(": "), a["detail"]))))


def unread_note(unread: Column) -> Column:
    """The note (a fixed text) about centering that wasn't measured, of an array of sides and axes; null if all were."""
    share = f"{UNREAD_SHARE}/{100 - UNREAD_SHARE}"
    text = F.concat(F.lit("Centering wasn't measured ("), F.array_join(unread, ", "), F.lit(f"), so it counts as {share}, just making Gem Mint. That's this lab's convention, not a grading company's rule."))
    return F.when(F.size(unread) > 0, text)


def defect_text(severity: Column, label: Column, side: Column, component: Column, location: Column) -> Column:
    place = F.when(location == "surface", F.concat(side, F.lit(" surface"))).otherwise(F.concat(side, F.lit(" "), F.translate(location, "_", " "), F.when(component == "corners", " corner").otherwise(" edge")))
    return F.concat(severity, F.lit(" "), F.lower(label), F.lit(" ("), place, F.lit(")"))


def with_caps(defects: DataFrame, rules: DataFrame, company: str | None = None) -> DataFrame:
    """``defects`` (type, severity) with their cap by data-driven rules (type, severity, company, cap; company null for
    the rule of all): a company's own cap goes before it. Rules are read anew with each call, so edited ones count."""
    base = rules.where("company is null").select("type", "severity", F.col("cap").alias("_base"))
    own = rules.where(F.upper("company") == (company or "").upper()).select("type", "severity", F.col("cap").alias("_own"))
    return defects.join(base, ["type", "severity"], "left").join(own, ["type", "severity"], "left").withColumn("cap", F.coalesce("_own", "_base")).drop("_own", "_base")


def legacy_defects(defects: Column) -> Column:
    """Of a saved card's defects those that weren't left unconfirmed; a missing flag counts as confirmed."""
    return F.filter(F.coalesce(defects, F.array().cast("array<struct<type:string,confirmed:boolean>>")), lambda d: F.coalesce(d["confirmed"], F.lit(True)))


def legacy_evidence(evidence: Column, sides: tuple[str, ...] = ("front", "back"), axes: tuple[str, ...] = ("lr", "tb")) -> Column:
    """A saved card's evidence by ``side_axis``, ``typed`` where it has none."""
    return F.struct(*[F.coalesce(F.try_element_at(evidence, F.lit(f"{s}_{a}")), F.lit("typed")).alias(f"{s}_{a}") for s in sides for a in axes])


# ---------------------------------------------------------------- lookups and jobs


def first_answer(tries: DataFrame, item: str, order: str, key: str, found: Column) -> DataFrame:
    """The first query of an item that has candidates; repeated queries of an item are asked once."""
    asked = tries.groupBy(item, key).agg(F.min(F.struct(order, found.alias("_f"))).alias("_m")).select(item, key, f"_m.{order}", "_m._f")
    return asked.where("_f").groupBy(item).agg(F.min(F.struct(order, key)).alias("_m")).select(item, f"_m.{order}", f"_m.{key}")


def asked_once(requests: DataFrame, session: str, key: str, order: str) -> DataFrame:
    """Each request of a session once, at its first time, with how often it was answered from memory."""
    return requests.groupBy(session, key).agg(F.min(order).alias(order), (F.count(F.lit(1)) - 1).alias("from_memory"))


def timed_out(jobs: DataFrame, kind: str, started: str, ended: str, limits: dict[str, float]) -> DataFrame:
    """``jobs`` with when each ended and whether it was stopped: a job ends by itself or at its kind's limit in seconds."""
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, int(v * 1_000_000))]), F.col(kind))
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in (started, ended))
    stopped = end.isNull() | (end - start > limit)
    return jobs.withColumns({"ended_us": F.when(stopped, start + limit).otherwise(end), "stopped": stopped})
