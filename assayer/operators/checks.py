"""Rules on photo checks: measurement thresholds, verdicts, confidence levels and step statuses, as column functions.

Levels are ranks (0 cannot assess, 1 low, 2 medium, 3 high), so "weakest of" is ``least`` and "at most" is ``least`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.grades import num, split_ratio

LEVELS = ("cannot_assess", "low", "medium", "high")
CANNOT, LOW, MEDIUM, HIGH = range(4)
STATUS = {"ok": 0, "warn": 1, "fail": 2}

# Measurement, warning and failure limits; "above": more is worse.
LIMITS = (
    ("sharpness", "above", 0.1092, 0.168), ("glare", "above", 0.01, 0.15), ("resolution", "below", 600.0, 350.0), ("perspective", "above", 0.06, 0.15), ("detection", "below", 0.7, 0.5), ("aspect", "above", 0.04, 0.08),
)
# Length and depth in millimetres from which a mark is of a severity.
SEVERITY_SIZES = (("major", 15.0, 1.0), ("moderate", 5.0, 0.6), ("minor", 1.5, 0.35))
# Border read confidence, and how many of 8 places may be lost.
AXIS_HIGH, AXIS_READ, LOST_MEDIUM, LOST_LOW = 0.6, 0.3, 2, 7


def measured_status(name: str, value: Column) -> Column:
    """ok, warn or fail of a measurement; null measurements fail. Resolution and detection fail strictly below."""
    _, way, warn, fail = next(x for x in LIMITS if x[0] == name)
    over = (lambda limit: value > limit) if way == "above" else (lambda limit: value < limit)
    return F.when(value.isNull() | over(fail), "fail").when(over(warn), "warn").otherwise("ok")


def verdict(*statuses: Column) -> Column:
    """rescan if any check failed, warn if any warned."""
    any_ = lambda s: F.array_contains(F.array(*statuses), s)
    return F.when(any_("fail"), "rescan").when(any_("warn"), "warn").otherwise("ok")


def severity_from_size(length: Column, depth: Column) -> Column:
    out = None
    for name, least_length, least_depth in SEVERITY_SIZES:
        test = (length >= least_length) | (depth >= least_depth)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("micro")


def measured_axis(a: Column, b: Column, confidence_a: Column, confidence_b: Column) -> Column:
    """The share and evidence of an axis; 50 and unread unless both sides were read."""
    read = (confidence_a >= AXIS_READ) & (confidence_b >= AXIS_READ)
    share = F.when(read, F.bround(split_ratio(F.greatest(a, num(0)), F.greatest(b, num(0))), 2)).otherwise(num(50))
    return F.struct(share.alias("share"), F.when(read, "measured").otherwise("unread").alias("evidence"))


def neutral_inset(inset: Column, confidence: Column, opposite: Column, opposite_confidence: Column, size: Column) -> Column:
    """An unread side mirrors the opposite one, or takes 5 % of the size."""
    return F.when(confidence >= AXIS_READ, inset).when(opposite_confidence >= AXIS_READ, opposite).otherwise(size * 0.05)


# ---------------------------------------------------------------- levels


def _at_most(level: Column, test: Column, limit: int) -> Column:
    return F.when(test, F.least(level, F.lit(limit))).otherwise(level)


def outline_level(boundary: Column, detection: Column, perspective: Column, adjusted: Column) -> Column:
    """An outline set by hand overrules the detector's doubt."""
    found = F.when(adjusted, "ok").otherwise(detection)
    level = _at_most(F.lit(HIGH), perspective == "fail", LOW)
    level = _at_most(level, (perspective == "warn") | (boundary == "warn") | (found == "warn"), MEDIUM)
    return F.when((boundary == "fail") | (found == "fail"), CANNOT).otherwise(level)


def centering_level(blocked: Column, axes: list[tuple[Column, Column, Column]]) -> Column:
    """``axes``: evidence and both sides' confidence; only measured axes count."""
    levels = []
    for evidence, a, b in axes:
        c = F.least(F.coalesce(a, num(0)), F.coalesce(b, num(0)))
        levels.append(F.when(evidence == "measured", F.when(c >= AXIS_HIGH, HIGH).when(c >= AXIS_READ, MEDIUM).otherwise(LOW)))
    weakest = F.array_min(F.array(*levels))
    return F.when(F.coalesce(blocked, F.lit(False)), CANNOT).otherwise(F.coalesce(weakest, F.lit(CANNOT)))


def corners_edges_level(resolution: Column, sharpness: Column, lost: Column, sleeve: Column) -> Column:
    """``lost``: places (of 8) that the check couldn't assess, null if it didn't run."""
    level = F.when(lost == 0, HIGH).when(lost <= LOST_MEDIUM, MEDIUM).when(lost <= LOST_LOW, LOW).otherwise(CANNOT)
    level = _at_most(level, (resolution == "warn") | (sharpness == "warn") | F.coalesce(sleeve, F.lit(False)), MEDIUM)
    return F.when((resolution == "fail") | (sharpness == "fail") | lost.isNull(), CANNOT).otherwise(level)


def surface_level(blocked: Column, angled: Column, glare: Column, sharpness: Column, resolution: Column) -> Column:
    soft = (glare == "warn") | (sharpness == "warn") | (resolution == "warn")
    return F.when(F.coalesce(blocked, F.lit(False)), CANNOT).when(~angled, LOW).otherwise(_at_most(F.lit(HIGH), soft, MEDIUM))


def overall(outline: Column, centering: Column, corners_edges: Column, surface: Column, limited: Column, photo_failure: Column) -> Column:
    """Level and rules of one face: the weakest assessed area, lowered where a photo problem hides something."""
    covered = F.filter(F.array(outline, centering, corners_edges), lambda x: x > CANNOT)
    level = F.array_min(covered)
    lost = (corners_edges == CANNOT) & photo_failure & (level > LOW)
    level1 = F.when(lost, LOW).otherwise(level)
    hidden = (surface == CANNOT) & (level1 > LOW)
    level2 = F.when(hidden, LOW).otherwise(level1)
    final = _at_most(level2, limited, MEDIUM)
    rules = F.array(F.lit("R_WEAKEST"), F.when(lost, "R_CE_FAIL"), F.when(hidden, "R_SURFACE_FAIL"), F.when(limited, "R_FLAT"))
    rules = F.filter(rules, lambda r: r.isNotNull())
    nothing = (centering == CANNOT) & (corners_edges == CANNOT)
    return F.struct(
        F.when((outline == CANNOT) | nothing, CANNOT).otherwise(final).alias("level"),
        F.when(outline == CANNOT, F.array(F.lit("R_OUTLINE"))).when(nothing, F.array(F.lit("R_NOTHING"))).otherwise(rules).alias("rules"),
    )


def combined(faces: DataFrame, card: str, face: str, level: str, state: str) -> DataFrame:
    """Both faces of a card: the weaker assessed one, and which are missing or pending; ``state``: assessed, assessing or
    not_scanned."""
    return faces.groupBy(card).agg(
        F.min(F.when(F.col(state) == "assessed", F.col(level))).alias("level"),
        F.array_sort(F.collect_list(F.when(F.col(state) == "not_scanned", F.col(face)))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col(state) == "assessing", F.col(face)))).alias("pending"),
    )


def level_name(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), level)


# ---------------------------------------------------------------- steps of a check run


def scan_status(verdicts: list[Column], blocked: Column) -> Column:
    """fail if a photo failed, warn if fewer than 8 of 16 places can be assessed."""
    return F.when(F.array_contains(F.array(*verdicts), "fail"), "fail").when(16 - blocked < 8, "warn").otherwise("pass")


def centering_status(differences: Column, unread: Column) -> Column:
    """By the worst absolute difference to the report; unread axes or faces warn. Null if nothing was compared."""
    worst = F.coalesce(F.array_max(F.transform(differences, F.abs)), num(0))
    out = F.when(worst > 6, "fail").when((worst > 3) | unread, "warn").otherwise("pass")
    return F.when((F.size(differences) > 0) | unread, out)


def identify_status(first_ok: Column, listed: Column, other_printing: Column) -> Column:
    return F.when(first_ok, "pass").when(listed | other_printing, "warn").otherwise("fail")


def grade_status(mine: Column, true: Column, assessable: Column) -> Column:
    """A best case below the true grade fails; useless or far above warns."""
    return F.when(mine < true, "fail").when((assessable == 0) | (mine - true > 1), "warn").otherwise("pass")


def run_status(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "fail"), "fail").when(F.array_contains(statuses, "warn"), "warn").otherwise("pass")


def limit_reasons(blocked: Column, component: str, angled: Column) -> Column:
    """Distinct reasons of the blocked items of a component (``item`` or ``item:place``), in order; ``blocked``: a map."""
    own = F.filter(F.map_entries(blocked), lambda e: (e["key"] == component) | F.startswith(e["key"], F.lit(component + ":")))
    found = F.array_distinct(F.flatten(F.transform(own, lambda e: e["value"])))
    if component != "surface":
        return found
    return F.when(angled.eqNullSafe(F.lit(False)), F.array_distinct(F.concat(F.array(F.lit("not seen under angled light")), found))).otherwise(found)


def unassessed_places(edges: Column, corners: Column) -> Column:
    """Map of the places an automatic check couldn't judge to its reasons; both are arrays of place, ok, reason."""
    part = lambda c, kind: F.transform(F.filter(c, lambda x: ~x["ok"]), lambda x: F.struct(F.concat(F.replace(x["place"], F.lit("_"), F.lit("-")), F.lit(f" {kind}")).alias("key"), x["reason"].alias("value")))
    return F.map_from_entries(F.concat(part(edges, "edge"), part(corners, "corner")))


def pending_flags(flags: DataFrame, added: DataFrame, dismissed: DataFrame, item: str) -> DataFrame:
    """Flags that were neither added (at any severity) nor dismissed (at this severity); none counts as confirmed."""
    place = [item, "side", "location", "type"]
    left = flags.join(added.select(*place).distinct(), place, "left_anti").join(dismissed.select(*place, "severity").distinct(), [*place, "severity"], "left_anti")
    return left.withColumn("confirmed", F.lit(False))


def defect_list_errors(defects: Column, kinds: dict[str, tuple[str, ...]], component) -> Column:
    """Numbered errors of a list of defects: unknown types and places a type doesn't allow."""
    allowed = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def one(d: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        where = F.try_element_at(allowed, d["type"])
        return F.when(where.isNull(), F.concat(F.lit("defect #"), number, F.lit(": unknown type"))).when(~F.coalesce(F.array_contains(where, component(d["location"])), F.lit(False)), F.concat(F.lit("defect #"), number, F.lit(": location not allowed")))

    return F.filter(F.transform(defects, one), lambda x: x.isNotNull())


def location_component(location: Column) -> Column:
    return F.when(location.isin("top_left", "top_right", "bottom_left", "bottom_right"), "corners").when(location.isin("top", "bottom", "left", "right"), "edges").when(location == "surface", "surface")
