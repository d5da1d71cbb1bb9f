"""Report pages' text to a record, as column expressions: trimmed lines, marks found by their place, and the list of
defects by one pattern over its lines. A text of any length is one row's array of lines; nothing goes to Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import composed, in_steps

#: Headings and marks of a report page.
SCORE, VIEW, LANGUAGE = "TAG SCORE", "VIEW SCORE", "EN"
AREAS = ("CORNERS", "EDGES", "CENTERING", "SURFACE")
COUNTED = ("CORNERS", "EDGES", "SURFACE")
LIST_START, LIST_SKIP, GRADED = "Snapshot Of Defects", "VIEW", "GRADED "
CENTERING, DINGS = "centering", r"(\d+)\s*DINGS?"
#: White space by Unicode, and a defect's lines: a place alone, ``centering`` and its detail, or a place and a type.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ENTRY = r"(?i)\G(?:(?:front|back)\b[^\n/]*\ncentering\n(?:[^\n]*\n)?|(?:front|back)\b[^\n]*\n(?!(?:front|back)\b)[^\n]*\n)"


def lines_of(text: Column) -> Column:
    """Lines without white space at either end, of which some is left."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE))), "")


def ding_list(lines: Column) -> Column:
    """Defects after the list's heading: a place and a type; a place alone with ``centering`` has its detail on a third
    line. The first line that fits nothing ends the list."""
    return composed({"lines": lines}, (_list_start, _list_entries, _list))["ding_list"]


def _list_start(f: dict[str, Column]) -> dict[str, Column]:
    return {"start": F.array_position(F.transform(f["lines"], lambda x: x.startswith(LIST_START)), True).cast("int")}


def _list_entries(f: dict[str, Column]) -> dict[str, Column]:
    """Each defect's two or three lines as one text: matches that follow each other without a gap, from the list's start."""
    start = f["start"]
    items = F.when(start > 0, F.array_remove(F.slice(f["lines"], start + 1, F.size(f["lines"])), LIST_SKIP)).otherwise(F.array().cast("array<string>"))
    return {"entries": F.regexp_extract_all(F.concat(F.array_join(items, "\n"), F.lit("\n")), F.lit(ENTRY), F.lit(0))}


def _list(f: dict[str, Column]) -> dict[str, Column]:
    def ding(e: Column) -> Column:
        """A centering at the very end has no detail."""
        place, kind, detail = F.get(e, 0), F.lower(F.get(e, 1)), F.get(e, 2)
        alone = ~F.contains(place, F.lit("/")) & (kind == CENTERING)
        where = F.translate(F.lower(F.coalesce(F.get(F.split(place, "/", -1), 1), F.lit(""))), " \t\n\x0b\f\r", "")
        side = F.lower(F.trim(F.substring_index(place, "/", 1)))
        return F.struct(side.alias("side"), F.when(alone, "card").otherwise(where).alias("location"), F.when(alone, F.concat(F.lit("centering "), detail)).otherwise(kind).alias("type"))

    return {"ding_list": F.transform(F.transform(f["entries"], lambda e: F.split(e, "\n", -1)), ding)}


def _marks(f: dict[str, Column]) -> dict[str, Column]:
    """The places of the marks, and the lines from each area's heading on (null without one)."""
    lines, first = f["lines"], lambda mark: F.array_position(f["lines"], mark).cast("int")
    rest = {a: F.when(first(a) > 0, F.slice(lines, first(a), F.size(lines))) for a in AREAS}
    return {"score_at": first(SCORE), "view_at": first(VIEW), **rest}


def _before(f: dict[str, Column]) -> dict[str, Column]:
    """The mark, the lines before it, from the last one back, and each area's lines after ``F:`` and ``B:``."""
    mark = F.when(f["score_at"] > 1, f["score_at"]).when(f["view_at"] > 1, f["view_at"])
    after = lambda rest, side: F.try_element_at(rest, F.nullif(F.array_position(rest, side).cast("int"), F.lit(0)) + 1)
    sides = {f"{a}_{side}": after(f[a], f"{side[0].upper()}:") for a in AREAS for side in ("front", "back")}
    return {"mark": mark, "back": F.reverse(F.slice(f["lines"], F.lit(1), mark - 1)), **sides}


def _head(f: dict[str, Column]) -> dict[str, Column]:
    """The lines between the last language and the mark, from the last one back."""
    back, language = f["back"], F.array_position(f["back"], LANGUAGE).cast("int")
    return {"head": F.coalesce(F.when(language > 0, F.slice(back, F.lit(1), language - 1)).otherwise(back), F.array().cast("array<string>"))}


def _named(f: dict[str, Column]) -> dict[str, Column]:
    """The heading's lines in their order, without a score or its mark at the end."""
    last = F.get(f["head"], F.lit(0))
    scored = (f["score_at"] > 1) & last.rlike("^[0-9]+$")
    drop = F.coalesce((f["score_at"] > 1) & (scored | (last == VIEW)), F.lit(False))
    return {"scored": scored, "named": F.reverse(F.when(drop, F.slice(f["head"], F.lit(2), F.size(f["head"]))).otherwise(f["head"]))}


def _record(f: dict[str, Column]) -> dict[str, Column]:
    """The struct of ``report_record``."""
    lines, mark, named = f["lines"], f["mark"], f["named"]
    at = lambda i: F.coalesce(F.get(named, F.lit(i)), F.lit(""))
    area = lambda a: F.when(f[a].isNotNull(), F.struct(f[f"{a}_front"].alias("front"), f[f"{a}_back"].alias("back"))).alias(a.lower())
    count = lambda a, side: F.regexp_extract(f[f"{a}_{side}"], DINGS, 1).try_cast("int").alias(side)
    dings = F.struct(*[F.struct(count(a, "front"), count(a, "back")).alias(a.lower()) for a in COUNTED])
    dated = F.get(F.filter(lines, lambda x: x.startswith(GRADED)), 0)
    record = F.struct(
        at(0).alias("card_name"), at(1).alias("year_line"), at(2).alias("set_line"), F.coalesce(F.array_join(F.slice(named, F.lit(4), F.size(named)), " "), F.lit("")).alias("variant"),
        F.when(f["scored"], F.get(f["head"], F.lit(0)).try_cast("int")).alias("score"), F.get(lines, mark).try_cast("double").alias("grade"), F.coalesce(F.get(lines, mark + 1), F.lit("")).alias("grade_label"),
        *[area(a) for a in AREAS], dings.alias("dings"), f["ding_list"].alias("ding_list"), F.coalesce(F.substring(dated, len(GRADED) + 1, 1 << 30), F.lit("")).alias("graded_on"),
    )
    return {"record": record}


_STEPS = (_marks, _list_start, _before, _list_entries, _head, _list, _named, _record)


def report_record(lines: Column) -> Column:
    """A struct of heading, grade, areas, counts, list of defects and date. ``lines`` are ``lines_of`` a text, best as a
    column of their own. Missing parts are empty texts or nulls."""
    return composed({"lines": lines}, _STEPS)["record"]


def report_records(pages: DataFrame, lines: Column) -> DataFrame:
    """``pages`` and ``report_record(lines)`` as the column ``record``, each part of it evaluated once a page."""
    return in_steps(pages, {"lines": lines}, _STEPS, "record")
