"""Column functions of the scoring engine. Rule tables are array literals, so no lookup needs a join or a shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def floor_to(grades: Iterable[float], value: Column) -> Column:
    """The largest allowed grade not above ``value`` (with 1e-9 slack), else the smallest."""
    grades = sorted(map(float, grades))
    if all((g * 2).is_integer() for g in grades):  # a table by half grades: the value is computed once, nothing is searched
        low, high = int(grades[0] * 2), int(grades[-1] * 2)
        steps = F.array(*[num(max(g for g in grades if g * 2 <= h)) for h in range(low, high + 1)])
        inside = F.greatest(num(grades[0]), F.least(F.coalesce(value, num(grades[0])), num(grades[-1])))
        return F.get(steps, (F.floor((inside + 1e-9) * 2) - low).cast("int"))
    return F.coalesce(F.array_max(F.filter(F.array(*map(num, grades)), lambda g: g <= value + 1e-9)), num(grades[0]))


def as_of(steps: Iterable[tuple[float, float]], value: Column) -> Column:
    """Value of the step with the largest key not above ``value``, else of the first."""
    steps = sorted(steps)
    return reduce(lambda rest, s: F.when(value + 1e-9 >= s[0], num(s[1])).otherwise(rest), steps[1:], num(steps[0][1]))


def first_row(rows: Iterable[tuple[Column, Column]], last: Column) -> Column:
    """Result of the first row whose condition holds, else ``last``."""
    rows = list(rows)
    out = F.when(*rows[0])
    for test, value in rows[1:]:
        out = out.when(test, value)
    return out.otherwise(last)


def centering_grade(rows: Iterable[tuple], front_worst: Column, front_best: Column, back_worst: Column, tolerance: float) -> Column:
    """The best centering row that both sides pass."""
    rows = list(rows)

    def passes(front, other, back) -> Column:
        ok = (front_worst <= front + tolerance) & (back_worst <= back + tolerance)
        return ok if other is None else ok & (front_best <= other + tolerance)

    return first_row(((passes(*r[1:]), num(r[0])) for r in rows), num(rows[-1][0]))


def interpolate(points: Iterable[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear between ascending points, constant outside."""
    points = [(float(a), float(b)) for a, b in points]
    out = F.when(x <= points[0][0], num(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, num(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(num(points[-1][1]))


def band(bands: Iterable[tuple], score: Column, field: int) -> Column:
    """A field of the first band whose lowest score is reached, else of the last."""
    bands = list(bands)
    value = lambda b: F.lit(b[field]) if isinstance(b[field], str) else num(b[field])
    return first_row(((score >= b[0], value(b)) for b in bands), value(bands[-1]))


def split_ratio(a: Column, b: Column) -> Column:
    """The larger share of a border pair in per cent; 50 without a border."""
    return F.when(a + b <= 0, num(50)).otherwise(F.try_divide(F.greatest(a, b), a + b) * 100)


def label_of(labels: Iterable[tuple[float, str]], grade: Column) -> Column:
    return first_row(((grade == g, F.lit(s)) for g, s in labels), F.lit(None).cast("string"))


def place_of(labels: Iterable[tuple[float, str]], grade: Column, first: int = 0) -> Column:
    """Position of a grade in a scheme, best first."""
    return first_row(((grade == g, F.lit(i + first)) for i, (g, _) in enumerate(labels)), F.lit(None).cast("int"))


def format_g(value: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def half_up(x: Column, digits: int) -> Column:
    """Half-up rounding toward positive infinity, the same arithmetic in every engine."""
    k = 10.0**digits
    return F.floor(x * k + 0.5).cast("double") / k
