"""Small statistics as columns and aggregates: percentiles, deviations, fitted lines, densest windows, the error function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational approximation 7.1.26 in Abramowitz and Stegun.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_STEP = 0.3275911


def erf(x: Column) -> Column:
    """The error function to about 1.5e-7."""
    t = 1 / (1 + F.abs(x) * ERF_STEP)
    tail = F.lit(0.0)
    for c in reversed(ERF):
        tail = (tail + c) * t
    return F.signum(x) * (1 - tail * F.exp(-x * x))


def percentile_of(values: Column, p: float) -> Column:
    """Linear interpolation between the sorted values of an array; null for an empty one."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * (p / 100)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.when(F.size(s) > 0, low + (high - low) * (at - F.floor(at)))


def median_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of each group, and the median absolute deviation from it."""
    middle = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(middle, by).groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def upper_middle(values: Column) -> Column:
    """The middle value, the upper one of an even number."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def _fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = a x + b of each group; null with under two points or without spread."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    den = n * F.sum(F.col(x) * F.col(x)) - sx * sx
    a = (n * F.sum(F.col(x) * F.col(y)) - sx * sy) / den
    return df.groupBy(*by).agg(F.when((n >= 2) & (F.abs(den) >= 1e-9), F.struct(a.alias("a"), ((sy - a * sx) / n).alias("b"))).alias("line"))


def fitted_line(df: DataFrame, by: list[str], x: str, y: str, least: float = 1.0, rounds: int = 2) -> DataFrame:
    """a, b of each group, refitted ``rounds`` times to the points within ``least`` or two and a half median residuals; a
    refit that has no line keeps the last one. Each round is one grouping with a join back, all groups at once."""
    line = _fit(df, by, x, y)
    for _ in range(rounds):
        away = df.join(line, by).where("line is not null").withColumn("_r", F.abs(F.col(y) - (F.col("line.a") * F.col(x) + F.col("line.b"))))
        limit = away.groupBy(*by).agg(F.greatest(F.lit(least), 2.5 * F.median("_r")).alias("_limit"))
        near = _fit(away.join(limit, by).where("_r <= _limit"), by, x, y).withColumnRenamed("line", "_next")
        line = line.join(near, by, "left").select(*by, F.coalesce("_next", "line").alias("line"))
    return line.select(*by, "line.a", "line.b")


def densest_window(df: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """The window [low, low + width] with the most values, the first of equally full ones: low, n, of (all values)."""
    keys = ", ".join(f"`{c}`" for c in by)
    window = f"over (partition by {keys} order by double(`{value}`) range between {float(width)!r}D preceding and current row)"
    per = df.select(*by, value, F.expr(f"count(1) {window}").alias("_n"), F.expr(f"min(`{value}`) {window}").alias("_low"))
    return per.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("_low")).alias("_before"))).alias("_m"), F.count(F.lit(1)).alias("of")).select(*by, (-F.col("_m._before")).alias("low"), F.col("_m._n").alias("n"), "of")
