"""Sales statistics, versions, price ladder and price-list validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.grades import first_row, num
from assayer.functions.text import same_site
from assayer.operators.evaluation import running_before

# Price keys by lowest grade, best first.
GRADE_KEYS = ((9.5, "box-only-price"), (9, "graded-price"), (8, "new-price"), (7, "cib-price"), (6, "condition-16-price"), (5, "condition-15-price"), (4, "condition-14-price"), (3, "condition-13-price"), (2, "condition-10-price"), (1, "condition-9-price"))
# Price keys of a 10, by company; the second one for the higher label.
TEN_KEYS = {"PSA": ("manual-only-price", "manual-only-price"), "BGS": ("bgs-10-price", "condition-20-price"), "CGC": ("condition-17-price", "condition-19-price"), "TAG": ("condition-21-price", "condition-21-price")}
# The whole ladder, from the lowest rung; labels and price keys.
LADDER = (
    ("Ungraded", "loose-price"), ("Grade 1", "condition-9-price"), ("Grade 2", "condition-10-price"), ("Grade 3", "condition-13-price"), ("Grade 4", "condition-14-price"), ("Grade 5", "condition-15-price"),
    ("Grade 6", "condition-16-price"), ("Grade 7 / 7.5", "cib-price"), ("Grade 8 / 8.5", "new-price"), ("Grade 9", "graded-price"), ("Grade 9.5", "box-only-price"), ("PSA 10", "manual-only-price"),
    ("BGS 10 (Pristine)", "bgs-10-price"), ("BGS 10 Black Label", "condition-20-price"), ("CGC 10 (Gem Mint)", "condition-17-price"), ("CGC Pristine 10", "condition-19-price"), ("TAG 10", "condition-21-price"),
    ("SGC 10", "condition-18-price"), ("ACE 10", "condition-22-price"),
)
# Sites whose prices are not taken.
BLOCKED = ("pricecharting.com",)


def sales_stats(sales: DataFrame, by: list[str], price: str, when: str, tie: list[str], fixed: Column) -> DataFrame:
    """count, median, low, high and the latest price of the sales that are no fixed-price listings. The median is exact:
    the mean of the prices in the two middle places, found by running counts over the distinct prices of a group, so that
    no group's prices are held in one task."""
    ok = sales.where(~fixed & (F.col(price) > 0))
    last = F.max(F.struct(when, *tie, price))
    counts = ok.groupBy(*by, price).agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
    groups = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(price).alias("low"), F.max(price).alias("high"), F.max("_last").alias("_last"))
    groups = groups.withColumn("last", F.col("_last")[price]).drop("_last")
    totals = groups.select(F.col("n").alias("_total"), *[F.col(g).alias(f"_of_{g}") for g in by])
    placed = running_before(counts.drop("_last"), by, price, ["_n"])
    placed = placed.join(totals, reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_of_{g}")), by, F.lit(True)))
    # places count from 0; the middle ones are the same if the count is odd
    at = lambda place: (F.col("_n_before") <= place) & (F.col("_n_before") + F.col("_n") > place)
    halves = [F.max(F.when(at(F.expr(place)), F.col(price))).cast("double") for place in ("(_total - 1) div 2", "_total div 2")]
    medians = placed.groupBy(*[f"_of_{g}" for g in by]).agg(((halves[0] + halves[1]) / 2).alias("median"))
    out = groups.join(medians, reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_of_{g}")), by, F.lit(True)))
    return out.select(*by, "n", "median", "low", "high", "last")


def versions(sales: DataFrame, by: str, version: str) -> DataFrame:
    """Versions of each item that have sales, the base version (null) first even without sales."""
    base = sales.select(by).distinct().select(by, F.lit(None).cast(sales.schema[version].dataType).alias(version), F.lit(0).cast("bigint").alias("n"))
    counted = sales.groupBy(by, version).agg(F.count(F.lit(1)).alias("n"))
    both = counted.unionByName(base).groupBy(by, version).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(by).orderBy(F.col(version).isNotNull(), version)
    return both.select(by, version, "n", F.row_number().over(w).alias("place"))


def price_key(company: Column, grade: Column, label: Column, tier: Column) -> Column:
    """Which price stands for a grade; null if the item gets no number."""
    upper = F.lower(label).contains("black label") | ((company != "BGS") & F.lower(label).contains("pristine"))
    tens = first_row(((company == c, F.when(upper, high).otherwise(low)) for c, (low, high) in TEN_KEYS.items()), F.lit(None).cast("string"))
    steps = first_row(((grade >= g, F.lit(k)) for g, k in GRADE_KEYS), F.lit(None).cast("string"))
    return F.when((F.coalesce(tier, F.lit(0)) >= 99) | ~(grade >= 1), F.lit(None).cast("string")).when((grade >= 10) & company.isin(*TEN_KEYS), tens).otherwise(steps)


def nested_prices(products: DataFrame, prices: DataFrame, key: str, kind: str, price: str) -> DataFrame:
    """Products with a map of their prices by kind, empty for those without."""
    maps = prices.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, price)))).alias("prices"))
    empty = F.map_from_entries(F.array().cast(f"array<struct<k:{prices.schema[kind].dataType.simpleString()},v:{prices.schema[price].dataType.simpleString()}>>"))
    return products.join(maps, key, "left").withColumn("prices", F.coalesce("prices", empty))


def checked_prices(rows: DataFrame, price: str, grade: str, source: str, site: Column, wanted: list[str]) -> DataFrame:
    """``rows`` with ``why``: null if kept, else why dropped; tests in this order."""
    blocked = F.lit(False)
    for b in BLOCKED:
        blocked = blocked | same_site(site, F.lit(b))
    p = F.col(price)
    why = F.when(p.isNull() | F.isnan(p) | (p <= 0) | (p >= 1e7), "price").when(~F.coalesce(F.col(grade).isin(*wanted), F.lit(False)), "grade").when(F.coalesce(F.trim(source), F.lit("")) == "", "source").when(blocked, "blocked source")
    return rows.withColumn("why", why)


def top_listed(prices: DataFrame, by: str, market: str, mid: str, tie: str, k: int) -> DataFrame:
    """The k dearest rows of each item by market price, the middle one where that is missing or 0."""
    worth = F.coalesce(F.nullif(F.col(market), num(0)), F.col(mid), num(0))
    w = Window.partitionBy(by).orderBy(worth.desc(), tie)
    return prices.withColumn("worth", worth).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def full_ladder(products: DataFrame, key: str, prices: str) -> DataFrame:
    """All rungs of each product with their price, null without one; ``prices``: map of price key to price."""
    rungs = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(label).alias("label"), F.lit(k).alias("price_key")) for i, (label, k) in enumerate(LADDER)])
    return products.select(key, prices, F.explode(rungs).alias("_r")).select(key, "_r.*", F.try_element_at(F.col(prices), F.col("_r.price_key")).alias("price"))


def wanted_grades(grades: Column) -> Column:
    """Grades to ask prices for, of an array of (company, grade, label, tier): ungraded, each company at its grade, and
    two points of reference; each once, in this order."""

    def asked(g: Column) -> Column:
        label = F.lower(F.coalesce(g["label"], F.lit("")))
        value = F.when(g["grade"] == F.floor(g["grade"]), g["grade"].cast("int").cast("string")).otherwise(F.format_number(g["grade"], 1))
        black, pristine = (g["company"] == "BGS") & F.contains(label, F.lit("black label")), g["company"].isin("CGC", "TAG") & (g["grade"] >= 10) & F.contains(label, F.lit("pristine"))
        name = F.when(black, "BGS 10 Black Label").when(pristine, F.concat(g["company"], F.lit(" Pristine 10"))).otherwise(F.concat_ws(" ", g["company"], value))
        return F.when((F.coalesce(g["tier"], F.lit(0)) < 99) & (g["grade"] >= 1), name)

    return F.array_distinct(F.concat(F.array(F.lit("Ungraded")), F.filter(F.transform(grades, asked), lambda x: x.isNotNull()), F.array(F.lit("PSA 10"), F.lit("PSA 9"))))


def response_fields(body: Column) -> Column:
    """Text, source addresses and queries of a search-grounded model answer, given as JSON."""
    schema = "candidates array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>,webSearchQueries:array<string>>>>"
    first = F.get(F.from_json(body, f"struct<{schema.replace('candidates array', 'candidates:array', 1)}>")["candidates"], 0)
    meta = first["groundingMetadata"]
    none = F.array().cast("array<string>")
    sources = F.filter(F.coalesce(F.transform(meta["groundingChunks"], lambda c: c["web"]["uri"]), none), lambda u: F.coalesce(u, F.lit("")) != "")
    text = F.array_join(F.coalesce(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), none), "")
    return F.struct(text.alias("text"), sources.alias("sources"), F.coalesce(meta["webSearchQueries"], none).alias("queries"), (F.size(sources) > 0).alias("grounded"), F.coalesce(first["finishReason"], F.lit("")).alias("finish"))
