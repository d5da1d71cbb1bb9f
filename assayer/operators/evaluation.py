"""Evaluation analytics: ranks, rank correlation, AUC, recall at a false-positive rate, bootstrap, error summaries.

Rank statistics need running totals over all values of a group. They are computed over per-value counts with a
distributed prefix sum: counts are range-partitioned by (group, value), each range sums its own rows, and the few totals
of the ranges give every range its offset. No group is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.tables import written


def running_before(counts: DataFrame, group: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (one row for each group and value) with ``<sum>_before``: the group's total over smaller values."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a second evaluation could cut other ranges
    ranged = written(counts.repartitionByRange(n, *group, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_range", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_own_{s}": F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums})
    totals = ranged.groupBy("_range", *group).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    outer = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *group, *[F.coalesce(F.sum(f"_sum_{s}").over(outer), F.lit(0)).alias(f"_off_{s}") for s in sums])
    there = offsets.select(F.col("_range").alias("_part"), *[F.col(g).alias(f"_of_{g}") for g in group], *[f"_off_{s}" for s in sums])
    out = own.join(there, reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_of_{g}")), group, F.col("_range") == F.col("_part")))
    return out.select(*counts.columns, *[(F.col(f"_own_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums])


def average_ranks(df: DataFrame, group: list[str], value: str, into: str = "rank") -> DataFrame:
    """``df`` with the average rank (ties share the mean of their places) of ``value`` in its group."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    places = running_before(counts, group, value, ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    return df.join(places.select(*group, value, rank.cast("double").alias(into)), [*group, value])


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; NaN without variance."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = n * F.sum(x * y) - sx * sy
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when(vx * vy <= 0, F.lit(float("nan"))).otherwise(F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))))


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(df, group, a, "_ra"), group, b, "_rb")
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_ra"), F.col("_rb")).alias("spearman"))


def _class_counts(df: DataFrame, group: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    one = F.lit(1) if weight is None else weight
    return df.groupBy(*group, score).agg(F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).alias("neg"))


def auc_of_counts(counts: DataFrame, group: list[str], score: str) -> DataFrame:
    placed = running_before(counts, group, score, ["neg"])
    p, n = F.sum("pos"), F.sum("neg")
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return placed.groupBy(*group).agg(p.alias("positive"), n.alias("clean"), F.try_divide(won, (p * n).cast("double")).alias("auc"))


def auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with ties counting half; null if a class is empty."""
    return auc_of_counts(_class_counts(df, group, score, label), group, score)


def recall_at_fpr(df: DataFrame, group: list[str], score: str, label: str, fpr: float = 0.10) -> DataFrame:
    """Recall at the lowest threshold (0 or a value) above which at most ``fpr`` of the negatives lie."""
    counts = _class_counts(df, group, score, label)
    zero = counts.select(*group).distinct().select(*group, F.lit(0).cast(df.schema[score].dataType).alias(score), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    counts = counts.unionByName(zero).groupBy(*group, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    placed = running_before(counts, group, score, ["pos", "neg"])
    totals = counts.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = placed.join(totals, group).withColumns({"fp": F.col("n") - F.col("neg_before") - F.col("neg"), "tp": F.col("p") - F.col("pos_before") - F.col("pos")})
    ok = F.try_divide(F.col("fp").cast("double"), F.col("n").cast("double")) <= fpr
    out = above.groupBy(*group).agg(F.min_by(F.col("tp"), F.when(ok, F.col(score))).alias("tp"), F.max("p").alias("p"), F.max("n").alias("n"))
    return out.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double"))).alias("recall"))


def error_summary(df: DataFrame, group: list[str], true: str, pred: str) -> DataFrame:
    """n, exact, within 0.5, within 1, mean absolute error, bias, median error, ceilings kept."""
    e = F.col(pred) - F.col(true)
    return df.where(e.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(e) < 0.01).alias("exact"), F.count_if(F.abs(e) <= 0.5).alias("within_05"), F.count_if(F.abs(e) <= 1.0).alias("within_1"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.median(e).alias("median_error"), F.count_if(F.col(pred) >= F.col(true)).alias("ceiling_ok"),
    )


def repeat_agreement(df: DataFrame, group: list[str], item: str, pred: str) -> DataFrame:
    """Items answered more than once: how many identically, and the mean spread."""
    per = df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n"), (F.max(pred) - F.min(pred)).alias("spread")).where("n > 1")
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("spread") < 0.01).alias("identical"), F.avg("spread").alias("mean_spread"))


#: Smallest 32-bit value, in hex, at which a Poisson(1) draw is at least 1, 2, ...; beyond 12 nothing is left of 32 bits.
POISSON = [f"{round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))):08x}" for k in range(12)]


def poisson_weight(replicate: Column, unit: Column) -> Column:
    """How often a unit is drawn: Poisson(1) from a hash, as in a resample with replacement of very many units."""
    h = F.substring(F.md5(F.concat_ws("/", replicate.cast("string"), unit.cast("string"))), 1, 8)
    return reduce(lambda a, x: a + x, [(h >= t).cast("int") for t in POISSON])


#: Units of a bootstrap whose pairs are counted at once.
FEW_UNITS = 100


def wins(df: DataFrame, unit: str, score: str, label: str) -> DataFrame:
    """u, v, won: how often a positive of unit u scores above a negative of unit v, ties counting half. AUC of any
    weighting of units is a bilinear form of this matrix, so resamples need no second look at the rows."""
    per = df.groupBy(F.col(unit).alias("v"), F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    per = written(per, "counts")
    units = [r["v"] for r in per.select("v").distinct().limit(FEW_UNITS).collect()]
    grid = per.select("s").distinct().withColumn("v", F.explode(F.array(*map(F.lit, units))))
    placed = running_before(grid.join(per.select("v", "s", "neg"), ["v", "s"], "left").select("v", "s", F.coalesce("neg", F.lit(0)).alias("neg")), ["v"], "s", ["neg"])
    pos = per.where("pos > 0").select(F.col("v").alias("u"), "s", "pos")
    return pos.join(placed, "s").groupBy("u", "v").agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("won"))


def bootstrap_auc_difference(df: DataFrame, unit: str, label: str, a: str, b: str, replicates: int = 2000, weight: Callable[[Column, Column], Column] = poisson_weight) -> DataFrame:
    """Percentile interval of AUC(b) - AUC(a), resampling whole units; replicates are drawn by hash, not by a random
    generator. Up to FEW_UNITS units go through the matrix of ``wins``: a replicate costs the square of the units, whatever
    the rows. More units are counted per replicate. Both are exact."""
    units = df.select(unit).distinct()
    drawn = units.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>"))).withColumn("w", weight(F.col("replicate"), F.col(unit))).where("w > 0")
    few = len(units.limit(FEW_UNITS + 1).collect()) <= FEW_UNITS

    def by_rows(score: str, into: str) -> DataFrame:
        counts = df.groupBy(unit, score, label).agg(F.count(F.lit(1)).alias("c")).join(drawn, unit)
        counts = _class_counts(counts, ["replicate"], score, label, F.col("w") * F.col("c"))
        return auc_of_counts(counts, ["replicate"], score).where("auc is not null").select("replicate", F.col("auc").alias(into))

    def by_wins(score: str, into: str) -> DataFrame:
        side = lambda name: drawn.select("replicate", F.col(unit).alias(name), F.col("w").alias(f"w_{name}"))
        won = wins(df, unit, score, label).join(side("u"), "u").join(side("v"), ["replicate", "v"]).groupBy("replicate").agg(F.sum(F.col("w_u") * F.col("w_v") * F.col("won")).alias("won"))
        sizes = df.groupBy(unit).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).join(drawn, unit)
        sizes = sizes.groupBy("replicate").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * (F.col("n") - F.col("p"))).alias("q")).where("p > 0 and q > 0")
        return sizes.join(won, "replicate", "left").select("replicate", (F.coalesce("won", F.lit(0.0)) / (F.col("p") * F.col("q")).cast("double")).alias(into))

    one = by_wins if few else by_rows
    diffs = one(a, "x").join(one(b, "y"), "replicate").agg(F.array_sort(F.collect_list(F.col("y") - F.col("x"))).alias("d"))  # one value a replicate
    at = lambda share, back: F.get("d", (F.floor(F.size("d") * F.lit(share)) - back).cast("int"))
    return diffs.select(F.size("d").alias("replicates"), at(0.025, 0).alias("low"), at(0.975, 1).alias("high"))


def axis_summary(df: DataFrame, group: list[str], error: str) -> DataFrame:
    """By side and axis: how many were read, of how many, mean absolute error, how many lie within 2."""
    e = F.abs(F.col(error))
    return df.groupBy(*group).agg(F.count(error).alias("read"), F.count(F.lit(1)).alias("of"), F.round(F.avg(e), 2).alias("mae"), F.count_if(e <= 2).alias("within_2"))


def defect_summary(df: DataFrame, listed: str, matched: str, extra: str, flags: str) -> DataFrame:
    """Listed, matched and extra defects, and the flags on cards that list none."""
    clean = F.col(listed) == 0
    return df.agg(F.sum(listed).alias("listed"), F.sum(matched).alias("matched"), F.sum(extra).alias("extra_flags"), F.sum(F.when(clean, F.col(flags)).otherwise(0)).alias("extra_on_clean_cards"), F.count_if(clean).alias("clean_cards"))


def paired(rows: DataFrame, key: list[str], arm: str, a: str, b: str, score: str, able: str) -> DataFrame:
    """Areas that both arms could assess, with both scores."""
    one = lambda name, into: rows.where((F.col(arm) == name) & F.col(able)).select(*key, F.col(score).alias(into))
    return one(a, "a").join(one(b, "b"), key)


def paired_stats(df: DataFrame, group: list[str], label: str, a: str = "a", b: str = "b") -> DataFrame:
    """Sizes, AUC and recall at a tenth of false positives of either arm."""
    out = df.groupBy(*group).agg(F.count(F.lit(1)).alias("areas"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) != 1).alias("clean"))
    for name, score in (("a", a), ("b", b)):
        out = out.join(auc(df, group, score, label).select(*group, F.col("auc").alias(f"auc_{name}")), group)
        out = out.join(recall_at_fpr(df, group, score, label).select(*group, F.col("recall").alias(f"recall10_{name}")), group)
    return out
