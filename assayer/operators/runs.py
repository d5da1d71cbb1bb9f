"""Runs of marked positions: islands that close small gaps, first run of a length, and stops that follow from them.

A key's rows are cut into ranges of (key, order), which are handled side by side; a row for each range and key carries
its edges (count, first and last mark, whether one run crosses it) to the ranges that follow, so a key of any size needs
no single task. Windows over whole keys see these edge rows only, at most one a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.tables import written

_EARLIER = (Window.unboundedPreceding, -1)


def _ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``_range``, ascending with (key, order); written, as a second evaluation could cut other ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def _edges(ranged: DataFrame, key: str, *sums: Column) -> DataFrame:
    """A row for each range and key, as ``_k`` and ``_r``."""
    return ranged.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(*sums)


def _with(ranged: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return ranged.join(edges, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_k", "_r")


def numbered(df: DataFrame, key: str, order: str, into: str = "pos", size: Column | None = None, before: str = "before") -> DataFrame:
    """``df`` with each row's number in its key, from 1 in the order of ``order`` (without ties); with ``size``, also the
    sum of the sizes before it."""
    ranged = _ranged(df.withColumn("_size", F.lit(0) if size is None else F.coalesce(size, F.lit(0))), key, order)
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(*_EARLIER)
    edges = _edges(ranged, key, F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    edges = edges.select("_k", "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    inner = Window.partitionBy("_range", key).orderBy(order)
    own = F.coalesce(F.sum("_size").over(inner.rowsBetween(*_EARLIER)), F.lit(0))
    out = _with(ranged.withColumn(into, F.row_number().over(inner).cast("bigint")).withColumn("_own", own), edges, key).withColumn(into, F.col(into) + F.col("_n"))
    out = out.withColumn(before, F.col("_own") + F.col("_s")) if size is not None else out
    return out.drop("_own", "_n", "_s", "_size", "_range")


def lagged(df: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """``df`` with the value of ``order`` of the row before in its key; null for the first."""
    ranged = _ranged(df, key, order)
    edges = _edges(ranged, key, F.max(order).alias("_last"))
    edges = edges.select("_k", "_r", F.lag("_last").over(Window.partitionBy("_k").orderBy("_r")).alias("_last"))
    own = F.lag(order).over(Window.partitionBy("_range", key).orderBy(order))
    return _with(ranged.withColumn(into, own), edges, key).withColumn(into, F.coalesce(into, "_last")).drop("_last", "_range")


def marked_runs(df: DataFrame, key: str, pos: str, marked: Column, gap: int = 0, least: int = 1) -> DataFrame:
    """key, start, end, marks: runs of marked positions that lie at most ``gap`` unmarked ones apart, from the first mark
    to the last, of at least ``least`` positions. ``pos`` is a whole number, once in a key."""
    marks = df.where(F.coalesce(marked, F.lit(False)) & F.col(pos).isNotNull()).select(F.col(key).alias("_key"), F.col(pos).cast("bigint").alias("_pos"))
    ranged = _ranged(marks, "_key", "_pos")
    inner = Window.partitionBy("_range", "_key").orderBy("_pos")
    new = F.coalesce(F.col("_pos") - F.lag("_pos").over(inner) > gap + 1, F.lit(False)).cast("int")
    part = ranged.withColumn("_new", new).withColumn("_part", F.sum("_new").over(inner))
    parts = part.groupBy("_key", "_range", "_part").agg(F.min("_pos").alias("start"), F.max("_pos").alias("end"), F.count(F.lit(1)).alias("marks"))
    edges = _edges(ranged.withColumnRenamed("_key", "_e"), "_e", F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
    through = parts.groupBy(F.col("_key").alias("_tk"), F.col("_range").alias("_tr")).agg((F.max("_part") == 0).alias("_one"), F.max("_part").alias("_last_part"))
    edges = edges.join(through, (F.col("_r") == F.col("_tr")) & F.col("_k").eqNullSafe(F.col("_tk"))).drop("_tk", "_tr")
    order = Window.partitionBy("_k").orderBy("_r")
    edges = edges.withColumn("_joined", F.coalesce(F.col("_first") - F.lag("_last").over(order) <= gap + 1, F.lit(False)))
    # where the run that enters a range began: the last earlier range that isn't crossed by it as a whole
    opens = F.when(~(F.col("_joined") & F.col("_one")), F.struct("_r", "_last_part"))
    edges = edges.withColumn("_open", F.max(opens).over(order.rowsBetween(*_EARLIER))).select("_k", "_r", "_joined", "_open")
    both = parts.join(edges, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")))
    root = F.when(F.col("_joined") & (F.col("_part") == 0), F.col("_open")).otherwise(F.struct(F.col("_range").alias("_r"), F.col("_part").alias("_last_part")))
    whole = both.withColumn("_root", root).groupBy("_key", "_root").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("marks").alias("marks"))
    return whole.where(F.col("end") - F.col("start") + 1 >= least).select(F.col("_key").alias(key), "start", "end", "marks")


def first_run(df: DataFrame, key: str, pos: str, marked: Column, length: int) -> DataFrame:
    """key, start: where the first ``length`` marked positions in a row begin."""
    return marked_runs(df, key, pos, marked, 0, length).groupBy(key).agg(F.min("start").alias("start"))


def failure_stop(log: DataFrame, by: str, order: str, failed: Column, limit: int) -> DataFrame:
    """Rows up to the ``limit``-th failure in a row of each agent."""
    rows = written(numbered(log.withColumn("_failed", F.coalesce(failed, F.lit(False))), by, order, "_pos"), "numbered")
    stops = first_run(rows, by, "_pos", F.col("_failed"), limit).select(F.col(by).alias("_by"), (F.col("start") + limit - 1).alias("_stop"))
    return rows.join(stops, F.col(by).eqNullSafe(F.col("_by")), "left").where(F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop"))).select(*log.columns)


def size_stop(log: DataFrame, by: str, order: str, size: str, cap: float) -> DataFrame:
    """Rows until the running size reaches ``cap``; the row that reaches it is the last."""
    return numbered(log, by, order, "_pos", F.col(size), "_before").where(F.col("_before") < cap).select(*log.columns)
