"""Incremental builds: only records whose inputs or rules changed are computed again, and only the partitions that hold
them are written.

The store is a Parquet table partitioned by a hash of the key, with the digest of each record's inputs and the version of
what computed it. Sources come in tiers: an input that is missing (its cache was evicted) or failed keeps the stored
record, as does one whose digest and version are the stored ones. Finding out reads keys, digests and versions alone;
computing reads the changed inputs; writing reads the touched partitions. Dynamic partition overwrite makes the touched
partitions visible in one commit, others aren't opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.tables import hadoop_path, written


def digest_of(*columns: str) -> Column:
    """A digest of columns as canonical JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store as it is, or None before the first build. Only a store that isn't there counts as none."""
    own, fs = hadoop_path(spark, path)
    return spark.read.parquet(path) if fs.exists(own) else None


def changes(inputs: DataFrame, store: DataFrame | None, excluded: DataFrame | None, key: str, version: str) -> DataFrame:
    """key and what to do: ``new`` or ``changed`` (compute), ``drop`` (an excluded record goes). Everything else stays.
    inputs: key, digest (null: evicted), failed."""
    own = inputs.where("digest is not null and not coalesce(failed, false)").select(key, F.col("digest").alias("_now"))
    gone = None if excluded is None else excluded.select(key).distinct()
    if store is None:
        out = own.select(key, F.lit("new").alias("change"))
        return out if gone is None else out.join(gone, key, "left_anti")
    had = store.select(key, F.col("digest").alias("_had"), F.col("version").alias("_version"))
    both = own.join(had, key, "left")
    out = both.where(F.col("_had").isNull() | (F.col("_had") != F.col("_now")) | (F.col("_version") != version))
    out = out.select(key, F.when(F.col("_had").isNull(), "new").otherwise("changed").alias("change"))
    if gone is None:
        return out
    return out.join(gone, key, "left_anti").unionByName(had.join(gone, key, "left_semi").select(key, F.lit("drop").alias("change")))


def rebuild(inputs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str, version: str, excluded: DataFrame | None = None, parts: int = 64) -> dict[str, int]:
    """Bring the store at ``path`` up to date and tell how many records were new, changed and dropped and how many
    partitions were written. ``inputs``: key (once each), digest, failed and what ``compute`` needs; ``compute`` gives one
    row per key. ``version`` names rules and code: another one computes everything that has a usable input."""
    spark = inputs.sparkSession
    store = stored(spark, path)
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    todo = written(changes(inputs, store, excluded, key, version).withColumn("part", part), "changes")
    counts = {r["change"]: r["n"] for r in todo.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    touched = todo.select("part").distinct()
    told = {"new": counts.get("new", 0), "changed": counts.get("changed", 0), "dropped": counts.get("drop", 0), "partitions": touched.count()}
    if not told["partitions"]:
        return told
    chosen = inputs.join(todo.where("change <> 'drop'").select(key), key, "left_semi")
    made = compute(chosen).join(chosen.select(key, "digest"), key).withColumn("version", F.lit(version)).withColumn("part", part)
    if store is not None:
        # the parts are few and known, so the scan opens no others
        kept = store.where(F.col("part").isin([r["part"] for r in touched.collect()])).join(todo.select(key), key, "left_anti")
        made = made.unionByName(kept, allowMissingColumns=True)
    fresh = written(made, "fresh")  # the store can't be read and written at once
    fresh.repartition(F.col("part")).write.mode("overwrite" if store is not None else "errorifexists").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    if store is not None and counts.get("drop"):  # dynamic overwrite leaves partitions that became empty
        for r in touched.join(fresh.select("part").distinct(), "part", "left_anti").collect():
            own, fs = hadoop_path(spark, f"{path}/part={r['part']}")
            fs.delete(own, True)
    return told


def regraded(cards: DataFrame, path: str, grade: Callable[[DataFrame], DataFrame], key: str, content: list[str], rules: str, parts: int = 64) -> DataFrame:
    """Grades of saved cards through a cache: cards with an unknown content or graded under other rules are graded, the
    others' grades are the stored ones; grades of cards that are no longer saved stay out of the answer."""
    rebuild(cards.withColumn("digest", digest_of(*content)).withColumn("failed", F.lit(False)), path, grade, key, rules, parts=parts)
    return cards.select(key).join(cards.sparkSession.read.parquet(path).drop("digest", "version", "part"), key)
