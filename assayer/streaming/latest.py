"""Streaming twins of the stateful behaviours: latest per key, deduplication with a time to live, gap monitoring,
bursts, late results and paced slots. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayer.functions.tables import hadoop_path, written


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Event time with a watermark; timestamps without zone have to be cast first."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# ---------------------------------------------------------------- latest wins


def latest(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Batch: the newest row of each key, by partial maxima, so that a key of any size meets in one row a task."""
    return events.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*events.columns), F.struct(ts, tie)).alias("_m")).select("_m.*")


class Latest(StatefulProcessor):
    """Keeps the newest (ts, id) of a key; emits a row whenever it is replaced. Older arrivals change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "ts long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        changed = False
        for df in rows:
            for ts, i in zip(df["micros"].tolist(), df["id"].tolist(), strict=True):
                if best is None or (ts, i) > tuple(best):
                    best, changed = (int(ts), int(i)), True
        if changed:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "micros": [best[0]], "id": [best[1]]})

    def close(self) -> None:
        pass


def latest_stream(events: DataFrame, key: str, ts: str, id_: str) -> DataFrame:
    """Streaming, update mode: key, micros, id of every replacement; the last one of a key is the batch result."""
    rows = events.select(F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(id_).cast("bigint").alias("id"))
    return rows.groupBy("key").transformWithStateInPandas(Latest(), "key long, micros long, id long", "update", "none")


def latest_by_aggregate(events: DataFrame, key: str, ts: str, id_: str) -> DataFrame:
    """The same as a built-in streaming aggregation (complete or update mode), with no Python."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(id_))).alias("_m")).select(key, F.col(f"_m.{ts}").alias(ts), F.col(f"_m.{id_}").alias(id_))


# ---------------------------------------------------------------- time to live


def ttl_dedup(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Batch: a row is kept if no row of its key was kept within ``seconds`` before it; rows without a time are left
    out. The chain of kept rows is a sequential recurrence, so a key is one task's work, but its rows stream through in
    order: only the time of the last kept row is held, and rows between two kept ones are skipped by binary search."""
    rows = events.where(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_tie", F.xxhash64(*events.columns))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy("_us", "_tie")) == 1)
    columns, ttl = events.columns, seconds * 1_000_000

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            us, first = batch["_us"].to_numpy(), batch["_first"].to_numpy(zero_copy_only=False)
            keep = np.zeros(len(us), bool)
            for a, b in pairwise(np.unique(np.concatenate([[0], np.flatnonzero(first), [len(us)]])).tolist()):
                own = us[a:b]
                last = None if first[a] else last
                i = 0 if last is None else int(np.searchsorted(own, last + ttl))
                while i < len(own):
                    keep[a + i], last = True, int(own[i])
                    i = max(i + 1, int(np.searchsorted(own, last + ttl)))
            yield batch.filter(pa.array(keep)).select(columns)

    return rows.drop("_tie").mapInArrow(kept, events.schema)


def ttl_dedup_stream(events: DataFrame, key: list[str], ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Streaming: one row of a key within the watermark's delay; state is dropped with the watermark."""
    return timed(events, ts, ttl).dropDuplicatesWithinWatermark(key)


# ---------------------------------------------------------------- paced slots


def paced_slots(requests: DataFrame, lane: str, ts: str, spacing_ms: int, tie: str | None = None) -> DataFrame:
    """Start time of each request if starts of a lane lie at least ``spacing_ms`` apart, in order of arrival: by ``ts``, then
    by ``tie`` (by a hash of the row if it isn't given or equal too); requests without a time come last.
    start_i = max(t_i, start_(i-1) + s) = i*s + max over j <= i of (t_j - j*s): a running count and a running maximum, no
    recurrence. Both are taken inside ranges of (lane, time); a row a range and lane carries them on to later ranges."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_tie", F.xxhash64(*requests.columns))
    arrival = [F.asc_nulls_last("_us"), *([tie] if tie else []), "_tie"]
    # written once: a second evaluation could cut other ranges
    ranged = written(rows.repartitionByRange(n, lane, *arrival).withColumn("_range", F.spark_partition_id()), "lanes")
    step = F.lit(spacing_ms * 1000).cast("bigint")
    inner = Window.partitionBy("_range", lane).orderBy(*arrival)
    own = ranged.withColumn("_i", F.row_number().over(inner).cast("bigint")).withColumn("_d", F.col("_us") - F.col("_i") * step)
    own = own.withColumn("_most", F.max("_d").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("_lane").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(F.col("_range").alias("_part"), F.col(lane).alias("_lane")).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_top"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ends = ends.withColumn("_best", F.max(F.col("_top") - F.col("_before") * step).over(earlier))
    placed = own.join(ends, (F.col("_range") == F.col("_part")) & F.col(lane).eqNullSafe(F.col("_lane")))
    start = F.greatest(F.col("_most") - F.col("_before") * step, "_best") + (F.col("_before") + F.col("_i")) * step
    return placed.select(*requests.columns, start.alias("start_us"))


# ---------------------------------------------------------------- bursts, gaps, late results


def bursts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Session windows: events of a key less than ``gap`` apart; works on batch and stream."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")) if not events.isStreaming else timed(events, ts)
    return own.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def hourly(events: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows (an extension), append mode on a stream."""
    own = timed(events, ts, delay) if events.isStreaming else events.withColumn(ts, F.col(ts).cast("timestamp"))
    return own.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), by, "n", "total")


def in_time(requests: DataFrame, results: DataFrame, key: str, revision: str) -> DataFrame:
    """Results whose revision is still the newest one requested; late ones drop out."""
    newest = requests.groupBy(key).agg(F.max(revision).alias(revision))
    return results.join(newest, [key, revision], "left_semi")


def merged(batch: DataFrame, epoch: int, path: str, key: str, order: str) -> None:
    """foreachBatch: merge a micro-batch into the table at ``path``; the newest row of a key stays, the table's on a tie. A
    batch that comes again changes nothing. Only a table that isn't there counts as empty: one that can't be read fails
    the batch, to be tried again. The new table is written beside the old one, and takes its place when it is whole; an
    interrupted swap is finished by the next batch."""
    spark = batch.sparkSession
    own, fs = hadoop_path(spark, path)
    old, _ = hadoop_path(spark, f"{path}.old")
    new, _ = hadoop_path(spark, f"{path}.new")
    if fs.exists(old) and not fs.exists(own):
        fs.rename(old, own)
    fs.delete(old, True)
    fs.delete(new, True)
    rows = batch.withColumn("_new", F.lit(1))
    if fs.exists(own):
        rows = spark.read.parquet(path).withColumn("_new", F.lit(0)).unionByName(rows)
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), "_new")
    rows.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p", "_new").write.parquet(f"{path}.new")
    if fs.exists(own) and not fs.rename(own, old):
        raise RuntimeError(f"cannot move {path}")
    if not fs.rename(new, own):
        raise RuntimeError(f"cannot move {path}.new")
    fs.delete(old, True)
