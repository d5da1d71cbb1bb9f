"""Sinks: canonical JSON Lines, star-schema views, delimited exports, guarded replacement."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.records import cache_status


def sorted_struct(df: DataFrame) -> Column:
    """All columns as one struct with fields in alphabetical order and maps in order of their keys, at every level."""

    def ordered(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            out = F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
            return F.when(c.isNotNull(), out)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        if isinstance(t, T.MapType):
            entries = F.array_sort(F.map_keys(c))
            return F.map_from_arrays(entries, F.transform(entries, lambda k: ordered(F.try_element_at(c, k), t.valueType)))
        return c

    return F.struct(*[ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def canonical_lines(df: DataFrame, key: str) -> DataFrame:
    """key and line: compact JSON with sorted fields, nulls kept, so that equal records give equal bytes."""
    return df.select(F.col(key).alias("key"), F.to_json(sorted_struct(df), {"ignoreNullFields": "false"}).alias("line"))


def write_canonical(df: DataFrame, key: str, path: str) -> None:
    """Sorted by key over all part files, in order of their names."""
    canonical_lines(df, key).orderBy("key").select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Named columns with a header; nulls are empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


# How the rows of the three trackers are ordered.
TRACKERS = {"agent_cards": ("agent", "company", "true_grade"), "agent_steps": ("agent", "id", "step_order"), "tag_reports": ("tag_grade",)}


def write_trackers(frames: dict[str, DataFrame], path: str) -> None:
    """The trackers as delimited files below ``path``, in their order; one without rows is left as it was."""
    for name, order in TRACKERS.items():
        if name in frames and frames[name].limit(1).count():
            write_csv(frames[name].orderBy(*order), f"{path}/{name}", frames[name].columns)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Replace the table only if there is something to write."""
    if not df.limit(1).count():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def without_key(df: DataFrame, key: str, value) -> DataFrame:
    """The table after deleting a key."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def export(df: DataFrame, app: str, version: int) -> DataFrame:
    """A backup document; one per partition, so the driver never holds the cards."""
    return df.select(F.to_json(F.struct(F.lit(app).alias("app"), F.lit(version).alias("version"), F.struct(*df.columns).alias("card"))).alias("value"))


# Columns of the delimited view of certs, in order.
CSV_COLUMNS = ("cert", "card", "set", "year", "language", "grade", "score", "split", "centering_front", "centering_back", "corner_dings", "edge_dings", "surface_dings", "ding_list", "image_cache")


def star_views(records: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """certs, dings, images, splits and the delimited view ``csv`` of canonical records; ``members``: cert, split. The
    defects of an area are null where neither side was counted."""

    def counted(area: str):
        front, back = F.col(f"tag.dings.{area}.front"), F.col(f"tag.dings.{area}.back")
        return F.when(front.isNotNull() | back.isNotNull(), F.coalesce(front, F.lit(0)) + F.coalesce(back, F.lit(0)))

    flag = lambda c: F.col(c).cast("int")
    certs = records.join(members, "cert", "left").select(
        "cert", "pool", "split", "card_key", F.col("card.name").alias("card_name"), F.col("card.set").alias("card_set"), "card.year", "card.language", "card.variant", "tag.grade", "tag.grade_label", "tag.score",
        F.col("tag.centering.front").alias("centering_front"), F.col("tag.centering.back").alias("centering_back"),
        counted("corners").alias("corner_dings"), counted("edges").alias("edge_dings"), counted("surface").alias("surface_dings"), "tag.graded_on",
        "source.report_url", "source.fetched_at", "source.agent", "report_txt_sha256", "parser_version", F.array_join("report_changed_on_refetch", ",").alias("report_changed_on_refetch"),
        flag("cache.present").alias("cache_present"), flag("cache.hash_ok").alias("cache_hash_ok"), cache_status(F.col("cache.present"), F.col("cache.hash_ok")).alias("image_cache"),
        F.array_join(F.transform("tag.ding_list", lambda d: F.concat(d["side"], F.lit(" "), d["location"], F.lit(": "), d["type"])), "; ").alias("ding_list"),
    )
    dings = records.select("cert", F.posexplode("tag.ding_list").alias("idx", "d")).select("cert", "idx", "d.side", "d.location", "d.type")
    images = records.select("cert", "source.image_urls", F.explode("images").alias("side", "i"))
    images = images.select("cert", "side", *[f"i.{c}" for c in ("sha256", "width", "height", "bytes", "phash", "path")], F.try_element_at("image_urls", F.col("side")).alias("url"))
    delimited = certs.withColumnsRenamed({"card_name": "card", "card_set": "set"}).withColumn("split", F.coalesce("split", F.lit(""))).select(*CSV_COLUMNS)
    return {"certs": certs.drop("ding_list"), "dings": dings, "images": images, "splits": members.join(records.select("cert", "card_key"), "cert", "left"), "csv": delimited}


def eval_config(members: DataFrame, code: dict[str, str], options: dict, split: str, allow_test: bool = False) -> str:
    """A record of one evaluation: digests of code and keys, options; the sealed split needs permission."""
    if split == "test" and not allow_test:
        raise PermissionError("the test split is sealed")
    digest = members.where(F.col("split") == split).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.col("cert"), 256))), ","), 256).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return json.dumps({"code": code, "options": options, "split": split, "certs": digest["n"], "certs_sha256": digest["d"]}, sort_keys=True, separators=(",", ":"))
