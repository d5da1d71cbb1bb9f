"""File sources: JSON Lines, whole-file JSON, token lists, exclusion lists, event logs, folder discovery, pages, backups.

All go through Spark's readers, so any file system Spark knows will do, and explicit schemas avoid an inference pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of record folders and list entries.
KEY = r"^[A-Z0-9]{6,12}$"

DEFECT = "struct<side:string,location:string,type:string,severity:string,note:string,confirmed:boolean>"
ASSESSMENT = (
    "id string, card struct<game:string,name:string,subtitle:string,set_name:string,set_code:string,number:string,rarity:string,card_type:string,finish:string,language:string,year:string,holo:boolean,notes:string>, "
    "centering struct<front:struct<lr:double,tb:double>,back:struct<lr:double,tb:double>>, centering_evidence map<string,map<string,string>>, "
    f"defects array<{DEFECT}>, inspected map<string,array<string>>, photo_limits map<string,array<string>>, inspected_in_hand map<string,array<string>>"
)
REPORT = (
    "cert string, score int, card_name string, year_line string, set_line string, variant string, grade double, grade_label string, corners struct<front:string,back:string>, edges struct<front:string,back:string>, "
    "centering struct<front:string,back:string>, surface struct<front:string,back:string>, dings map<string,struct<front:int,back:int>>, ding_list array<struct<side:string,location:string,type:string>>, "
    "graded_on string, source_url string, fetched_at string, agent string"
)


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones kept in ``_corrupt_record``."""
    return spark.read.option("mode", "PERMISSIVE").schema(ddl + ", _corrupt_record string").json(path)


def json_file(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(ddl).json(path)


def token_list(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated tokens of all files that match."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("key")).where("key <> ''")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """``KEY reason`` a line; # starts a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.regexp_extract("line", r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace("line", r"^\S+", "")).alias("reason"))


def folders(spark: SparkSession, path: str, pattern: str = KEY) -> DataFrame:
    """Record folders below ``path``, by name: key, file count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    return files.select(F.get(parts, F.size(parts) - 2).alias("key")).where(F.col("key").rlike(pattern)).groupBy("key").agg(F.count(F.lit(1)).alias("files"))


def pools(lists: list[DataFrame], found: DataFrame, excluded: DataFrame) -> DataFrame:
    """Keys of all lists and folders, without the excluded."""
    out = found.select("key")
    for one in lists:
        out = out.union(one.select("key"))
    return out.distinct().join(excluded.select("key"), "key", "left_anti")


def in_two_pools(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in both pools: an integrity failure if there are any."""
    return a.select("key").intersect(b.select("key"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, agent and url separated by tabs; lines without a timestamp are skipped."""
    raw = spark.read.option("sep", "\t").schema("at string, agent string, url string").csv(path)
    return raw.withColumn("ts", F.try_to_timestamp("at")).where("ts is not null").drop("at")


def pages(spark: SparkSession, path: str, item_ddl: str) -> DataFrame:
    """All items of landed result pages."""
    return spark.read.option("multiLine", True).schema(f"items array<struct<{item_ddl}>>, total bigint, page int, size int, pages int").json(path).select(F.explode("items").alias("x")).select("x.*")


def backup(spark: SparkSession, path: str, card_ddl: str) -> DataFrame:
    """Saved cards of a backup file: a bare array or an object with ``cards``."""
    one = f"struct<{card_ddl}>"
    text = spark.read.option("wholetext", True).text(path)
    cards = F.coalesce(F.from_json("value", f"cards array<{one}>")["cards"], F.from_json("value", T._parse_datatype_string(f"array<{one}>")))
    return text.select(F.explode(cards).alias("x")).select("x.*")


def overlay(base: DataFrame, again: DataFrame, key: list[str], always: list[str], step: str, status: str, rank: dict[str, int]) -> DataFrame:
    """Re-run steps over first results: named steps are always replaced, others only by a stricter status."""
    order = F.create_map(*[F.lit(x) for p in rank.items() for x in p])
    both = base.join(again.select(*key, F.col(status).alias("_again")), key, "left")
    stricter = order[F.col("_again")] > F.coalesce(order[F.col(status)], F.lit(-1))
    take = F.col("_again").isNotNull() & (F.col(step).isin(*always) | stricter)
    return both.withColumn(status, F.when(take, F.col("_again")).otherwise(F.col(status))).drop("_again")
