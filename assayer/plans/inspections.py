"""Inspection records derived from the star schema: an order is a card, its line items are its listed defects.

All derivations are integer arithmetic on keys, so that any engine gives the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.tables import table
from assayer.plans import criteria as C

#: share = 50 + (key * a mod b) / 2; unread if key mod c = 0
SHARES = {"front_lr": (7, 23, 23), "front_tb": (11, 19, 29), "back_lr": (13, 61, 31), "back_tb": (17, 81, 37)}


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = {"id": k}
    for axis, (a, b, c) in SHARES.items():
        out[axis] = F.lit(50.0) + F.pmod(k * a, F.lit(b)) / 2
        out[f"{axis}_unread"] = F.pmod(k, F.lit(c)) == 0
    for i, s in enumerate(C.SIDES):
        for j, c in enumerate(C.COMPONENTS):
            out[f"seen_{s}_{c}"] = F.pmod(k + 3 * i + j, F.lit(11)) != 0
            out[f"limited_{s}_{c}"] = F.pmod(k + 2 * i + j, F.lit(13)) == 0
            out[f"in_hand_{s}_{c}"] = F.pmod(k + i + 2 * j, F.lit(17)) == 0
    return table(spark, sf_dir, "orders").select(*[v.alias(n) for n, v in out.items()])


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, side, component, severity, confirmed, qualifier, fatal, cap, pos. The fatal kind is rare: elsewhere its
    place is taken by a print spot."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.array(*map(F.lit, where)).alias("where"), F.array(*[F.lit(float(c)) for c in caps]).alias("caps"), F.lit(q).cast("string").alias("qualifier"), F.lit(n in C.FATAL).alias("fatal")) for n, where, caps, q in C.DEFECTS])
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    at = F.pmod("l_partkey", F.lit(len(C.DEFECTS)))
    at = F.when((at == 20) & (F.pmod("l_orderkey", F.lit(97)) != 0), 11).otherwise(at).cast("int")
    kind = F.get(kinds, at)
    place = F.pmod(F.expr("l_partkey div 21"), F.size(kind["where"])).cast("int")
    level = F.pmod("l_linenumber", F.lit(4))
    return item.select(
        F.col("l_orderkey").alias("id"),
        kind["kind"].alias("kind"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "front").otherwise("back").alias("side"),
        F.get(kind["where"], place).alias("component"),
        F.get(F.array(*map(F.lit, C.SEVERITIES)), level).alias("severity"),
        (F.pmod(F.col("l_quantity").cast("bigint"), F.lit(10)) != 0).alias("confirmed"),
        kind["qualifier"].alias("qualifier"),
        kind["fatal"].alias("fatal"),
        F.get(kind["caps"], level).alias("cap"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("pos"),
    )
