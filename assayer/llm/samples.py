"""Bounded samples of texts to fit on: per group by hash order, until a budget of rows or characters is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates are drawn at this many times the rate that fills the budget; the exact cut is made among them.
SPARE = 4


def told(texts: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, tie: what the choice needs to know of a text, without the text."""
    return texts.where(F.length(text) > 0).select(F.col(id_).alias("id"), F.length(text).alias("n"), F.xxhash64(text).alias("tie"))


def drawn(known: DataFrame, texts: DataFrame, seed: str, rows: int | None, chars: int, id_: str = "doc_id", text: str = "text") -> list[tuple]:
    """(group, id, text): of each group of ``known`` (group, and what ``told`` tells of ``texts``) at most ``rows`` texts and
    ``chars`` characters, in hash order of the ids; the last text may be a prefix. A group with any character gets at least
    its first text, however long its texts are. Texts stay where they are: the chosen ids are broadcast, which are no more
    than the budget has characters (or rows), and what reaches the driver is the budget times the number of groups."""
    own = known.where("group is not null").withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)))
    order = F.struct("place", "id", "tie")
    sizes = own.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"), F.min(order).alias("first")).collect()  # a row a group
    if not sizes:
        return []
    limit: Column | None = None
    for r in sizes:
        share = min(1.0, SPARE * chars / r["chars"], SPARE * rows / r["rows"] if rows else 1.0)
        test = F.col("group") == F.lit(r["group"])
        place = max(int(share * (1 << 30)), r["first"]["place"] + 1)
        limit = F.when(test, place) if limit is None else limit.when(test, place)
    some = own.where(F.col("place") < limit).dropDuplicates(["group", "id", "tie"])
    w = Window.partitionBy("group").orderBy("place", "id", "tie")
    some = some.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("number", F.row_number().over(w))
    kept = some.where((F.col("before") < chars) & (F.lit(True) if rows is None else F.col("number") <= rows))
    chosen = kept.select("group", F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.least(F.col("n"), F.lit(chars) - F.col("before")).cast("int").alias("take"))
    met = texts.join(F.broadcast(chosen), F.col(id_).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_tie")))
    got = {(r["group"], r["id"], r["text"]) for r in met.select("group", F.col("_id").alias("id"), F.expr(f"substring({text}, 1, take)").alias("text")).collect()}
    return sorted(got, key=lambda x: (str(x[0]), x[1] is None, x[1], x[2]))
