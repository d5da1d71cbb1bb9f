"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop frequent lines, reassemble.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at either end and with A-Z lower-cased; keys are
compared by two independent 64-bit hashes. Only positions and hashes are shuffled to be counted; the text moves once,
to meet the positions to drop. A frequent line is counted from partial counts, and the positions of its copies are found
by an equi-join whose large partitions can be split.

Defined results: null or empty text is one empty line; texts are split whole, whatever their length (a text's lines are
one array of its own row); of documents that share a frequent line the largest doc_id keeps all its copies of it; if a
doc_id repeats its rows are collapsed first (``one_row_per_id``); rows without doc_id are left out; an empty table gives
an empty one; extra columns are not read. Nothing depends on ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import apart, one_row_per_id, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def reassembled(lines: Column, drops: Column) -> Column:
    """The lines without those at the positions ``drops`` (null: none), joined. ``lines`` has to be a column: an
    expression would be evaluated again for each line."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    return F.array_join(F.when(drops.isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i))), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, text (kept lines joined by a line feed), n_lines, n_dropped."""
    docs = one_row_per_id(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).select("doc_id", "pos", line_key(F.col("line")).alias("key"))
    # positions and hashes only, written once: counted, then looked up
    lines = written(lines.where(F.length("key") >= min_chars).select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    # per (hash, document) first, whatever the group's size; then per hash, with map-side combining
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    frequent = held.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    gone = lines.join(frequent.select(*apart("h1", "h2"), "keeper"), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_list("pos").alias("drops"))
    both = docs.join(gone, "doc_id", "left").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), "drops")
    dropped = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long")
    return both.select("doc_id", reassembled(F.col("lines"), F.col("drops")).alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))
