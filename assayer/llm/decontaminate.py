"""Benchmark decontamination, in DataFrame operations only.

Item-sized windows of the documents get 64-bit SimHash fingerprints over their five-word shingles (repeated shingles
weigh more). Fingerprints are cut into five blocks of 13 or 12 bits. Items are listed under every block value at most 2
bits away, windows look up every value at most 1 bit away, so a window meets every item that differs in at most 3 bits
of some block: all items within Hamming distance 5 * 4 - 1 = 19. A pair of windows of similarity 0.8 differs in about 10
bits (cosine 0.89 or more), with a deviation of 3. Candidates are then verified by the exact weighted-shingle similarity
(sum of smaller counts over sum of larger counts).

Which windows get a fingerprint follows from a bound, not from a guess: a window of ``own`` shingles can reach
similarity s with an item of ``size`` shingles only if at least s * (own + size) / (1 + s) of its shingles are shingles
of items of that size. Every start with that many is fingerprinted. A stock phrase of the benchmark alone makes no
window, however many items or documents hold it.

Broadcast are the items' shingles and block values, each only if its own number of rows is under BROADCAST_ROWS,
otherwise both sides are shuffled. Words are maximal runs of letters and digits of the lower-cased text. Items with
fewer than five words are one shingle of that many words. Defined results: null, empty and wordless texts and items match
nothing; repeated items count once (smallest text of an item_id); rows without an id are left out; repeated documents
give one row (the better window); documents shorter than an item are one window; of equally similar windows the first is
told; long texts are read whole; an empty table on either side gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import written

WORDS = 5
SIMILARITY = 0.8
#: Bits of each block of a fingerprint; how far items are listed and windows look, in bits of a block.
BLOCKS = (13, 13, 13, 13, 12)
LISTED, LOOKED = 2, 1
RADIUS = len(BLOCKS) * (LISTED + LOOKED + 1) - 1
#: Rows that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null or wordless text."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " ", -1))


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, by place; empty if there are fewer words."""
    runs = F.when(F.size(words) >= n, F.slice(words, F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, n)]))


def simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the shingles have it set."""
    half = F.size(shingles) / 2
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(bit(b) > half, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))


def masks(width: int, most: int) -> list[int]:
    """Numbers of ``width`` bits with at most ``most`` bits set."""
    return [m for m in range(2**width) if m.bit_count() <= most]


def block_values(fingerprint: Column, most: int) -> Column:
    """Structs of block number and value, for all values of each block at most ``most`` bits away."""
    def values(i: int, own: Column) -> Column:
        return F.transform(F.array(*map(F.lit, masks(BLOCKS[i], most))), lambda m: F.struct(F.lit(i).alias("i"), own.bitwiseXOR(m).alias("value")))

    out, low = [], 0
    for i, width in enumerate(BLOCKS):
        out.append(values(i, F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit(2**width - 1).cast("long")).cast("int")))
        low += width
    return F.concat(*out)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, n (words a shingle), shingles."""
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    rows = rows.groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    out = rows.where(F.size("words") >= WORDS).select("item_id", F.lit(WORDS).alias("n"), shingles_of(F.col("words"), WORDS).alias("shingles"))
    for n in range(1, WORDS):
        out = out.union(rows.where(F.size("words") == n).select("item_id", F.lit(n).alias("n"), shingles_of(F.col("words"), n).alias("shingles")))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per contaminated (document, item): doc_id, item_id, start_word (first best window), n_words, similarity."""
    items = written(_items(benchmark, item, item_text).withColumn("size", F.size("shingles")).withColumn("fp", simhash(F.col("shingles"))), "items")
    kinds = [r["n"] for r in items.select("n").distinct().collect()]  # at most WORDS numbers
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    if not kinds:
        return docs.select("doc_id").limit(0).join(items.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    # places of the items' shingles in the documents, by size of the items that have them
    spots = near(written(items.select("n", "size", F.explode("shingles").alias("h")).distinct(), "spots"))
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    places = None
    for n in kinds:
        every = texts.select("doc_id", (F.size("words") - n + 1).alias("all"), F.posexplode(shingles_of(F.col("words"), n)).alias("pos", "h"))
        own = every.join(spots.where(F.col("n") == n), "h").select("doc_id", "n", "size", "all", "pos")
        places = own if places is None else places.union(own)
    own = F.least("all", "size")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (own + F.col("size")) - 1e-9).cast("int")
    held = places.groupBy("doc_id", "n", "size", "all").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    held = held.select("doc_id", "n", "size", "all", "at", own.alias("own"), need.alias("need")).where(F.size("at") >= F.col("need"))
    first, last = (lambda i: F.get("at", i)), (lambda i: F.get("at", i + F.col("need") - 1))
    some = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: last(i) - first(i) < F.col("own"))
    starts = F.flatten(F.transform(some, lambda i: F.sequence(F.greatest(F.lit(0), last(i) - F.col("own") + 1), F.least(first(i), F.col("all") - F.col("own")))))
    listed = held.select("doc_id", F.struct("n", "size", "own", F.array_distinct(starts).alias("starts")).alias("w")).where(F.size("w.starts") > 0).groupBy("doc_id").agg(F.collect_list("w").alias("windows"))

    # the text meets its windows once
    texts = docs.join(listed, "doc_id").select("doc_id", words_of(F.col("text")).alias("words"), "windows")
    cut = None
    for n in kinds:
        mine = texts.select("doc_id", shingles_of(F.col("words"), n).alias("all"), F.explode(F.filter("windows", lambda w: w["n"] == n)).alias("w"))
        part = mine.select("doc_id", "all", "w", F.explode("w.starts").alias("start"))
        part = part.select("doc_id", F.lit(n).alias("n"), F.col("w.size").alias("size"), "start", F.slice("all", F.col("start") + 1, F.col("w.own")).alias("shingles")).where("size(shingles) > 0")
        cut = part if cut is None else cut.union(part)
    # a repeated document's texts may differ: a window is named by its shingles too
    cut = written(cut.distinct().withColumn("fp", simhash(F.col("shingles"))).withColumn("window", F.monotonically_increasing_id()), "windows")

    listing = near(written(items.select("item_id", "n", "size", F.col("fp").alias("item_fp"), F.explode(block_values(F.col("fp"), LISTED)).alias("b")).select("item_id", "n", "size", "item_fp", "b.i", "b.value"), "listing"))
    looked = cut.select("window", "n", "size", "fp", F.explode(block_values(F.col("fp"), LOOKED)).alias("b")).select("window", "n", "size", "fp", "b.i", "b.value")
    pairs = looked.join(listing, ["n", "size", "i", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("window", "item_id").distinct()

    counted = pairs.join(cut.drop("fp"), "window").select("window", "doc_id", "n", "size", "start", "item_id", F.size("shingles").alias("own"), F.explode("shingles").alias("h"))
    counted = counted.groupBy("window", "doc_id", "n", "size", "start", "own", "item_id", "h").agg(F.count(F.lit(1)).alias("c"))
    weights = near(written(items.select("item_id", F.explode("shingles").alias("h")).groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("item_c")), "weights"))
    shared = counted.join(weights, ["item_id", "h"]).groupBy("window", "doc_id", "item_id", "n", "size", "start", "own").agg(F.sum(F.least("c", "item_c")).alias("both"))
    scored = shared.withColumn("similarity", F.col("both") / (F.col("own") + F.col("size") - F.col("both"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "size", "n")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("start_word"), (F.col("b.size") + F.col("b.n") - 1).alias("n_words"), F.col("b.similarity").alias("similarity"))
