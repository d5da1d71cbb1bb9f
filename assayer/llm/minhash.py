"""MinHash near-dedup by min-max hashing.

Each of ``PERMUTATIONS`` permutations of the shingle hashes is evaluated once and gives two values, its minimum and its
maximum over the document's set; either agrees for two sets with probability J, and together they estimate J without
bias and with less variance than as many independent minima would. ``BANDS`` bands take the four values of two
permutations each: two sets with J = 0.8 miss all bands with probability (1 - 0.8**4)**32, about 5e-8.

Equal sets are one class, with its smallest doc_id; bands, candidates and links are between classes. A candidate is first
compared with the hub of its band bucket (a star, never all pairs of a bucket). The hub is the member with the most
company over all its buckets: in a group of near copies, the text that the others were made from, so that one star joins
nearly all of them. Then, where a bucket still spans several components, members are compared with those members of the
other components whose sizes and parity bitmaps allow the wanted
similarity (a bound, not an estimate: no link is lost). Every link is confirmed on full shingle sets, by their words;
classes of equal sets are found by two independent 64-bit sums and the size.
Components are contracted by ``operators.components``.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer words than a shingle are
one shingle; a similarity at the limit is a link; long texts are read whole; rows without doc_id are left out; a repeated
doc_id is collapsed first; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import apart, one_row_per_id, written
from assayer.llm.arrays import LOWER, U, _splitmix, chunks, joined, mixed, stirred, window_hashes, word_hashes, words_in
from assayer.operators.components import components

PERMUTATIONS, BANDS = 64, 32
#: Longs of a set's parity bitmap: each shingle toggles one bit, so two bitmaps differ in at most as many bits as the sets
#: differ in shingles.
LONGS = 32
#: Longs of the bitmap folded on itself, which is a parity bitmap too: a cheaper bound that goes first.
FOLDED = 8
#: Members of a bucket that one key of the pairwise step holds, about.
DEAL = 512
FACTOR = _splitmix(PERMUTATIONS, 101) | U(1)
SHIFT = _splitmix(PERMUTATIONS, 202)
BAND = _splitmix(BANDS, 303)
FOUR = _splitmix(4, 404) | U(1)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first text, sets of the texts from there on, an independent second hash of each member), chunk by chunk; a set is
    sorted distinct 64-bit hashes."""
    for i, j in chunks(texts):
        data, starts = joined(texts[i:j])
        a, b, counts = words_in(data, starts)
        words = [word_hashes(data, a, b, lower=True, seed=seed) for seed in (0, 1)]
        runs = [window_hashes(x, k) for x in words]
        sets, others = [], []
        for low, high in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            n = high - low
            if 0 < n < k:
                one, two = (stirred(window_hashes(x[low:high], n), np.array([n], U)) for x in words)
            else:
                one, two = (x[low : max(low, high - k + 1)] for x in runs)
            order = np.argsort(one)
            one = one[order]
            new = np.ones(n and len(one), bool)
            new[1:] = one[1:] != one[:-1]
            sets.append(one[new])
            others.append(two[order[new]])
        yield i, sets, others


def shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The set itself, by its words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(bytes(LOWER)).split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def min_max_bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS band keys of each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), BANDS), U)
    for p in range(PERMUTATIONS):
        v = flat * FACTOR[p] + SHIFT[p]
        keys[:, p // 2] += np.minimum.reduceat(v, at) * FOUR[2 * (p % 2)] + np.maximum.reduceat(v, at) * FOUR[2 * (p % 2) + 1]
    return mixed(keys + BAND)


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """The sets' parity bitmaps, LONGS 64-bit numbers each."""
    size = 64 * LONGS
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(own * size + ((flat >> U(13)) % U(size)).astype(np.int64), minlength=len(sets) * size) & 1
    return np.packbits(odd.reshape(len(sets), size).astype(np.uint8), axis=1).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches: whole texts and their sets are held for a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for first, sets, others in shingle_sets(texts, k):
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                bands, bits = np.zeros((len(sets), BANDS), U), np.zeros((len(sets), LONGS), np.int64)
                s1, s2 = np.zeros(len(sets), U), np.zeros(len(sets), U)
                if len(full):
                    some = [sets[i] for i in full]
                    bands[full], bits[full] = min_max_bands(some), parity(some)
                    at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    s1[full] = np.add.reduceat(mixed(np.concatenate(some)), at)
                    s2[full] = np.add.reduceat(mixed(np.concatenate([others[i] for i in full])), at)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (bands, bits)]
                yield pa.record_batch([pa.array(ids[first : first + len(sets)]), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *lists], ["doc_id", "n", "s1", "s2", "bands", "bits"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in slices(batches):
            rows = batch.to_pydict()
            a, b = [], []
            for x, y, text, other in zip(rows["x"], rows["y"], rows["text"], rows["other"], strict=True):
                if last[0] != y:
                    last = (y, shingles(other, k))
                own = shingles(text, k)
                both = len(own & last[1])
                if both and 100 * both >= percent * (len(own) + len(last[1]) - both):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    docs = one_row_per_id(docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    signed = written(docs.mapInArrow(_signatures(k), "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, bits array<bigint>"), "signatures")
    classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class"))
    member = written(signed.where("n > 0").join(classes.select(*apart("s1", "s2", "n"), "class"), ["s1", "s2", "n"]).select("doc_id", "class", "n", "bands", "bits"), "members")

    firsts = member.where("doc_id = class")
    rows = firsts.select("doc_id", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    bucket = written(rows.join(sizes.select(*apart("key"), "size"), "key"), "buckets")  # buckets with company
    company = bucket.groupBy("doc_id").agg(F.sum("size").alias("company"))
    ranked = bucket.join(company.select(*apart("doc_id"), "company"), "doc_id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("first"), "n")).alias("h"))
    starred = bucket.join(hubs.select(*apart("key"), (-F.col("h.first")).alias("hub"), F.col("h.n").alias("hub_n")), "key")
    able = written(docs.join(bucket.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    def alike(x: str, y: str):  # J cannot reach the limit otherwise
        return (F.lit(100) * F.least(x, y)) >= (F.lit(percent) * F.greatest(x, y))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among the pairs x, y."""
        with_x = pairs.join(able, F.col("x") == F.col("doc_id")).select("x", "y", "text")
        both = with_x.join(able.select(F.col("doc_id").alias("y"), F.col("text").alias("other")), "y").select("x", "y", "text", "other")
        return written(both.mapInArrow(_confirm(k, percent), "a bigint, b bigint"), "links")

    # a star in each bucket, then members of different components in one bucket
    stars = written(starred.where((F.col("doc_id") != F.col("hub")) & alike("n", "hub_n")).select(F.col("doc_id").alias("x"), F.col("hub").alias("y")).distinct(), "pairs")
    links = confirmed(stars)
    label = components(links).select(F.col("id").alias("doc_id"), "component")
    own = bucket.join(label, "doc_id", "left").select("key", "size", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    split = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*apart("key"))
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), [F.get("bits", j) for j in range(i, LONGS, FOLDED)]).alias(f"z{i}") for i in range(FOLDED)]
    own = own.join(split, "key").join(firsts.select("doc_id", "n", "bits", *folded), "doc_id")
    # a large bucket is dealt to several keys: one side by a hash, the other to all of them
    dealt = F.ceil(F.col("size") / DEAL).cast("int")
    other = own.withColumn("deal", F.explode(F.sequence(F.lit(0), dealt - 1)))
    own = own.withColumn("deal", F.pmod(F.xxhash64("doc_id"), dealt).cast("int"))
    other = other.select("key", "deal", F.col("doc_id").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("bits").alias("other_bits"), *[F.col(f"z{i}").alias(f"y{i}") for i in range(FOLDED)])

    def near(pairs: list) -> Column:
        """Sets with the wanted similarity differ in at most this share of their shingles, and bitmaps in no more bits."""
        differing = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in pairs])
        return differing * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)

    quick = near([(F.col(f"z{i}"), F.col(f"y{i}")) for i in range(FOLDED)])
    whole = near([(F.get("bits", i), F.get("other_bits", i)) for i in range(LONGS)])
    met = own.join(other, (own["key"] == other["key"]) & (own["deal"] == other["deal"]) & (F.col("c") > F.col("d")) & alike("n", "m") & quick & whole)
    rest = written(met.select(F.greatest("doc_id", "y").alias("x"), F.least("doc_id", "y").alias("y")).distinct().join(stars.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), ["x", "y"], "left_anti"), "pairs")
    if rest.limit(1).count():
        links = written(links.union(confirmed(rest)), "links")
        label = components(links).select(F.col("id").alias("doc_id"), "component")
    reached = label.select(F.col("doc_id").alias("class"), F.col("component").alias("reached"))
    out = member.select("doc_id", "n", "class").join(reached, "class", "left").select("doc_id", "n", F.coalesce("reached", "class").alias("component"))
    out = out.union(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
