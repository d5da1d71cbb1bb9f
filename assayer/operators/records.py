"""The record store: source precedence, content states, validation, near pairs, grouped split, leakage, reconciliation."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.grades import hamming
from assayer.functions.tables import written
from assayer.operators.components import components
from assayer.operators.runs import lagged


def precedence(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame, Column]], fields: list[str]) -> DataFrame:
    """For each key the whole record of the first source that has a usable one (never field by field), and its name."""
    out, taken = keys.select(key), []
    for name, df, usable in sources:
        packed = df.where(usable).select(key, F.struct(*fields).alias(f"_{name}"))
        out = out.join(packed, key, "left")
        taken.append(name)
    record = F.coalesce(*[F.col(f"_{n}") for n in taken])
    origin = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in taken])
    return out.select(key, record.alias("_r"), origin.alias("origin")).select(key, "origin", *[F.col(f"_r.{f}").alias(f) for f in fields])


def differing(a: str, b: str, fields: list[str]) -> Column:
    """Sorted names of fields that differ, null-safe."""
    return F.filter(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())


def all_ok(checks: Column, expected: int) -> Column:
    """False if any check is false, true if all are present and true, else null."""
    return F.when(F.exists(checks, lambda x: x.eqNullSafe(F.lit(False))), False).when((F.size(checks) >= expected) & F.forall(checks, lambda x: x.eqNullSafe(F.lit(True))), True)


def cache_status(present: Column, hash_ok: Column) -> Column:
    return F.when(present & hash_ok.eqNullSafe(F.lit(False)), "hash_mismatch").when(present & hash_ok, "ok").when(present, "unverified").otherwise("missing")


def rule_errors(rules: list[tuple[Column, str]]) -> Column:
    """Messages of the broken rules, in rule order; a rule that is null counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in rules]), lambda x: x.isNotNull())


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in only one of two tables, and which."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side"))


def near_pairs(items: DataFrame, key: str, bits: str, distance: int) -> DataFrame:
    """a < b with Hamming distance at most ``distance`` of their 64-bit values. Exact by the pigeonhole principle: the bits
    that vary are cut into distance + k parts, of which at least k are equal; k grows with the number of values, so that
    the equal bits tell values apart (``shared_parts``), and each combination of k parts is an equi-join. Equal values
    are compared as one class, so a value that very many keys share makes no pairs among them; they are chained
    instead: ``b`` with the class's smallest key ``a``, distance 0."""
    classes = written(items.where(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("rep")), "classes")
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.bit_or(bits).alias("any"), F.bit_and(bits).alias("all")).first()
    places = [i for i in range(64) if ((seen["any"] or 0) ^ (seen["all"] or 0)) >> i & 1]
    k = shared_parts(seen["n"], len(places), distance)
    parts = [places[i :: distance + k] for i in range(distance + k)]
    masks = [sum(1 << i for part in chosen for i in part) for chosen in combinations(parts, k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    banded = classes.select("rep", bits, F.posexplode(F.array(*[F.col(bits).bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("band", "part"))
    left, right = banded.alias("l"), banded.alias("r")
    met = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.rep") < F.col("r.rep")))
    d = hamming(F.col(f"l.{bits}"), F.col(f"r.{bits}"))
    far = met.where(d <= distance).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), d.alias("distance")).distinct()
    twins = items.join(classes, bits).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return far.union(twins)


def shared_parts(values: int, bits: int, distance: int, most: int = 60) -> int:
    """How many parts two values have to share: the fewest that leave about one value a key, if at most ``most``
    combinations give it; else as many as that allows."""
    k = 1
    while k < 6 and comb(distance + k + 1, k + 1) <= most and 2 ** (bits * k / (distance + k)) < values:
        k += 1
    return k


def grouped(items: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``items`` with ``group``: the smallest key of its near-duplicate component."""
    found = components(pairs.select("a", "b"))
    return items.join(found.withColumnsRenamed({"id": key, "component": "_c"}), key, "left").withColumn("group", F.coalesce("_c", key)).drop("_c")


def stratified_split(items: DataFrame, group: str, grade: str, fraction: float, seed: int) -> DataFrame:
    """group, stratum, split: groups ordered by stratum (median grade, -1 without) and a seeded hash, then every
    1/fraction-th goes to ``check``. Places are a distributed prefix sum over (stratum, hash) ranges."""
    per = items.groupBy(group).agg(F.coalesce(F.median(grade), F.lit(-1.0)).alias("stratum"))
    per = per.withColumn("_h", F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed)))))
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(per.repartitionByRange(n, "stratum", "_h", group).withColumn("_range", F.spark_partition_id()), "split")
    inside = Window.partitionBy("_range").orderBy("stratum", "_h", group)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(before), "_range").withColumn("_i", F.col("_i") + F.col("_before"))
    check = F.floor((F.col("_i") + 1) * F.lit(fraction)) > F.floor(F.col("_i") * F.lit(fraction))
    return placed.select(group, "stratum", F.when(check, "check").otherwise("tune").alias("split"))


def leaked_keys(members: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that lie in more than one split."""
    return members.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def leaked_pairs(pairs: DataFrame, members: DataFrame, key: str, split: str) -> DataFrame:
    """Near pairs across splits, of ``pairs`` as ``near_pairs`` gives them. Of two near classes of equal values, the
    smallest keys of each split stand for their class's other keys of that split; inside a class, its smallest key is
    paired with every key of another split."""
    pairs = written(pairs, "leaks")
    twins = pairs.where("distance = 0").select(F.col("b").alias("_k"), F.col("a").alias("_rep"))
    placed = members.where(F.col(split).isNotNull()).select(F.col(key).alias("_k"), F.col(split).alias("_s")).join(twins, "_k", "left").select(F.coalesce("_rep", "_k").alias("_class"), "_k", "_s")
    held = placed.groupBy("_class", "_s").agg(F.min("_k").alias("_k"))
    a = held.select(F.col("_class").alias("a"), F.struct("_k", "_s").alias("x"))
    b = held.select(F.col("_class").alias("b"), F.struct("_k", "_s").alias("y"))
    far = pairs.where("distance > 0").join(a, "a").join(b, "b").where("x._s <> y._s").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "distance")
    first = held.groupBy("_class").agg(F.min(F.struct("_k", "_s")).alias("x"))
    same = placed.join(first, "_class").where("_s <> x._s").select("x", F.struct("_k", "_s").alias("y"), F.lit(0).alias("distance"))
    return far.union(same).select(F.col("x._k").alias("a"), F.col("x._s").alias("a_split"), F.col("y._k").alias("b"), F.col("y._s").alias("b_split"), "distance")


def membership_digest(members: DataFrame, key: str, split: str) -> str:
    """sha256 of the sorted membership as canonical JSON; the membership list is small by nature (a few bytes a group)."""
    rows = members.select(F.col(key).cast("string"), split).orderBy(F.col(key).cast("string")).toLocalIterator()
    import hashlib
    import json

    digest, first = hashlib.sha256(b"{"), True
    for k, v in rows:
        digest.update((("" if first else ",") + json.dumps(k, ensure_ascii=False) + ":" + json.dumps(v)).encode())
        first = False
    digest.update(b"}")
    return digest.hexdigest()


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key on its own, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("None")).alias("value")) for k in keys])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def upsert_newest(saved: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the newest; incoming rows win ties."""
    both = saved.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_in").desc())
    return both.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p", "_in")


def merge_first_wins(saved: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """Saved rows, and incoming ones with new keys: of several with one key the first by ``order``, then by content."""
    w = Window.partitionBy(key).orderBy(*order, F.to_json(F.struct(*incoming.columns)))
    first = incoming.join(saved.select(key), key, "left_anti").withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")
    return saved.unionByName(first)


def gaps(log: DataFrame, by: str, ts: str, short: float) -> DataFrame:
    """Of each agent: events, smallest gap in seconds, when it ended (the first such), gaps below ``short`` seconds."""
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1e6
    with_gap = lagged(log.select(by, ts), by, ts, "_before").withColumn("_gap", gap)
    first = F.min(F.when(F.col("_gap").isNotNull(), F.struct("_gap", ts)))
    return with_gap.groupBy(by).agg(F.count(F.lit(1)).alias("n"), first.alias("_m"), F.count_if(F.col("_gap") < short).alias("short_gaps")).select(by, "n", F.col("_m._gap").alias("min_gap"), F.col(f"_m.{ts}").alias("min_gap_at"), "short_gaps")


def has_report(grade: Column, name: Column) -> Column:
    """A report is one with a number for its grade and a name."""
    return grade.isNotNull() & ~F.isnan(grade.cast("double")) & (F.coalesce(name, F.lit("")) != "")


def language_of(line: Column) -> Column:
    return F.when(F.contains(F.upper(F.coalesce(line, F.lit(""))), F.lit("JAPANESE")), "japanese").otherwise("english")


def with_prior(files: DataFrame, records: DataFrame, digest: str, measures: list[str]) -> DataFrame:
    """``files`` with measures that an earlier build made of the same content; of several records the first by measures.
    What is null was never measured."""
    known = records.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(*measures)).alias("_m"))
    return files.join(known, digest, "left").select(*files.columns, *[F.col(f"_m.{m}").alias(m) for m in measures])


def carried_forward(listed: DataFrame, recorded: DataFrame, excluded: DataFrame, key: str, pool: str) -> DataFrame:
    """Listed keys, and recorded ones that no list has any more, with their pool; without the excluded ones."""
    both = listed.select(key, pool, F.lit("listed").alias("origin")).unionByName(recorded.join(listed.select(key), key, "left_anti").select(key, pool, F.lit("recorded").alias("origin")))
    return both.join(excluded.select(key).distinct(), key, "left_anti")


def fetch_of_record(record: Column) -> Column:
    """What the fetch said, as an earlier record keeps it; only images with a digest."""
    images = F.map_filter(F.transform_values(record["images"], lambda k, i: F.struct(i["url"].alias("url"), i["sha256"].alias("sha256"), i["bytes"].alias("bytes"))), lambda k, i: i["sha256"].isNotNull())
    return F.struct(record["source"]["report_url"].alias("source_url"), record["source"]["fetched_at"].alias("fetched_at"), record["source"]["agent"].alias("agent"), record["report_txt_sha256"].alias("report_txt_sha256"), images.alias("images"))


def numeric_first(value: Column) -> Column:
    """Sort key of counts by value: numbers in their order, what is no number as -1."""
    return F.coalesce(value.try_cast("double"), F.lit(-1.0))


def json_or_text(c: Column) -> Column:
    """An option's value as JSON: itself if it is JSON, else as a JSON string."""
    quoted = F.to_json(F.array(c))
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
