"""Queries of linkage, pricing and the record store over the star schema, with their oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.functions.tables import table
from assayer.operators import linkage as L
from assayer.operators import pricing as P
from assayer.operators import records as R
from assayer.operators import runs

# ---------------------------------------------------------------- derived inputs


def products(spark, sf_dir) -> DataFrame:
    """The priced catalog: a name with a number and sometimes a version, and a set."""
    k = F.col("p_partkey")
    name = F.concat(F.initcap("p_name"), F.lit(" #"), F.pmod(k, F.lit(150)).cast("string"), F.when(F.pmod(k, F.lit(7)) == 0, " [Reverse Holo]").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("product"), name.alias("product_name"), F.concat(F.lit("Pokemon "), F.col("p_brand")).alias("console"), F.pmod(k, F.lit(150)).cast("string").alias("number"))


def wanted(spark, sf_dir) -> DataFrame:
    """Free-text references to every part; some with only a part of the name."""
    k = F.col("p_partkey")
    name = F.when(F.pmod(k, F.lit(3)) == 0, F.get(F.split("p_name", " "), 0)).otherwise(F.upper("p_name"))
    number = F.concat(F.lit("0"), F.pmod(k, F.lit(150)).cast("string"), F.lit("/150"))
    parts = table(spark, sf_dir, "part")
    return parts.select(k.alias("item"), name.alias("name"), number.alias("want"), F.lower("p_brand").alias("set"), F.when(F.pmod(k, F.lit(2)) == 0, "reverse holo").otherwise("").alias("finish"))


def candidates(spark, sf_dir) -> DataFrame:
    """The two best products of each item."""
    items = L.wanted_items(wanted(spark, sf_dir), "item", F.col("name"), F.col("want"), F.col("set"), F.col("finish"))
    entries = L.product_entries(products(spark, sf_dir), "product", F.col("product_name"), F.col("console"))
    return L.top_matches(items, entries, L.PRODUCT).withColumnRenamed("entry", "product")


_PRODUCTS = """prod AS (SELECT p_partkey AS product, p_partkey % 150 AS n, lower(p_name) AS nm, lower(replace(p_brand, '#', ' ')) AS st, p_partkey % 7 = 0 AS special FROM part),
want AS (SELECT p_partkey AS item, p_partkey % 150 AS n, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE lower(p_name) END AS nm, lower(replace(p_brand, '#', ' ')) AS st, p_partkey % 2 = 0 AS rev FROM part),
cand AS (SELECT item, product, greatest(0.0, least(1.0, round(0.45 + CASE WHEN p.nm = w.nm THEN 0.25 WHEN contains(p.nm, w.nm) OR contains(w.nm, p.nm) THEN 0.12 ELSE -0.2 END
   + CASE WHEN p.st = w.st THEN 0.25 WHEN contains(p.st, w.st) OR contains(w.st, p.st) THEN 0.1 ELSE -0.15 END + CASE WHEN NOT special THEN 0.05 WHEN rev THEN 0.05 ELSE -0.1 END, 6))) AS score FROM want w JOIN prod p USING (n)),
best AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, product) AS r FROM cand)"""


def link_score_best(spark, sf_dir):
    out = L.best_match(candidates(spark, sf_dir), "item", "score", "product")
    return out.select("item", "best", "score", "runner_up", F.col("accepted").cast("int").alias("accepted"), F.col("needs_choice").cast("int").alias("needs_choice"))


def link_catalog(spark, sf_dir):
    """The other scorer, against bare catalog entries."""
    release = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))
    items = L.wanted_items(wanted(spark, sf_dir), "item", F.col("name"), F.col("want"), F.col("set"))
    cards = L.catalog_entries(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), F.pmod("p_partkey", F.lit(150)).cast("string"), release)
    return L.best_match(L.top_matches(items, cards, L.CATALOG), "item", "score", "entry").select("item", "best", "score")


def link_open(spark, sf_dir):
    """Catalog links where some items and some entries have no number, and some sets match at one end only."""
    k = F.col("p_partkey")
    release = F.concat(F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.col("p_type"), F.lit(" "))).otherwise(""), F.col("p_brand"))
    number = F.when(F.pmod(k, F.lit(3)) != 0, F.pmod(k, F.lit(150)).cast("string"))
    some = wanted(spark, sf_dir).withColumn("want", F.when(F.pmod("item", F.lit(5)) != 0, F.col("want")))
    items = L.wanted_items(some, "item", F.col("name"), F.col("want"), F.col("set"))
    cards = L.catalog_entries(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), number, release)
    out = L.best_match(L.top_matches(items, cards, L.CATALOG), "item", "score", "entry")
    return out.where("accepted").select("item", "best", "score", F.col("needs_choice").cast("int").alias("needs_choice"))


def decisive(spark, sf_dir):
    return L.decisive(candidates(spark, sf_dir), "item", "score", "product", 0.9, 0.3).withColumn("decisive", F.col("decisive").cast("int"))


def link_fallback(spark, sf_dir):
    """Customer name by key where that is known, else by (nation, segment): the smallest name there."""
    c = table(spark, sf_dir, "customer")
    by_id = c.where(F.pmod("c_custkey", F.lit(3)) != 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    pair = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_name").alias("name"))
    items = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey", "left").select("o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment")
    return L.fallback_join(items, by_id, pair, "o_custkey", ["c_nationkey", "c_mktsegment"], "name").select("o_orderkey", "name", "source")


def dedupe_keep_best(spark, sf_dir):
    """Of documents with one text: the longest name of source first, then the smallest id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return L.keep_best(d, ["h"], F.length("source").desc(), F.col("doc_id")).select("doc_id", "h")


def vote_top(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.pmod("event_id", F.lit(11)) == 0).alias("slash"), F.when(F.pmod("event_id", F.lit(17)) == 0, F.col("event_id").cast("string")).alias("set_"))
    out = L.votes(e, "user_id", "event_type", "value", "slash", "set_", "event_id")
    return out.select("user_id", "event_type", "n", "rank", F.col("set").alias("set_seen"), F.col("conflict").cast("int").alias("conflict"))


def sales_stats(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.pmod("l_partkey", F.lit(10)).alias("k"), "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber")
    return P.sales_stats(s, ["l_returnflag", "l_linestatus", "k"], "l_extendedprice", "l_shipdate", ["l_orderkey", "l_linenumber"], F.pmod("l_linenumber", F.lit(5)) == 0)


def versions(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.pmod("l_suppkey", F.lit(4)) != 0, F.pmod("l_suppkey", F.lit(4))).alias("version"))
    return P.versions(s, "l_partkey", "version")


def price_ladder(spark, sf_dir):
    """The price key of each company's grade of every part."""
    k = F.col("p_partkey")
    company = F.get(F.array(*map(F.lit, ("PSA", "BGS", "CGC", "TAG"))), F.pmod(k, F.lit(4)).cast("int"))
    grade = F.pmod(F.expr("p_partkey div 4"), F.lit(21)) / 2
    label = F.when(F.pmod(k, F.lit(3)) == 0, "Pristine 10").when(F.pmod(k, F.lit(5)) == 0, "Pristine 10 (Black Label)").otherwise("Mint")
    rows = table(spark, sf_dir, "part").select(k.alias("item"), company.alias("company"), grade.alias("grade"), label.alias("label"), F.when(F.pmod(k, F.lit(29)) == 0, 99).alias("tier"))
    return rows.select("item", P.price_key(F.col("company"), F.col("grade"), F.col("label"), F.col("tier")).alias("price_key"))


def catalog_nest(spark, sf_dir):
    """Products with prices nested by kind, flattened again to compare."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    prices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("kind")).agg(F.max("l_extendedprice").alias("price")).where("p_partkey % 5 <> 0")
    nested = P.nested_prices(part, prices, "p_partkey", "kind", "price")
    flat = F.transform(F.map_entries("prices"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 100 + 0.5).cast("string")))
    return nested.select("p_partkey", F.array_join(flat, ";").alias("prices"))


def checked_prices(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.pmod("page_id", F.lit(9)) == 0, -1.0).otherwise(F.col("page_id") * 1.5 + 1).alias("price"), F.get(F.array(F.lit("PSA 10"), F.lit("BGS 9.5"), F.lit("raw")), F.pmod("page_id", F.lit(3)).cast("int")).alias("grade"))
    p = p.withColumn("site", F.when(F.pmod("page_id", F.lit(8)) == 1, "www.pricecharting.com").otherwise(X.domain(F.col("url")))).withColumn("source", F.when(F.pmod("page_id", F.lit(10)) != 7, F.col("site")))
    return P.checked_prices(p, "price", "grade", "source", F.col("site"), ["PSA 10", "BGS 9.5"]).select("page_id", F.coalesce("why", F.lit("kept")).alias("why"))


def top_listed(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.pmod("s_suppkey", F.lit(3)) == 0, 0.0).otherwise(F.col("s_acctbal")).alias("market"), (F.col("s_acctbal") / 2).alias("mid"))
    return P.top_listed(s, "s_nationkey", "market", "mid", "s_suppkey", 3).select("s_nationkey", "s_suppkey", "worth", "place")


# ---------------------------------------------------------------- record store


def status_counts(spark, sf_dir):
    return R.status_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def schema_errors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rules = [(F.col("role").isin("user", "assistant"), "role"), (F.col("turn").between(0, 5), "turn"), (F.length("text") >= 20, "text short"), (F.col("text").rlike(r"\.\s*$"), "text end")]
    return c.withColumn("errors", R.rule_errors(rules)).where(F.size("errors") > 0).select("conv_id", "turn", F.explode("errors").alias("error"))


def field_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = F.struct("o_custkey", "o_orderstatus", "o_totalprice")
    new = F.struct(F.when(F.pmod(k, F.lit(7)) != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.pmod(k, F.lit(5)) == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + F.when(F.pmod(k, F.lit(11)) == 0, 1).otherwise(0)).alias("o_totalprice"))
    d = o.select("o_orderkey", old.alias("a"), new.alias("b")).withColumn("d", R.differing("a", "b", ["o_custkey", "o_orderstatus", "o_totalprice"]))
    return d.where(F.size("d") > 0).select("o_orderkey", F.array_join("d", ",").alias("fields"))


def merge_precedence(spark, sf_dir):
    """Original report, else refetched unless it failed, else the stored record."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    orig = o.where(F.pmod(k, F.lit(3)) == 0)
    fetched = o.where(F.pmod(k, F.lit(4)) == 0).withColumns({"o_totalprice": F.col("o_totalprice") + 1, "failed": F.pmod(k, F.lit(20)) == 0})
    stored = o.where(F.pmod(k, F.lit(5)) != 1).withColumn("o_totalprice", F.col("o_totalprice") + 2)
    out = R.precedence(o, "o_orderkey", [("original", orig, F.lit(True)), ("refetched", fetched, ~F.col("failed")), ("stored", stored, F.lit(True))], ["o_orderstatus", "o_totalprice"])
    return out.where("origin is not null")


def reconcile(spark, sf_dir):
    return R.reconcile(table(spark, sf_dir, "labels").where("doc_id % 9 <> 0"), table(spark, sf_dir, "documents").where("doc_id % 4 <> 0"), "doc_id")


def semi_excluded(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(toxic, "doc_id", "left_anti")


def anti_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def fingerprints(spark, sf_dir) -> DataFrame:
    """A 40-bit value of each document that near values share: a function of its length and source."""
    n = F.col("n_chars")
    bits = F.shiftleft(F.expr("n_chars div 16"), 12).bitwiseXOR(F.shiftleft(F.pmod(n, F.lit(4)), 3)).bitwiseXOR(F.pmod("doc_id", F.lit(3)))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", bits.alias("bits"))


_FP = "fp AS (SELECT doc_id, lang, source, n_chars, xor(xor((n_chars // 16) << 12, (n_chars % 4) << 3), doc_id % 3) AS bits FROM documents)"
_NEAR = _FP + """, cls AS (SELECT bits, min(doc_id) AS rep FROM fp GROUP BY bits),
near AS (SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.bits, b.bits))::INT AS distance FROM cls a JOIN cls b ON a.rep < b.rep AND bit_count(xor(a.bits, b.bits)) <= 2
  UNION ALL SELECT c.rep, f.doc_id, 0 FROM fp f JOIN cls c USING (bits) WHERE f.doc_id <> c.rep)"""
_COMP = _NEAR + """, edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near), lab(id, l) AS (SELECT doc_id, doc_id FROM fp UNION SELECT e.b, l.l FROM lab l JOIN edge e ON e.a = l.id),
comp AS (SELECT id AS doc_id, min(l) AS grp FROM lab GROUP BY id)"""


def near_pairs(spark, sf_dir, distance=2):
    return R.near_pairs(fingerprints(spark, sf_dir), "doc_id", "bits", distance)


def near_groups(spark, sf_dir, distance=2):
    items = fingerprints(spark, sf_dir)
    return R.grouped(items.select("doc_id"), "doc_id", R.near_pairs(items, "doc_id", "bits", distance)).select("doc_id", F.col("group").alias("grp"))


#: The reference's radius; the queries without it in their name keep the radius of their SQL.
NEAR_DISTANCE = 4
_NEAR4, _COMP4 = (x.replace("<= 2", f"<= {NEAR_DISTANCE}") for x in (_NEAR, _COMP))


def _exact_groups(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.concat_ws("|", "lang", "source", F.expr("n_chars div 50")).alias("grp"))
    return d.withColumn("grade", F.pmod("n_chars", F.lit(19)) / 2 + 1)


def split_stratified(spark, sf_dir):
    return R.stratified_split(_exact_groups(spark, sf_dir), "grp", "grade", 0.3, 7)


_SPLIT = """e AS (SELECT doc_id, lang || '|' || source || '|' || (n_chars // 50) AS grp, (n_chars % 19) / 2.0 + 1 AS grade FROM documents),
p AS (SELECT grp, median(grade) AS stratum FROM e GROUP BY grp), o AS (SELECT grp, stratum, row_number() OVER (ORDER BY stratum, md5(grp || '|7'), grp) - 1 AS i FROM p),
sp AS (SELECT grp, stratum, CASE WHEN floor((i + 1) * 0.3::DOUBLE) > floor(i * 0.3::DOUBLE) THEN 'check' ELSE 'tune' END AS split FROM o)"""


def split_summary(spark, sf_dir):
    items = _exact_groups(spark, sf_dir)
    s = R.stratified_split(items, "grp", "grade", 0.3, 7)
    return items.join(s, "grp").groupBy("split").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("grp").alias("groups"), F.count_distinct("grade").alias("grades"))


def leakage_keys(spark, sf_dir):
    """Texts that lie in more than one split, when documents are dealt by id."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "check").otherwise("tune").alias("split"))
    return R.leaked_keys(d, "h", "split")


def leakage_pairs(spark, sf_dir, distance=2):
    items = fingerprints(spark, sf_dir)
    members = items.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, "check").otherwise("tune").alias("split"))
    return R.leaked_pairs(R.near_pairs(items, "doc_id", "bits", distance), members, "doc_id", "split")


def log_gaps(spark, sf_dir):
    out = R.gaps(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 3600.0)
    return out.withColumn("min_gap_at", F.col("min_gap_at").cast("string"))


def upsert(spark, sf_dir):
    """The newest order of each customer after a second batch with later dates for some."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    saved, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    one = lambda d: L.keep_best(d, ["o_custkey"], F.col("at").desc(), F.col("o_orderkey").desc())
    return R.upsert_newest(one(saved), one(new), "o_custkey", "at").select("o_custkey", "o_orderkey")


def newest_listing(spark, sf_dir):
    """The newest 200 records, newest first: a top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy(F.col("o_orderkey").desc()).limit(200)


def failure_stop(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return runs.failure_stop(e, "user_id", "event_id", F.col("event_type").isin("error", "view"), 3).select("user_id", "event_id")


def size_stop(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("size"))
    return runs.size_stop(e, "user_id", "event_id", "size", 200000).select("user_id", "event_id")


QUERIES = {
    "q_link_score_best": link_score_best, "q_link_catalog": link_catalog, "q_link_open": link_open, "q_decisive_candidate": decisive, "q_link_fallback": link_fallback, "q_dedupe_keep_best": dedupe_keep_best, "q_vote_top": vote_top,
    "q_sales_stats": sales_stats, "q_versions": versions, "q_price_ladder": price_ladder, "q_catalog_nest": catalog_nest, "q_checked_prices": checked_prices, "q_top_listed": top_listed,
    "q_status_counts": status_counts, "q_schema_errors": schema_errors, "q_field_diff": field_diff, "q_merge_precedence": merge_precedence, "q_reconcile_full_outer": reconcile,
    "q_semi_excluded": semi_excluded, "q_anti_missing": anti_missing, "q_near_pairs_hamming": near_pairs, "q_components": near_groups, "q_split_stratified": split_stratified, "q_split_summary": split_summary,
    "q_leakage_keys": leakage_keys, "q_leakage_pairs": leakage_pairs, "q_log_gaps": log_gaps, "q_upsert_newest": upsert, "q_newest_listing": newest_listing, "q_failure_stop": failure_stop, "q_size_stop": size_stop,
    "q_near_pairs_radius4": partial(near_pairs, distance=NEAR_DISTANCE), "q_components_radius4": partial(near_groups, distance=NEAR_DISTANCE), "q_leakage_pairs_radius4": partial(leakage_pairs, distance=NEAR_DISTANCE),
}

_KEYCASE = "CASE WHEN tier >= 99 OR grade < 1 THEN NULL WHEN grade >= 10 THEN CASE company WHEN 'PSA' THEN 'manual-only-price' WHEN 'BGS' THEN CASE WHEN label LIKE '%Black Label%' THEN 'condition-20-price' ELSE 'bgs-10-price' END WHEN 'CGC' THEN CASE WHEN label LIKE '%Pristine%' THEN 'condition-19-price' ELSE 'condition-17-price' END ELSE 'condition-21-price' END " + " ".join(f"WHEN grade >= {g} THEN '{k}'" for g, k in P.GRADE_KEYS) + " END"
ORACLE_SQL = {
    "q_link_score_best": f"WITH {_PRODUCTS} SELECT item, max(product) FILTER (WHERE r = 1) AS best, max(score) AS score, max(score) FILTER (WHERE r = 2) AS runner_up, (max(score) >= 0.5)::INT AS accepted, (max(score) < 0.5 OR coalesce(max(score) FILTER (WHERE r = 2), -1) >= max(score) - 0.05)::INT AS needs_choice FROM best GROUP BY item",
    "q_link_catalog": """WITH w AS (SELECT p_partkey AS item, p_partkey % 150 AS n, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE lower(p_name) END AS nm, lower(replace(p_brand, '#', ' ')) AS st FROM part),
      e AS (SELECT p_partkey AS entry, p_partkey % 150 AS n, lower(p_name) AS nm, lower(replace(p_brand, '#', ' ') || ' ' || p_type) AS st FROM part),
      s AS (SELECT item, entry, greatest(0.0, least(1.0, round(0.45 + CASE WHEN e.nm = w.nm THEN 0.25 WHEN contains(e.nm, w.nm) OR contains(w.nm, e.nm) THEN 0.12 ELSE -0.2 END + CASE WHEN e.st = w.st OR ends_with(e.st, ' ' || w.st) OR starts_with(e.st, w.st || ' ') THEN 0.25 WHEN contains(e.st, w.st) OR contains(w.st, e.st) THEN 0.12 ELSE -0.15 END, 6))) AS score FROM w JOIN e USING (n))
      SELECT item, entry AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, entry) AS r FROM s) WHERE r = 1""",
    "q_link_open": """WITH w AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 150 END AS n, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE lower(p_name) END AS nm, lower(replace(p_brand, '#', ' ')) AS st FROM part),
      e AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 150 END AS n, lower(p_name) AS nm, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) || ' ' ELSE '' END || lower(replace(p_brand, '#', ' ')) AS st FROM part),
      wc AS (SELECT DISTINCT n, nm, st FROM w), ec AS (SELECT n, nm, st, min(entry) AS first, CASE WHEN count(*) > 1 THEN min(entry) FILTER (WHERE entry > low) END AS second FROM (SELECT *, min(entry) OVER (PARTITION BY n, nm, st) AS low FROM e) GROUP BY n, nm, st),
      s AS (SELECT wc.n, wc.nm, wc.st, first, second, greatest(0.0, least(1.0, round(CASE WHEN wc.n = ec.n THEN 0.45 WHEN wc.n IS NOT NULL AND ec.n IS NOT NULL THEN -0.5 ELSE 0 END
        + CASE WHEN ec.nm = wc.nm THEN 0.25 WHEN contains(ec.nm, wc.nm) OR contains(wc.nm, ec.nm) THEN 0.12 ELSE -0.2 END
        + CASE WHEN ec.st = wc.st OR ends_with(ec.st, ' ' || wc.st) OR starts_with(ec.st, wc.st || ' ') THEN 0.25 WHEN contains(ec.st, wc.st) OR contains(wc.st, ec.st) THEN 0.12 ELSE -0.15 END, 6))) AS score FROM wc, ec),
      u AS (SELECT n, nm, st, first AS entry, score FROM s WHERE score >= 0.45 UNION ALL SELECT n, nm, st, second, score FROM s WHERE score >= 0.45 AND second IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY n, nm, st ORDER BY score DESC, entry) AS r FROM u)
      SELECT item, max(entry) FILTER (WHERE r = 1) AS best, max(score) AS score, (coalesce(max(score) FILTER (WHERE r = 2), -1) >= max(score) - 0.05)::INT AS needs_choice
      FROM w JOIN r ON w.nm = r.nm AND w.st = r.st AND w.n IS NOT DISTINCT FROM r.n WHERE r.r <= 2 GROUP BY item HAVING max(score) >= 0.5""",
    "q_decisive_candidate": f"WITH {_PRODUCTS} SELECT item, max(product) FILTER (WHERE r = 1) AS best, max(score) AS score, (max(score) >= 0.9 AND max(score) - coalesce(max(score) FILTER (WHERE r = 2), 0) >= 0.3)::INT AS decisive FROM best GROUP BY item",
    "q_link_fallback": "WITH pr AS (SELECT c_nationkey, c_mktsegment, min(c_name) AS nm FROM customer GROUP BY ALL) SELECT o_orderkey, coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_name END, pr.nm) AS name, CASE WHEN c.c_custkey % 3 <> 0 THEN 'id' WHEN pr.nm IS NOT NULL THEN 'pair' END AS source FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN pr USING (c_nationkey, c_mktsegment)",
    "q_dedupe_keep_best": "SELECT doc_id, h FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY length(source) DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "q_vote_top": """WITH p AS (SELECT user_id, event_type, count(*) AS n, count(*) + max(value) + CASE WHEN bool_or(event_id % 11 = 0) THEN 0.5 ELSE 0 END + CASE WHEN bool_or(event_id % 17 = 0) THEN 0.3 ELSE 0 END AS rank, (min(event_id) FILTER (WHERE event_id % 17 = 0))::VARCHAR AS set_seen FROM events GROUP BY ALL),
      r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS nn FROM p WINDOW w AS (PARTITION BY user_id ORDER BY rank DESC, event_type)) SELECT user_id, event_type, n, rank, set_seen, (coalesce(nn, 0) >= n)::INT AS conflict FROM r WHERE k = 1""",
    "q_sales_stats": "SELECT l_returnflag, l_linestatus, l_partkey % 10 AS k, count(*) AS n, median(l_extendedprice) AS median, min(l_extendedprice) AS low, max(l_extendedprice) AS high, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_extendedprice)) AS last FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_extendedprice > 0 GROUP BY ALL",
    "q_versions": "WITH c AS (SELECT l_partkey, nullif(l_suppkey % 4, 0) AS version, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT DISTINCT l_partkey, NULL, 0 FROM lineitem), s AS (SELECT l_partkey, version, sum(n)::BIGINT AS n FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY version NULLS FIRST) AS place FROM s",
    "q_price_ladder": f"WITH r AS (SELECT p_partkey AS item, ['PSA','BGS','CGC','TAG'][p_partkey % 4 + 1] AS company, ((p_partkey // 4) % 21) / 2.0 AS grade, CASE WHEN p_partkey % 3 = 0 THEN 'Pristine 10' WHEN p_partkey % 5 = 0 THEN 'Pristine 10 (Black Label)' ELSE 'Mint' END AS label, CASE WHEN p_partkey % 29 = 0 THEN 99 ELSE 0 END AS tier FROM part) SELECT item, {_KEYCASE} AS price_key FROM r",
    "q_catalog_nest": "WITH m AS (SELECT l_partkey, l_returnflag, max(l_extendedprice) AS p FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL) SELECT p_partkey, coalesce(string_agg(l_returnflag || '=' || floor(p * 100 + 0.5)::BIGINT, ';' ORDER BY l_returnflag), '') AS prices FROM part LEFT JOIN m ON l_partkey = p_partkey GROUP BY p_partkey",
    "q_checked_prices": "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'price' WHEN page_id % 3 = 2 THEN 'grade' WHEN page_id % 10 = 7 THEN 'source' WHEN page_id % 8 = 1 THEN 'blocked source' ELSE 'kept' END AS why FROM pages",
    "q_top_listed": "SELECT s_nationkey, s_suppkey, worth, place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY worth DESC, s_suppkey) AS place FROM (SELECT s_nationkey, s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END, 0), s_acctbal / 2, 0) AS worth FROM supplier)) WHERE place <= 3",
    "q_status_counts": "SELECT 'o_orderstatus' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "q_schema_errors": r"SELECT conv_id, turn, 'role' AS error FROM conversations WHERE coalesce(role NOT IN ('user','assistant'), true) UNION ALL SELECT conv_id, turn, 'turn' FROM conversations WHERE coalesce(turn NOT BETWEEN 0 AND 5, true) UNION ALL SELECT conv_id, turn, 'text short' FROM conversations WHERE coalesce(length(text) < 20, true) UNION ALL SELECT conv_id, turn, 'text end' FROM conversations WHERE coalesce(NOT regexp_matches(text, '\.\s*$'), true)",
    "q_field_diff": "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'o_custkey' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'X' THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 11 = 0 THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') AS fields FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0",
    "q_merge_precedence": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'original' WHEN o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0 THEN 'refetched' ELSE 'stored' END AS origin, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0 THEN 1 ELSE 2 END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0) OR o_orderkey % 5 <> 1",
    "q_reconcile_full_outer": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL",
    "q_semi_excluded": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "q_anti_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q_near_pairs_hamming": f"WITH {_NEAR} SELECT a, b, distance FROM near",
    "q_components": f"WITH RECURSIVE {_COMP} SELECT doc_id, grp FROM comp",
    "q_split_stratified": f"WITH {_SPLIT} SELECT grp, stratum, split FROM sp",
    "q_split_summary": f"WITH {_SPLIT} SELECT split, count(*) AS items, count(DISTINCT e.grp) AS groups, count(DISTINCT grade) AS grades FROM e JOIN sp ON e.grp = sp.grp GROUP BY split",
    "q_leakage_keys": "SELECT sha256(text) AS h, count(DISTINCT doc_id % 3 = 0) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3 = 0) > 1",
    "q_leakage_pairs": f"WITH {_NEAR} SELECT a, CASE WHEN a % 3 = 0 THEN 'check' ELSE 'tune' END AS a_split, b, CASE WHEN b % 3 = 0 THEN 'check' ELSE 'tune' END AS b_split, distance FROM near WHERE (a % 3 = 0) <> (b % 3 = 0)",
    "q_log_gaps": "WITH g AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS n, min(gap) AS min_gap, (arg_min(ts, struct_pack(a := gap, b := ts)) FILTER (WHERE gap IS NOT NULL))::VARCHAR AS min_gap_at, count(*) FILTER (WHERE gap < 3600) AS short_gaps FROM g GROUP BY user_id",
    "q_upsert_newest": "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey % 2, c := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "q_newest_listing": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 200",
    "q_failure_stop": "WITH f AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS f FROM events), x AS (SELECT *, f AND lag(f) OVER w AND lag(f, 2) OVER w AS three FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT user_id, min(event_id) FILTER (WHERE three) AS stop FROM x GROUP BY user_id) SELECT x.user_id, event_id FROM x JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop",
    "q_size_stop": "SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s < 200000",
    "q_near_pairs_radius4": f"WITH {_NEAR4} SELECT a, b, distance FROM near",
    "q_components_radius4": f"WITH RECURSIVE {_COMP4} SELECT doc_id, grp FROM comp",
    "q_leakage_pairs_radius4": f"WITH {_NEAR4} SELECT a, CASE WHEN a % 3 = 0 THEN 'check' ELSE 'tune' END AS a_split, b, CASE WHEN b % 3 = 0 THEN 'check' ELSE 'tune' END AS b_split, distance FROM near WHERE (a % 3 = 0) <> (b % 3 = 0)",
}
