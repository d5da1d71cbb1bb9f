"""Queries of parsing, views and stateful batch twins, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.functions.grades import half_up, split_ratio
from assayer.functions.tables import table
from assayer.sources import sinks
from assayer.streaming import latest as S


def parse_centering(spark, sf_dir):
    k = F.col("p_partkey")
    lr, tb = F.pmod(k, F.lit(50)) + 30, F.pmod(k * 3, F.lit(41)) + 40
    s = lambda x: x.cast("string")
    text = F.concat(s(lr), F.lit("L/"), s(100 - lr), F.lit("R "), s(tb), F.lit("T/"), s(100 - tb), F.when(F.pmod(k, F.lit(9)) == 0, "").otherwise("B"))
    return table(spark, sf_dir, "part").select("p_partkey", X.centering_shares(text).alias("c")).select("p_partkey", "c.lr", "c.tb")


def parse_number(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(F.when(F.pmod(k, F.lit(5)) == 0, "sp").otherwise("00"), F.pmod(k, F.lit(300)).cast("string"), F.lit("/0"), F.pmod(k, F.lit(97)).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.number_key(raw).alias("key"), X.collector_number(raw).alias("number"))


def card_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.card_key(F.upper("p_name"), F.upper("p_brand"), F.pmod("p_partkey", F.lit(150)).cast("string")).alias("card_key"))


def first_years(spark, sf_dir):
    line = F.concat(F.lit("set "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy"), F.lit(" #"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.first_year(line).alias("year"), X.number_after_hash(line).alias("number"))


def domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("domain"))


def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def split_ratios(spark, sf_dir):
    a, b = F.pmod("o_orderkey", F.lit(7)).cast("double"), F.pmod("o_orderkey", F.lit(5)).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", half_up(split_ratio(a, b), 1).alias("share"))


def defect_kinds(spark, sf_dir):
    kinds = ("Centering off", "Corner wear", "Edge chip", "Bend", "Surface scratch", "Roller line", "Something else", "Dent / corner")
    k = F.get(F.array(*map(F.lit, kinds)), F.pmod("l_partkey", F.lit(8)).cast("int"))
    d = table(spark, sf_dir, "lineitem").select(k.alias("type"))
    return d.groupBy(F.coalesce(X.defect_kind(F.col("type"), True), F.lit("none")).alias("strict"), F.coalesce(X.defect_kind(F.col("type"), False), F.lit("none")).alias("plain")).agg(F.count(F.lit(1)).alias("n"))


def flag_match(spark, sf_dir):
    """Listed defects that some flag of their order accounts for: an equi-join on (order, side) with a residual test."""
    loc = F.array(*map(F.lit, ("topleft", "top", "bottom edge", "surface")))
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.pmod("l_suppkey", F.lit(2)).alias("side"))
    listed = item.where("l_linenumber % 2 = 0").select("l_orderkey", "l_linenumber", "l_partkey", "side", F.get(loc, F.pmod("l_partkey", F.lit(4)).cast("int")).alias("location"), F.when(F.pmod("l_partkey", F.lit(4)) == 0, "corner wear").otherwise("edge wear").alias("type"))
    flags = item.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("side").alias("f_side"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, "top_left").otherwise("top").alias("f_location"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, "corner_ding").otherwise("edge_dent").alias("f_type")).distinct()
    met = listed.join(flags, (listed["l_orderkey"] == flags["l_orderkey"]) & (F.col("side") == F.col("f_side")) & X.explains(F.col("side"), F.col("location"), F.col("type"), F.col("f_side"), F.col("f_location"), F.col("f_type")), "left_semi")
    return met.groupBy("location").agg(F.count(F.lit(1)).alias("matched"))


def _records(spark, sf_dir) -> DataFrame:
    """Canonical records derived from orders and their line items."""
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ding = F.struct(F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"), F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "front").otherwise("back").alias("side"), F.lit("edge").alias("location"), F.concat(F.lit("type "), F.pmod("l_partkey", F.lit(21)).cast("string")).alias("type"))
    lists = item.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(ding)).alias("ding_list"))
    k = F.col("o_orderkey")
    flag = lambda n: F.when(F.pmod(k, F.lit(n)) == 0, False).otherwise(True)
    image = lambda side: F.struct(F.sha2(F.concat(k.cast("string"), F.lit(side)), 256).alias("sha256"), F.lit(750).alias("width"), F.lit(1050).alias("height"), (k * 3).alias("bytes"), F.when(F.pmod(k, F.lit(5)) != 0, F.hex(k)).alias("phash"), F.concat(k.cast("string"), F.lit(f"/{side}.jpg")).alias("path"))
    d = F.struct(F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(3)).cast("int")).alias("front"), F.when(F.pmod(k, F.lit(6)) != 0, F.pmod(k, F.lit(2)).cast("int")).alias("back"))
    return o.join(lists, "o_orderkey", "left").select(
        k.cast("string").alias("cert"), F.when(F.pmod(k, F.lit(10)) == 0, "test").otherwise("dev").alias("pool"), F.concat(F.lit("K"), F.pmod(k, F.lit(500)).cast("string")).alias("card_key"),
        F.struct(F.lit("n").alias("name"), F.col("o_orderpriority").alias("set"), F.year(F.col("o_orderdate").cast("timestamp")).alias("year"), F.lit("en").alias("language"), F.col("o_orderstatus").alias("variant"), F.col("o_custkey").cast("string").alias("number")).alias("card"),
        F.struct(
            (F.pmod(k, F.lit(19)) / 2 + 1).alias("grade"), F.concat(F.lit("L"), F.pmod(k, F.lit(19)).cast("string")).alias("grade_label"), F.pmod(k, F.lit(901)).cast("int").alias("score"),
            F.create_map(F.lit("front"), F.concat(F.pmod(k, F.lit(50)).cast("string"), F.lit("L"))).alias("centering"), F.create_map(F.lit("corners"), d, F.lit("edges"), d).alias("dings"),
            F.coalesce("ding_list", F.array().cast("array<struct<pos:int,k:bigint,side:string,location:string,type:string>>")).alias("ding_list"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("graded_on"),
        ).alias("tag"),
        F.struct(F.concat(F.lit("u/"), k.cast("string")).alias("report_url"), F.lit("t").alias("fetched_at"), F.lit("a").alias("agent"), F.create_map(F.lit("front"), F.lit("f.jpg")).alias("image_urls")).alias("source"),
        F.sha2(k.cast("string"), 256).alias("report_txt_sha256"), F.lit("p1").alias("parser_version"), F.when(F.pmod(k, F.lit(9)) == 0, F.array(F.lit("grade"), F.lit("score"))).alias("report_changed_on_refetch"),
        F.struct(flag(8).alias("present"), F.when(F.pmod(k, F.lit(12)) != 0, flag(7)).alias("hash_ok")).alias("cache"),
        F.create_map(F.lit("front"), image("front"), F.lit("back"), image("back")).alias("images"),
    )


def _views(spark, sf_dir):
    r = _records(spark, sf_dir)
    members = r.where("cert % 7 <> 0").select("cert", F.when(F.col("pool") == "test", "test").otherwise("dev-tune").alias("split"))
    return sinks.star_views(r, members)


def view(name: str, columns: list[str]):
    return lambda spark, sf_dir: _views(spark, sf_dir)[name].select(*columns)


def latest_wins(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def ttl_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return S.ttl_dedup(e, ["user_id", "event_type"], "ts", 86400).select("event_id")


def rate_slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return S.paced_slots(e, "event_type", "ts", 1_100_000, "event_id").select("event_id", "start_us")


def sessions(spark, sf_dir):
    return S.bursts(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours").withColumn("started", F.unix_micros("started"))


def hourly(spark, sf_dir):
    return S.hourly(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour").select(F.unix_micros("started").alias("started"), "event_type", "n", "total")


def in_time(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return S.in_time(c, c.where("turn % 2 = 1"), "conv_id", "turn").distinct()


QUERIES = {
    "q_parse_centering": parse_centering, "q_parse_number": parse_number, "q_card_key": card_keys, "q_year": first_years, "q_domain": domains, "q_json_props": json_props, "q_split_ratio": split_ratios, "q_defect_kind": defect_kinds, "q_flag_match": flag_match,
    "q_views_certs": view("certs", ["cert", "pool", "split", "card_key", "card_name", "card_set", "year", "language", "variant", "grade", "grade_label", "score", "centering_front", "centering_back", "corner_dings", "edge_dings", "surface_dings", "graded_on", "report_url", "fetched_at", "agent", "report_txt_sha256", "parser_version", "report_changed_on_refetch", "cache_present", "cache_hash_ok", "image_cache"]),
    "q_views_csv": view("csv", list(sinks.CSV_COLUMNS)),
    "q_views_dings": view("dings", ["cert", "idx", "side", "type"]), "q_views_images": view("images", ["cert", "side", "sha256", "width", "height", "bytes", "phash", "path", "url"]), "q_views_splits": view("splits", ["cert", "split", "card_key"]),
    "q_latest_wins": latest_wins, "q_ttl_dedup": ttl_dedup, "q_rate_slots": rate_slots, "q_sessions": sessions, "q_hourly": hourly, "q_in_time": in_time,
}

_MICROS = "epoch_us(ts)"
_SPLIT = "CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'dev-tune' END"
_ORDER = "(SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 3)::INT END AS f, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 2)::INT END AS b, o_orderkey % 8 <> 0 AS present, CASE WHEN o_orderkey % 12 <> 0 THEN o_orderkey % 7 <> 0 END AS ok FROM orders)"
_COUNT = "CASE WHEN f IS NOT NULL OR b IS NOT NULL THEN coalesce(f, 0) + coalesce(b, 0) END"
_CERTS = f"""o_orderkey::VARCHAR AS cert, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'dev' END AS pool, 'K' || (o_orderkey % 500) AS card_key, 'n' AS card_name, o_orderpriority AS card_set, year(o_orderdate)::INT AS year, 'en' AS language, o_orderstatus AS variant,
  (o_orderkey % 19) / 2.0 + 1 AS grade, 'L' || (o_orderkey % 19) AS grade_label, (o_orderkey % 901)::INT AS score, (o_orderkey % 50) || 'L' AS centering_front, NULL::VARCHAR AS centering_back, {_COUNT} AS corner_dings, {_COUNT} AS edge_dings, NULL::INT AS surface_dings, strftime(o_orderdate, '%Y-%m-%d') AS graded_on,
  'u/' || o_orderkey AS report_url, 't' AS fetched_at, 'a' AS agent, sha256(o_orderkey::VARCHAR) AS report_txt_sha256, 'p1' AS parser_version, CASE WHEN o_orderkey % 9 = 0 THEN 'grade,score' END AS report_changed_on_refetch,
  present::INT AS cache_present, ok::INT AS cache_hash_ok, CASE WHEN NOT present THEN 'missing' WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'ok' ELSE 'hash_mismatch' END AS image_cache"""
ORACLE_SQL = {
    "q_parse_centering": "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN greatest(p_partkey % 50 + 30, 70 - p_partkey % 50)::DOUBLE END AS lr, CASE WHEN p_partkey % 9 <> 0 THEN greatest(p_partkey * 3 % 41 + 40, 60 - p_partkey * 3 % 41)::DOUBLE END AS tb FROM part",
    "q_parse_number": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'SP' ELSE '' END || (p_partkey % 300) || '/' || (p_partkey % 97) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'SP' ELSE '' END || (p_partkey % 300) AS number FROM part",
    "q_card_key": "SELECT p_partkey, upper(p_name) || '|' || upper(p_brand) || '|' || (p_partkey % 150) AS card_key FROM part",
    "q_year": "SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderkey::VARCHAR AS number FROM orders",
    "q_domain": "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM pages",
    "q_json_props": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "q_split_ratio": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 + o_orderkey % 5 = 0 THEN 50.0 ELSE floor(greatest(o_orderkey % 7, o_orderkey % 5)::DOUBLE / (o_orderkey % 7 + o_orderkey % 5) * 100 * 10 + 0.5) / 10 END AS share FROM orders",
    "q_defect_kind": "SELECT ['none','corner','edge_or_corner','edge_or_corner','surface','surface','other','surface'][k + 1] AS strict, ['none','corner','edge','edge','surface','surface','edge','surface'][k + 1] AS plain, sum(n)::BIGINT AS n FROM (SELECT l_partkey % 8 AS k, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1, 2",
    "q_flag_match": """WITH d AS (SELECT l_orderkey, l_suppkey % 2 AS side, ['topleft','top','bottom edge','surface'][l_partkey % 4 + 1] AS location, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS corner FROM lineitem WHERE l_linenumber % 2 = 0),
      f AS (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS side, l_partkey % 3 = 0 AS c FROM lineitem WHERE l_linenumber % 2 = 1)
      SELECT location, count(*) AS matched FROM d WHERE EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = d.l_orderkey AND f.side = d.side AND ((d.location = 'topleft' AND f.c) OR (d.corner = 0 AND NOT f.c AND contains(d.location, 'top')))) GROUP BY location""",
    "q_views_certs": f"SELECT {_CERTS}, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_SPLIT} END AS split FROM {_ORDER}",
    "q_views_csv": f"""WITH d AS (SELECT l_orderkey, string_agg(CASE WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END || ' edge: type ' || (l_partkey % 21), '; ' ORDER BY l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END) AS t FROM lineitem GROUP BY 1),
      c AS (SELECT o_orderkey, {_CERTS} FROM {_ORDER})
      SELECT cert, card_name AS card, card_set AS set, year, language, grade, score, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {_SPLIT} END AS split, centering_front, centering_back, corner_dings, edge_dings, surface_dings, coalesce(t, '') AS ding_list, image_cache FROM c LEFT JOIN d ON l_orderkey = o_orderkey""",
    "q_views_dings": "SELECT l_orderkey::VARCHAR AS cert, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END) - 1)::INT AS idx, CASE WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, 'type ' || (l_partkey % 21) AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "q_views_images": "SELECT o_orderkey::VARCHAR AS cert, s AS side, sha256(o_orderkey || s) AS sha256, 750 AS width, 1050 AS height, o_orderkey * 3 AS bytes, CASE WHEN o_orderkey % 5 <> 0 THEN to_hex(o_orderkey) END AS phash, o_orderkey || '/' || s || '.jpg' AS path, CASE WHEN s = 'front' THEN 'f.jpg' END AS url FROM orders, (VALUES ('front'), ('back')) v(s)",
    "q_views_splits": "SELECT o_orderkey::VARCHAR AS cert, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'dev-tune' END AS split, 'K' || (o_orderkey % 500) AS card_key FROM orders WHERE o_orderkey % 7 <> 0",
    "q_latest_wins": "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id",
    "q_ttl_dedup": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, {_MICROS} AS us FROM events), k AS (
      SELECT user_id, event_type, min(us) AS us FROM e GROUP BY ALL UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.us >= k.us + 86400000000) FROM k WHERE k.us IS NOT NULL)
      SELECT e.event_id FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.us = k.us""",
    "q_rate_slots": f"""WITH e AS (SELECT event_id, event_type, {_MICROS} AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events)
      SELECT event_id, i * 1100000000 + max(us - i * 1100000000) OVER (PARTITION BY event_type ORDER BY i) AS start_us FROM e""",
    "q_sessions": f"""WITH g AS (SELECT user_id, {_MICROS} AS us, CASE WHEN {_MICROS} - lag({_MICROS}) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
      SELECT user_id, min(us) AS started, count(*) AS n FROM s GROUP BY user_id, k""",
    "q_hourly": "SELECT epoch_us(date_trunc('hour', ts)) AS started, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "q_in_time": "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING max(turn) % 2 = 1",
}
