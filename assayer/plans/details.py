"""Queries of the smaller operators over the star schema, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.functions.tables import table
from assayer.operators import details as D
from assayer.operators import linkage as L


def _s(c):
    return c.cast("string")


def photo_gate(spark, sf_dir):
    """Measurements of every line item as a photo's: status of each check, blocked items with reasons, verdict."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    share = lambda c, n, d: F.pmod(c, F.lit(n)) / d
    m = F.struct(
        F.when(F.pmod(k, F.lit(19)) != 0, share(p, 25, 10.0)).alias("blur"), F.lit(11.9).alias("px_per_mm"), share(k, 40, 200.0).alias("glare"), F.array(*[F.pmod(p + i * k, F.lit(60)) / 2500.0 for i in range(8)]).alias("glare_zones"),
        (F.pmod(p, F.lit(900)) + 250.4).alias("card_px"), F.array(*[F.pmod(p * (i + 2) + k, F.lit(97)) - 1.0 for i in range(4)]).alias("inset"), F.lit(1200.0).alias("photo_px"), (F.pmod(k, F.lit(31)) < 2).alias("full_frame"),
        (F.pmod(k, F.lit(31)) == 0).alias("cropped"), F.array(*[F.pmod(k + i * p, F.lit(7)) / 20.0 for i in range(4)]).alias("rounded"), share(k, 50, 250.0).alias("keystone"), share(p, 33, 300.0).alias("aspect_error"), share(k, 23, 2.0).alias("angle_error"),
        F.when(F.pmod(p, F.lit(41)) != 0, share(p, 20, 20.0) + 0.1).alias("detection"), (F.pmod(p, F.lit(5)) == 0).alias("sleeve"),
    )
    photos = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m.alias("m"))
    g = D.photo_gates(photos, F.col("m"))
    why = F.array_join(F.transform(F.map_entries("gate.reasons"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",")
    return g.select("l_orderkey", "l_linenumber", "l_partkey", *[f"gate.{c}" for c in D.CHECKS], why.alias("blocked"), "gate.verdict")


def blind_test(spark, sf_dir):
    """A sealed key of two rounds joined with answers, summarised by set with rank correlation."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rounds = F.explode(F.array(F.lit("A"), F.lit("B")))
    company = F.when(F.pmod(k, F.lit(2)) == 0, "TAG").otherwise("PSA")
    key = o.select(rounds.alias("round"), _s(k).alias("card"), F.col("o_orderpriority").alias("set"), company.alias("company"), (F.pmod(k, F.lit(19)) / 2 + 1).alias("grade"))
    told = o.where(F.pmod(k, F.lit(5)) != 0).select(rounds.alias("round"), _s(k).alias("card"), F.explode(F.array(F.lit("TAG"), F.lit("PSA"))).alias("company"), "o_custkey")
    grade = F.pmod(F.col("o_custkey") + F.length("round") + F.when(F.col("round") == "B", 3).otherwise(0), F.lit(20)) / 2 + 1
    results = told.select("round", "card", "company", grade.alias("grade"), (F.pmod("o_custkey", F.lit(3)) == 0).alias("complete"))
    return D.blind_summary(D.blind_answers(key, results), ["set"])


def found_prices(spark, sf_dir):
    """Listed parts by id, else by set and number, the name deciding among several."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    number = F.concat(F.lit("0"), _s(F.pmod(k, F.lit(60))), F.lit("/150"))
    listed = part.select(_s(k).alias("id"), F.upper("p_brand").alias("set"), number.alias("number"), F.concat(F.initcap("p_name"), F.when(F.pmod(k, F.lit(3)) == 0, " (Foil)").otherwise("")).alias("name"))
    items = part.select(k.alias("item"), F.when(F.pmod(k, F.lit(4)) == 0, _s(k + 7)).alias("id"), F.when(F.pmod(k, F.lit(7)) != 0, F.lower("p_brand")).alias("set"), F.when(F.pmod(k, F.lit(11)) != 0, F.concat(_s(F.pmod(k, F.lit(61))), F.lit("/150"))).alias("number"), F.upper("p_name").alias("name"))
    return D.found_prices(items, listed)


def split_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    records = d.select(_s(F.col("doc_id")).alias("cert"), F.concat_ws("|", "lang", "source").alias("card_key"), F.when(F.pmod("n_chars", F.lit(13)) != 0, F.pmod("n_chars", F.lit(19)) / 2 + 1).alias("grade"))
    members = d.where(F.pmod("doc_id", F.lit(9)) != 0).select(_s(F.col("doc_id")).alias("cert"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "dev-check").otherwise("dev-tune").alias("split"))
    out = D.split_histogram(records, members)
    return out.select("split", "certs", "groups", F.array_join(F.transform("grades", lambda g: F.concat(F.coalesce(g["grade"], F.lit("None")), F.lit("="), _s(g["n"]))), ",").alias("grades"))


def places(spark, sf_dir):
    """Locations that each part's components allow, its subgrades as shown, and data by name."""
    k = F.col("p_partkey")
    some = F.filter(F.array(F.when(F.pmod(k, F.lit(2)) == 0, "surface"), F.when(F.pmod(k, F.lit(3)) == 0, "corners"), F.when(F.pmod(k, F.lit(5)) == 0, "edges")), lambda x: x.isNotNull())
    parts = {"centering": F.pmod(k, F.lit(19)) / 2 + 1, "corners": F.pmod(k, F.lit(17)) / 2 + 1}
    shown = D.shown_subgrades(parts, {"corners": F.when(F.pmod(k, F.lit(4)) != 0, F.lit(1))})
    data = F.array(F.struct(F.lit("Brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.when(F.pmod(k, F.lit(3)) == 0, "Size").otherwise("Type").alias("name"), F.col("p_type").alias("value")), F.struct(F.lit("Size").alias("name"), _s(F.col("p_size")).alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(D.allowed_locations(some), ",").alias("locations"), shown["centering"].alias("centering"), shown["corners"].alias("corners"), D.extended(data, "Size").alias("size"), D.extended(data, "None").alias("none"))


def durations(spark, sf_dir):
    """Minutes between the texts of an order's date and a later time, in several spellings."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = F.date_format(at, "yyyy-MM-dd")
    start = F.when(F.pmod(k, F.lit(4)) == 0, day).when(F.pmod(k, F.lit(4)) == 1, F.concat(day, F.lit("T00:00:00Z"))).when(F.pmod(k, F.lit(4)) == 2, F.concat(day, F.lit(" 02:00:00+02:00"))).otherwise("unknown")
    end = F.concat(day, F.date_format(F.timestamp_seconds(F.pmod(k * 37, F.lit(86000))), "'T'HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.minutes_between(D.iso_time(start), D.iso_time(end)).alias("minutes"))


def phash(spark, sf_dir):
    """Hashes of the matrices that the halves of each vector span (rows by the first half, columns by the other)."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    grey = F.flatten(F.transform(F.slice("e", 1, 32), lambda a: F.transform(F.slice("e", 33, 32), lambda b: a * b)))
    return D.perceptual_hashes(e.select("vec_id", grey.alias("grey")), "vec_id", "grey")


def rift_candidates(spark, sf_dir):
    """Line items as cards of the second catalog, flat; one row per id, one with a shop's key first."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    num = F.when(F.pmod(p, F.lit(6)) == 0, F.concat(F.lit("sp"), _s(F.pmod(p, F.lit(9))))).when(F.pmod(p, F.lit(7)) == 0, F.lit("t1")).otherwise(F.lpad(_s(F.pmod(p, F.lit(300))), 3, "0"))
    id_ = F.concat(F.when(F.pmod(p, F.lit(2)) == 0, "ogn-").otherwise("sfd-"), num, F.when(F.pmod(p, F.lit(5)) != 0, "-298").otherwise(""))
    card = F.struct(
        id_.alias("riftbound_id"), F.concat(F.lit("Card "), _s(F.pmod(p, F.lit(50)))).alias("name"), F.when(F.pmod(p, F.lit(3)) == 0, "Origins").alias("set"), F.when(F.pmod(p, F.lit(4)) == 0, "ogn").alias("set_id"), F.col("l_returnflag").alias("rarity"),
        F.lit(None).cast("string").alias("image_url"), F.when(F.pmod(k, F.lit(3)) == 0, _s(k)).alias("tcgplayer_id"), (F.pmod(p, F.lit(11)) == 0).alias("signature"), (F.pmod(p, F.lit(13)) == 0).alias("alternate_art"), F.when(F.pmod(p, F.lit(17)) == 0, True).alias("overnumbered"),
    )
    flat = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.rift_candidate(card, F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")).alias("c"))
    best = flat.withColumn("id", F.col("c.source_id")).groupBy("id").agg(F.min_by("c", F.struct((F.col("c.tcgplayer_id") == "").alias("without"), "l_orderkey", "l_linenumber", "l_partkey", F.col("c.year").alias("year"))).alias("c"))
    return best.select("id", "c.name", "c.number", "c.variant", "c.set_name", "c.set_code", "c.year", "c.tcgplayer_id")


def identify_scores(spark, sf_dir):
    """Scores of looked-up cards, moved by the typed name and total."""
    k = F.col("p_partkey")
    base = F.get(F.array(*[F.lit(x) for x in (0.9, 0.95, 0.6, 0.65, 0.3, 0.4)]), F.pmod(k, F.lit(6)).cast("int"))
    typed = F.when(F.pmod(k, F.lit(5)) == 0, F.get(F.split("p_name", " "), 0)).when(F.pmod(k, F.lit(7)) == 0, "other").when(F.pmod(k, F.lit(11)) == 0, "").otherwise(F.upper("p_name"))
    total = F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(3)) + 100).cast("double")
    number = F.concat(_s(k), F.when(F.pmod(k, F.lit(3)) == 0, " / 100").when(F.pmod(k, F.lit(3)) == 1, "/100").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", L.identify_score(base, typed, number, F.col("p_name"), total).alias("score"))


def normal_forms(spark, sf_dir):
    """Normalised titles of conversations."""
    start = F.substring("text", 1, 60)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.upper_key(start).alias("upper_key"), X.loose(start).alias("loose"), X.plain_any(start).alias("plain"))


QUERIES = {
    "q_photo_gate": photo_gate, "q_blind_test": blind_test, "q_found_prices": found_prices, "q_split_histogram": split_histogram, "q_places": places, "q_durations": durations, "q_phash": phash,
    "q_rift_candidates": rift_candidates, "q_identify_score": identify_scores, "q_normal_forms": normal_forms,
}


def _gate_sql() -> str:
    zones = [f"floor(((l_partkey + {i} * l_orderkey) % 60) / 2500.0::DOUBLE * 1000 + 0.5) / 1000 >= 0.02 AS z{i}" for i in range(8)]
    corners = [f"(l_partkey * {i + 2} + l_orderkey) % 97 - 1.0::DOUBLE AS i{i}, ((l_orderkey + {i} * l_partkey) % 7) / 20.0::DOUBLE < 0.1 AS r{i}" for i in range(4)]
    items = []
    small = "CASE WHEN sharpness = 'fail' THEN 'sharpness' END"
    for i, item in enumerate(D.ITEMS):
        if item == "centering":
            why = ["CASE WHEN glare = 'fail' THEN 'glare' END", "CASE WHEN c IN ('frame', 'square', 'cut') THEN 'boundary' END", "CASE WHEN detection = 'fail' THEN 'detection' END"]
        elif item == "surface":
            why = [small, "CASE WHEN glare = 'fail' THEN 'glare' END", "CASE WHEN resolution = 'fail' THEN 'resolution' END"]
        else:
            j = i - 2
            at = f"c IN ('frame', 'square') OR (c = 'cut' AND (cut{j % 4} OR cut{(j + 1) % 4}))" if j < 4 else f"c = 'frame' OR (c = 'cut' AND cut{j - 4}) OR (c = 'tight' AND tight{j - 4}) OR (c IN ('square', 'squarish') AND sq{j - 4})"
            why = [small, f"CASE WHEN z{j} THEN 'glare' END", "CASE WHEN resolution <> 'ok' THEN 'resolution' END", f"CASE WHEN {at} THEN 'boundary' END", "CASE WHEN perspective = 'fail' THEN 'perspective' END", "CASE WHEN detection = 'fail' THEN 'detection' END"]
        items.append(f"CASE WHEN {' OR '.join(f'({w[10:].split(" THEN ")[0]})' for w in why)} THEN '{item}=' || concat_ws('+', {', '.join(why)}) END")
    return f"""
WITH a AS (SELECT *, CASE WHEN l_orderkey % 19 <> 0 THEN floor((l_partkey % 25) / 10.0::DOUBLE * 100 + 0.5) / 100 END AS blur, (l_orderkey % 40) / 200.0::DOUBLE AS g, {", ".join(zones)}, floor(l_partkey % 900 + 250.4 + 0.5) AS px, {", ".join(corners)},
    l_orderkey % 31 < 2 AS frame, l_orderkey % 31 = 0 AS cropped, (l_orderkey % 50) / 250.0::DOUBLE AS key, (l_partkey % 33) / 300.0::DOUBLE AS asp, (l_orderkey % 23) / 2.0::DOUBLE AS ang, CASE WHEN l_partkey % 41 <> 0 THEN (l_partkey % 20) / 20.0::DOUBLE + 0.1 ELSE 0 END AS det FROM lineitem),
b AS (SELECT *, {", ".join(f"i{i} < 2 AS cut{i}, i{i} >= 2 AND i{i} < 12 AS tight{i}, NOT frame AND r{i} AS sq{i}" for i in range(4))} FROM a),
c AS (SELECT *, CASE WHEN cropped THEN 'cropped' WHEN frame THEN 'frame' WHEN cut0 OR cut1 OR cut2 OR cut3 THEN 'cut' WHEN tight0 OR tight1 OR tight2 OR tight3 THEN 'tight' WHEN sq0::INT + sq1::INT + sq2::INT + sq3::INT >= 3 THEN 'square'
    WHEN sq0::INT + sq1::INT + sq2::INT + sq3::INT = 2 THEN 'squarish' ELSE 'ok' END AS c FROM b),
d AS (SELECT *, CASE WHEN blur IS NULL THEN 'warn' WHEN blur <= floor(11.9::DOUBLE * 0.1092::DOUBLE * 100 + 0.5) / 100 THEN 'ok' WHEN blur <= floor(11.9::DOUBLE * 0.168::DOUBLE * 100 + 0.5) / 100 THEN 'warn' ELSE 'fail' END AS sharpness,
    CASE WHEN g >= 0.15 THEN 'fail' WHEN g >= 0.01 OR {" OR ".join(f"z{i}" for i in range(8))} THEN 'warn' ELSE 'ok' END AS glare, CASE WHEN px < 350 THEN 'fail' WHEN px < 600 THEN 'warn' ELSE 'ok' END AS resolution,
    CASE WHEN c IN ('frame', 'cut', 'square') THEN 'fail' WHEN c = 'ok' THEN 'ok' ELSE 'warn' END AS boundary, CASE WHEN frame THEN 'ok' WHEN key > 0.15 OR asp > 0.08 THEN 'fail' WHEN key > 0.06 OR asp > 0.04 OR ang > 8 THEN 'warn' ELSE 'ok' END AS perspective,
    CASE WHEN det < 0.5 THEN 'fail' WHEN det < 0.7 THEN 'warn' ELSE 'ok' END AS detection, CASE WHEN l_partkey % 5 = 0 THEN 'warn' ELSE 'ok' END AS sleeve FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, sharpness, glare, resolution, boundary, perspective, detection, sleeve, concat_ws(',', {", ".join(items)}) AS blocked,
  CASE WHEN 'fail' IN (sharpness, glare, resolution, boundary, perspective, detection) THEN 'rescan' WHEN 'warn' IN (sharpness, glare, resolution, boundary, perspective, detection, sleeve) THEN 'warn' ELSE 'ok' END AS verdict FROM d"""


_RANK = "(rank() OVER (PARTITION BY set ORDER BY {c}) + (count(*) OVER (PARTITION BY set, {c}) - 1) / 2.0)::DOUBLE"
_WAVE = "list_sum(list_transform(range(32), lambda i: h[i + 1] * cos(pi() * (2 * i + 1) * u / 64) * CASE WHEN u = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) END))"
ORACLE_SQL = {
    "q_photo_gate": _gate_sql(),
    "q_blind_test": f"""
WITH k AS (SELECT r AS round, o_orderkey, o_orderpriority AS set, CASE WHEN o_orderkey % 2 = 0 THEN 'TAG' ELSE 'PSA' END AS company, (o_orderkey % 19) / 2.0 + 1 AS truth, (o_custkey + 1 + CASE WHEN r = 'B' THEN 3 ELSE 0 END) % 20 / 2.0 + 1 AS p FROM orders, (VALUES ('A'), ('B')) v(r) WHERE o_orderkey % 5 <> 0),
a AS (SELECT set, truth, CASE WHEN company = 'TAG' THEN least(p, 10) ELSE p END AS pred FROM k), r AS (SELECT *, {_RANK.format(c="truth")} AS x, {_RANK.format(c="pred")} AS y FROM a)
SELECT set, count(*) AS n, count(*) FILTER (WHERE abs(pred - truth) < 0.01) AS exact, count(*) FILTER (WHERE abs(pred - truth) <= 0.5) AS within_05, count(*) FILTER (WHERE abs(pred - truth) <= 1) AS within_1, avg(abs(pred - truth)) AS mae, avg(pred - truth) AS bias,
  CASE WHEN count(*) > 2 THEN corr(x, y) END AS spearman FROM r GROUP BY set""",
    "q_found_prices": """
WITH l AS (SELECT p_partkey::VARCHAR AS id, upper(p_brand) AS set, (p_partkey % 60)::VARCHAR || '/150' AS num, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' foil' ELSE '' END AS nm, lower(p_name) AS bare, p_partkey % 3 = 0 AS marked FROM part),
i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey + 7)::VARCHAR END AS id, CASE WHEN p_partkey % 7 <> 0 THEN upper(p_brand) ELSE '' END AS set, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 61)::VARCHAR || '/150' ELSE '' END AS num, lower(p_name) AS nm FROM part),
x AS (SELECT item, l.id, 'id' AS how, contains(l.nm, i.nm) OR contains(i.nm, bare) OR starts_with(l.nm, split_part(i.nm, ' ', 1)) AS name_matches, 0::BIGINT AS others FROM i JOIN l ON l.id = i.id),
h AS (SELECT item, l.id, contains(l.nm, i.nm) OR contains(i.nm, bare) OR starts_with(l.nm, split_part(i.nm, ' ', 1)) AS ok, marked FROM i JOIN l ON l.num = i.num AND (i.set = '' OR i.set = l.set) WHERE i.num <> '' AND item NOT IN (SELECT item FROM x)),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY NOT ok, marked, id) AS r, count(*) OVER (PARTITION BY item) - 1 AS others FROM h)
SELECT * FROM x UNION ALL SELECT item, id, 'number', ok, others FROM r WHERE r = 1""",
    "q_split_histogram": """
WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'dev-check' ELSE 'dev-tune' END AS split, lang || '|' || source AS k, CASE WHEN n_chars % 13 <> 0 THEN ((n_chars % 19) / 2.0 + 1)::DOUBLE END AS grade FROM documents WHERE doc_id % 9 <> 0),
g AS (SELECT split, grade, count(*) AS n FROM d GROUP BY ALL)
SELECT split, count(*) AS certs, count(DISTINCT k) AS groups, (SELECT string_agg(coalesce(grade::VARCHAR, 'None') || '=' || n, ',' ORDER BY coalesce(grade, -1)) FROM g WHERE g.split = d.split) AS grades FROM d GROUP BY split""",
    "q_places": """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'top_left,top_right,bottom_left,bottom_right' END, CASE WHEN p_partkey % 5 = 0 THEN 'top,bottom,left,right' END, CASE WHEN p_partkey % 2 = 0 THEN 'surface' END) AS locations,
      ((p_partkey % 19) / 2.0 + 1)::DOUBLE AS centering, CASE WHEN p_partkey % 4 <> 0 THEN ((p_partkey % 17) / 2.0 + 1)::DOUBLE END AS corners, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_size::VARCHAR END AS size, '' AS none FROM part""",
    "q_durations": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN floor((o_orderkey * 37 % 86000) / 6.0 + 0.5) / 10 END AS minutes FROM orders",
    "q_phash": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64), s AS (SELECT vec_id, u, {_WAVE.replace("h[i + 1]", "e[i + 1]")} AS a, {_WAVE.replace("h[i + 1]", "e[i + 33]")} AS b FROM e, range(8) r(u)),
c AS (SELECT x.vec_id, 8 * x.u + y.u AS at, x.a * y.b AS c FROM s x JOIN s y ON x.vec_id = y.vec_id), m AS (SELECT vec_id, median(c) AS m FROM c GROUP BY vec_id)
SELECT vec_id, sum(CASE WHEN c > m THEN CASE WHEN at = 0 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (63 - at)::INT END ELSE 0 END)::BIGINT AS phash FROM c JOIN m USING (vec_id) GROUP BY vec_id""".replace(" at,", ' "at",').replace("at = 0", '"at" = 0').replace("63 - at", '63 - "at"'),
    "q_rift_candidates": """
WITH c AS (SELECT *, CASE WHEN l_partkey % 6 = 0 THEN 'sp' || (l_partkey % 9) WHEN l_partkey % 7 = 0 THEN 't1' ELSE lpad((l_partkey % 300)::VARCHAR, 3, '0') END AS num, CASE WHEN l_partkey % 2 = 0 THEN 'ogn' ELSE 'sfd' END AS st, CASE WHEN l_partkey % 5 <> 0 THEN '298' ELSE '' END AS tot,
    CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey::VARCHAR ELSE '' END AS tcg FROM lineitem),
r AS (SELECT *, st || '-' || num || CASE WHEN tot <> '' THEN '-' || tot ELSE '' END AS id FROM c)
SELECT id, 'Card ' || (l_partkey % 50) AS name, upper(num) || CASE WHEN tot <> '' AND (starts_with(num, 'sp') OR regexp_matches(num, '^[0-9]')) THEN '/' || tot ELSE '' END AS number,
  CASE WHEN l_partkey % 11 = 0 THEN 'Signature' WHEN l_partkey % 13 = 0 THEN 'Alternate Art' WHEN l_partkey % 17 = 0 THEN 'Overnumbered' ELSE 'Standard' END AS variant, CASE WHEN l_partkey % 3 = 0 THEN 'Origins' ELSE '' END AS set_name,
  upper(CASE WHEN l_partkey % 4 = 0 THEN 'ogn' ELSE st END) AS set_code, year(l_shipdate)::INT AS year, tcg AS tcgplayer_id
FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY tcg = '', l_orderkey, l_linenumber, l_partkey, year(l_shipdate)) = 1""",
    "q_identify_score": """
WITH p AS (SELECT p_partkey, [0.9, 0.95, 0.6, 0.65, 0.3, 0.4][p_partkey % 6 + 1]::DOUBLE AS base, lower(p_name) AS nm, CASE WHEN p_partkey % 5 = 0 THEN lower(split_part(p_name, ' ', 1)) WHEN p_partkey % 7 = 0 THEN 'other' WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_name) END AS typed,
    CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 + 100 END AS total, CASE WHEN p_partkey % 3 <> 2 THEN 100 END AS printed FROM part), q AS (SELECT *, CASE WHEN base >= 0.85 THEN 0.05 ELSE 0.2 END::DOUBLE AS plus FROM p)
SELECT p_partkey, floor(greatest(0, least(1, base + CASE WHEN typed = '' THEN 0 WHEN contains(nm, typed) OR contains(typed, nm) THEN plus ELSE -0.4 END::DOUBLE + CASE WHEN printed IS NULL OR total IS NULL THEN 0 WHEN printed = total THEN plus ELSE -0.15 END::DOUBLE)) * 100 + 0.5) / 100 AS score FROM q""",
    "q_normal_forms": r"""SELECT conv_id, turn, upper(replace(trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')), 'ß', 'ss')) AS upper_key, trim(regexp_replace(lower(substr(text, 1, 60)), '[^\p{L}\p{N}_'']+', ' ', 'g')) AS loose, trim(regexp_replace(lower(strip_accents(substr(text, 1, 60))), '[^a-z0-9]+', ' ', 'g')) AS plain FROM conversations""",
}
