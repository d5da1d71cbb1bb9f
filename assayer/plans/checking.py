"""Queries of the photo-check rules over measurements derived from the star schema, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.tables import table
from assayer.operators import checks as K


def _mod(k: str, n: int):
    return F.pmod(F.col(k), F.lit(n))


def photo_verdict(spark, sf_dir):
    values = {"sharpness": _mod("o_orderkey", 23) / 100, "glare": _mod("o_orderkey", 19) / 100, "resolution": _mod("o_orderkey", 31) * 40.0, "perspective": _mod("o_orderkey", 17) / 100, "detection": _mod("o_orderkey", 29) / 28}
    df = table(spark, sf_dir, "orders").select("o_orderkey", *[K.measured_status(n, v).alias(n) for n, v in values.items()])
    return df.select("o_orderkey", K.verdict(*map(F.col, values)).alias("verdict"), F.concat_ws(",", *values).alias("statuses"))


def severity_sizes(spark, sf_dir):
    s = K.severity_from_size(F.col("l_quantity") / 3, F.col("l_discount") * 12)
    return table(spark, sf_dir, "lineitem").select(s.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def _status(k: str, n: int):
    return F.get(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), (_mod(k, n) % 3).cast("int"))


def _levels(df):
    o = K.outline_level(_status("o_orderkey", 7), _status("o_orderkey", 11), _status("o_orderkey", 5), _mod("o_orderkey", 4) == 0)
    e = lambda n: F.get(F.array(F.lit("measured"), F.lit("typed"), F.lit("unread")), _mod("o_orderkey", n).cast("int"))
    c = K.centering_level(_mod("o_orderkey", 13) == 0, [(e(3), _mod("o_orderkey", 10) / 10, _mod("o_orderkey", 8) / 8), (e(2), _mod("o_orderkey", 6) / 6, _mod("o_orderkey", 9) / 9)])
    lost = F.when(_mod("o_orderkey", 14) != 0, _mod("o_orderkey", 9))
    ce = K.corners_edges_level(_status("o_orderkey", 6), _status("o_orderkey", 12), lost, _mod("o_orderkey", 5) == 1)
    s = K.surface_level(_mod("o_orderkey", 16) == 3, _mod("o_orderkey", 2) == 1, _status("o_orderkey", 9), _status("o_orderkey", 12), _status("o_orderkey", 6))
    df = df.select("o_orderkey", "o_custkey", o.alias("outline"), c.alias("centering"), ce.alias("ce"), s.alias("surface"))
    both = K.overall(F.col("outline"), F.col("centering"), F.col("ce"), F.col("surface"), _mod("o_orderkey", 2) == 0, _mod("o_orderkey", 3) == 0)
    return df.withColumn("x", both).select("o_orderkey", "o_custkey", "outline", "centering", "ce", "surface", F.col("x.level").alias("level"), F.array_join("x.rules", ",").alias("rules"))


def confidence(spark, sf_dir):
    return _levels(table(spark, sf_dir, "orders")).drop("o_custkey")


def faces(spark, sf_dir):
    df = _levels(table(spark, sf_dir, "orders"))
    face = F.concat(F.lit("f"), _mod("o_orderkey", 2).cast("string"))
    state = F.when(_mod("o_orderkey", 15) == 0, "not_scanned").when(_mod("o_orderkey", 15) == 1, "assessing").otherwise("assessed")
    out = K.combined(df.select("o_custkey", face.alias("face"), "level", state.alias("state")), "o_custkey", "face", "level", "state")
    return out.select("o_custkey", "level", F.array_join("missing", ",").alias("missing"), F.array_join("pending", ",").alias("pending"))


def steps(spark, sf_dir):
    scan = K.scan_status([_status("o_orderkey", 9)], _mod("o_orderkey", 17))
    cent = K.centering_status(F.array((_mod("o_orderkey", 9) - 4).cast("double"), (_mod("o_orderkey", 15) - 7).cast("double")), _mod("o_orderkey", 12) == 0)
    ident = K.identify_status(_mod("o_orderkey", 4) > 0, _mod("o_orderkey", 8) == 0, _mod("o_orderkey", 12) == 0)
    grade = K.grade_status(_mod("o_orderkey", 20) / 2, _mod("o_orderkey", 7).cast("double"), _mod("o_orderkey", 10))
    df = table(spark, sf_dir, "orders").select("o_orderkey", scan.alias("scan"), cent.alias("centering"), ident.alias("identify"), grade.alias("grade"))
    return df.withColumn("status", K.run_status(F.array("scan", "centering", "identify", "grade")))


def pending(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card"), F.when(_mod("l_suppkey", 2) == 0, "front").otherwise("back").alias("side"), (_mod("l_partkey", 4)).cast("string").alias("location"), F.lit("dent").alias("type"), F.col("l_returnflag").alias("severity"), "l_linenumber")
    part = lambda n: item.where(F.col("l_linenumber") == n).drop("l_linenumber")
    out = K.pending_flags(item.where("l_linenumber > 2").drop("l_linenumber"), part(1), part(2), "card")
    return out.groupBy("card").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"q_photo_verdict": photo_verdict, "q_severity_size": severity_sizes, "q_confidence": confidence, "q_faces_combined": faces, "q_step_status": steps, "q_pending_flags": pending}

_S = "['ok','warn','fail'][((o_orderkey % {0}) % 3) + 1]"
_LEVELS = f"""
a AS (SELECT o_orderkey, o_custkey, {_S.format(7)} AS bo, CASE WHEN o_orderkey % 4 = 0 THEN 'ok' ELSE {_S.format(11)} END AS de, {_S.format(5)} AS pe, {_S.format(6)} AS re, {_S.format(12)} AS sh, {_S.format(9)} AS gl FROM orders),
b AS (SELECT *, CASE WHEN bo = 'fail' OR de = 'fail' THEN 0 WHEN pe = 'fail' THEN 1 WHEN 'warn' IN (pe, bo, de) THEN 2 ELSE 3 END AS outline,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN least((o_orderkey % 10) / 10.0, (o_orderkey % 8) / 8.0) >= 0.6 THEN 3 WHEN least((o_orderkey % 10) / 10.0, (o_orderkey % 8) / 8.0) >= 0.3 THEN 2 ELSE 1 END END AS lr,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN least((o_orderkey % 6) / 6.0, (o_orderkey % 9) / 9.0) >= 0.6 THEN 3 WHEN least((o_orderkey % 6) / 6.0, (o_orderkey % 9) / 9.0) >= 0.3 THEN 2 ELSE 1 END END AS tb,
  CASE WHEN re = 'fail' OR sh = 'fail' OR o_orderkey % 14 = 0 OR o_orderkey % 9 = 8 THEN 0 ELSE least(CASE WHEN o_orderkey % 9 = 0 THEN 3 WHEN o_orderkey % 9 <= 2 THEN 2 ELSE 1 END, CASE WHEN re = 'warn' OR sh = 'warn' OR o_orderkey % 5 = 1 THEN 2 ELSE 3 END) END AS ce,
  CASE WHEN o_orderkey % 16 = 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 WHEN 'warn' IN (gl, sh, re) THEN 2 ELSE 3 END AS surface FROM a),
c AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE coalesce(least(lr, tb), 0) END AS centering FROM b),
d AS (SELECT *, list_min(list_filter([outline, centering, ce], lambda x: x > 0)) AS l0 FROM c),
e AS (SELECT *, ce = 0 AND o_orderkey % 3 = 0 AND l0 > 1 AS f1 FROM d), f AS (SELECT *, CASE WHEN f1 THEN 1 ELSE l0 END AS l1 FROM e), g AS (SELECT *, surface = 0 AND l1 > 1 AS f2 FROM f),
lv AS (SELECT o_orderkey, o_custkey, outline, centering, ce, surface, CASE WHEN outline = 0 OR (centering = 0 AND ce = 0) THEN 0 ELSE least(CASE WHEN f2 THEN 1 ELSE l1 END, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END) END AS level,
  CASE WHEN outline = 0 THEN 'R_OUTLINE' WHEN centering = 0 AND ce = 0 THEN 'R_NOTHING' ELSE 'R_WEAKEST' || CASE WHEN f1 THEN ',R_CE_FAIL' ELSE '' END || CASE WHEN f2 THEN ',R_SURFACE_FAIL' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',R_FLAT' ELSE '' END END AS rules FROM g)"""
ORACLE_SQL = {
    "q_photo_verdict": """WITH v AS (SELECT o_orderkey, [CASE WHEN (o_orderkey % 23) / 100.0::DOUBLE > 0.168 THEN 'fail' WHEN (o_orderkey % 23) / 100.0::DOUBLE > 0.1092 THEN 'warn' ELSE 'ok' END, CASE WHEN (o_orderkey % 19) / 100.0::DOUBLE > 0.15::DOUBLE THEN 'fail' WHEN (o_orderkey % 19) / 100.0::DOUBLE > 0.01::DOUBLE THEN 'warn' ELSE 'ok' END,
      CASE WHEN (o_orderkey % 31) * 40 < 350 THEN 'fail' WHEN (o_orderkey % 31) * 40 < 600 THEN 'warn' ELSE 'ok' END, CASE WHEN (o_orderkey % 17) / 100.0::DOUBLE > 0.15::DOUBLE THEN 'fail' WHEN (o_orderkey % 17) / 100.0::DOUBLE > 0.06::DOUBLE THEN 'warn' ELSE 'ok' END,
      CASE WHEN (o_orderkey % 29) / 28.0::DOUBLE < 0.5 THEN 'fail' WHEN (o_orderkey % 29) / 28.0::DOUBLE < 0.7::DOUBLE THEN 'warn' ELSE 'ok' END] AS s FROM orders)
      SELECT o_orderkey, CASE WHEN list_contains(s, 'fail') THEN 'rescan' WHEN list_contains(s, 'warn') THEN 'warn' ELSE 'ok' END AS verdict, array_to_string(s, ',') AS statuses FROM v""",
    "q_severity_size": "SELECT CASE WHEN l_quantity / 3 >= 15 OR l_discount * 12 >= 1 THEN 'major' WHEN l_quantity / 3 >= 5 OR l_discount * 12 >= 0.6::DOUBLE THEN 'moderate' WHEN l_quantity / 3 >= 1.5 OR l_discount * 12 >= 0.35::DOUBLE THEN 'minor' ELSE 'micro' END AS severity, count(*) AS n FROM lineitem GROUP BY 1",
    "q_confidence": f"WITH {_LEVELS} SELECT o_orderkey, outline, centering, ce, surface, level, rules FROM lv",
    "q_faces_combined": f"WITH {_LEVELS}, s AS (SELECT *, 'f' || (o_orderkey % 2) AS face, CASE o_orderkey % 15 WHEN 0 THEN 'n' WHEN 1 THEN 'p' ELSE 'a' END AS st FROM lv) SELECT o_custkey, min(level) FILTER (WHERE st = 'a') AS level, coalesce(string_agg(face, ',' ORDER BY face) FILTER (WHERE st = 'n'), '') AS missing, coalesce(string_agg(face, ',' ORDER BY face) FILTER (WHERE st = 'p'), '') AS pending FROM s GROUP BY o_custkey",
    "q_step_status": f"""WITH s AS (SELECT o_orderkey, CASE WHEN {_S.format(9)} = 'fail' THEN 'fail' WHEN 16 - o_orderkey % 17 < 8 THEN 'warn' ELSE 'pass' END AS scan, CASE WHEN greatest(abs(o_orderkey % 9 - 4), abs(o_orderkey % 15 - 7)) > 6 THEN 'fail' WHEN greatest(abs(o_orderkey % 9 - 4), abs(o_orderkey % 15 - 7)) > 3 OR o_orderkey % 12 = 0 THEN 'warn' ELSE 'pass' END AS centering,
      CASE WHEN o_orderkey % 4 > 0 THEN 'pass' WHEN o_orderkey % 8 = 0 OR o_orderkey % 12 = 0 THEN 'warn' ELSE 'fail' END AS identify, CASE WHEN (o_orderkey % 20) / 2.0 < o_orderkey % 7 THEN 'fail' WHEN o_orderkey % 10 = 0 OR (o_orderkey % 20) / 2.0 - o_orderkey % 7 > 1 THEN 'warn' ELSE 'pass' END AS grade FROM orders)
      SELECT *, CASE WHEN 'fail' IN (scan, centering, identify, grade) THEN 'fail' WHEN 'warn' IN (scan, centering, identify, grade) THEN 'warn' ELSE 'pass' END AS status FROM s""",
    "q_pending_flags": "WITH i AS (SELECT l_orderkey AS card, l_suppkey % 2 AS side, l_partkey % 4 AS loc, l_returnflag AS sev, l_linenumber AS n FROM lineitem) SELECT card, count(*) AS n FROM i WHERE i.n > 2 AND NOT EXISTS (SELECT 1 FROM i a WHERE a.n = 1 AND a.card = i.card AND a.side = i.side AND a.loc = i.loc) AND NOT EXISTS (SELECT 1 FROM i d WHERE d.n = 2 AND d.card = i.card AND d.side = i.side AND d.loc = i.loc AND d.sev = i.sev) GROUP BY card",
}
