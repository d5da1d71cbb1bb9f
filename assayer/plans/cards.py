"""Queries of card identification, explanations, the record build and small statistics, with their oracles. The inputs
are columns of the star schema, and the oracles compute the operation from the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import reading as R
from assayer.functions import stats as S
from assayer.functions.tables import table
from assayer.operators import cards as K
from assayer.operators import evaluation as E
from assayer.operators import pricing as P
from assayer.operators import records as B


def col(sql):
    return F.expr(sql)


def has_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", col("if(o_orderkey % 7 = 0, double('nan'), if(o_orderkey % 11 = 0, null, double(o_totalprice)))").alias("g"), col("if(o_orderstatus = 'P', '', o_clerk)" if "o_clerk" in table(spark, d, "orders").columns else "if(o_orderstatus = 'P', '', o_orderstatus)").alias("n"), "o_orderpriority")
    return o.select("o_orderkey", B.has_report(F.col("g"), F.col("n")).cast("int").alias("has"))


def languages(spark, d):
    p = table(spark, d, "part").select("p_partkey", col("concat(p_type, if(p_size < 10, ' Japanese promo', ''))").alias("line"))
    return p.select("p_partkey", B.language_of(F.col("line")).alias("language"))


def prior_state(spark, d):
    now = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    before = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("width"), "lang")
    return B.with_prior(now, before, "sha", ["width", "lang"]).select("doc_id", "width", "lang")


def carried(spark, d):
    listed = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("pool"))
    recorded = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("store").alias("pool"))
    return B.carried_forward(listed, recorded, table(spark, d, "customer").where("c_nationkey = 3"), "c_custkey", "pool")


def byte_totals(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("recorded"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("on_disk"))


def key_sort(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "part").groupBy(col("if(p_size % 13 = 0, 'None', cast(p_size as string))").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(B.numeric_first(F.col("value")), "value")))  # one row a value


_PARTS = {"centering": 7, "corners": 5, "edges": 3, "surface": 11}


def _parts(name="value"):
    return F.array(*[F.struct(F.lit(n).alias("name"), col(f"(p_partkey * {k} % 22) / 2.0D").alias(name), col(f"if(p_partkey % {k} = 0, 'why {n}', '')").alias("detail")) for n, k in _PARTS.items()])


def binding(spark, d):
    overall = F.array_min(F.transform(_parts(), lambda p: p["value"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(K.binding_factors(overall, _parts(), 10.5, 0.5), " | ").alias("factors"))


def weakest(spark, d):
    areas = F.array(*[F.struct(F.lit(f"front {n}").alias("name"), col(f"double(400 + (p_partkey * {k * 37}) % 600)").alias("points"), col(f"if(p_partkey % {k} = 0, 'why', '')").alias("detail")) for n, k in _PARTS.items()])
    return table(spark, d, "part").select("p_partkey", F.array_join(K.weakest_areas(areas), " | ").alias("areas"))


def unread(spark, d):
    axes = F.array_compact(F.array(col("if(p_partkey % 2 = 0, 'front left/right', null)"), col("if(p_partkey % 3 = 0, 'back top/bottom', null)")))
    return table(spark, d, "part").select("p_partkey", K.unread_note(axes).alias("note"))


def defect_texts(spark, d):
    severity, component = col("element_at(array('micro', 'minor', 'major'), int(p_partkey % 3) + 1)"), col("if(p_partkey % 2 = 0, 'corners', 'edges')")
    place = col("if(p_partkey % 5 = 0, 'surface', if(p_partkey % 2 = 0, 'top_left', 'bottom'))")
    return table(spark, d, "part").select("p_partkey", K.defect_text(severity, F.col("p_name"), col("if(p_size > 25, 'front', 'back')"), component, place).alias("text"))


def caps(spark, d):
    rules = table(spark, d, "nation").select(F.col("n_name").alias("type"), col("element_at(array('micro', 'minor'), int(n_regionkey % 2) + 1)").alias("severity"), col("if(n_nationkey % 4 = 0, 'PSA', null)").alias("company"), col("double(n_nationkey)").alias("cap"))
    rules = rules.unionByName(rules.where("company is not null").withColumns({"company": F.lit(None).cast("string"), "cap": F.col("cap") + 100}))
    defects = table(spark, d, "customer").join(table(spark, d, "nation"), col("c_nationkey = n_nationkey")).select("c_custkey", F.col("n_name").alias("type"), col("if(c_custkey % 2 = 0, 'micro', 'minor')").alias("severity"))
    return K.with_caps(defects, rules, "psa").select("c_custkey", "cap")


def games(spark, d):
    g, code, number = col("if(p_partkey % 6 = 0, ' Pokemon TCG', if(p_partkey % 7 = 0, 'riftbound', null))"), col("if(p_partkey % 5 = 0, 'ven', p_brand)"), col("if(p_partkey % 4 = 0, 'sp3/006', '12/100')")
    return table(spark, d, "part").select("p_partkey", K.game_of(g, code, number).alias("game"))


def matches(spark, d):
    name, names = F.upper("p_name"), F.array(F.get(F.split("p_name", " "), 1), F.lit("zzz"))
    expected = col("if(p_partkey % 5 = 0, '', concat('00', string(p_partkey % 3)))")
    return table(spark, d, "part").select("p_partkey", K.name_matches(name, names).cast("int").alias("name_ok"), K.number_matches(col("concat(string(p_partkey % 4), '/9')"), expected).cast("int").alias("number_ok"))


def exact_total(spark, d):
    h = table(spark, d, "lineitem").select("l_orderkey", col("l_partkey * 10 + l_linenumber").alias("hit"), col("int(l_suppkey % 3)").alias("total"), col("int(l_orderkey % 3)").alias("wanted"))
    return K.exact_total_first(h, "l_orderkey", "total", "wanted", "hit", 3).select("l_orderkey", "hit", "place")


def listed(spark, d):
    c = table(spark, d, "events").select("user_id", "event_id", "value")
    return K.listed(c, "user_id", "value", "event_id").select("user_id", "event_id", "place", "total_matches", "not_shown")


def twice(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("card"), col("if(l_suppkey % 3 = 0, string(l_suppkey), null)").alias("shop"), col("l_orderkey * 10 + l_linenumber").alias("at"))
    return K.dedupe_listed_twice(c, "card", "shop", "at").select("card", "at")


def rift(spark, d):
    id_ = col("concat('OGN-', if(p_partkey % 3 = 0, 'sp', ''), string(p_partkey % 40), if(p_partkey % 5 = 0, 'a', ''), if(p_partkey % 4 = 0, '', '-298'))")
    return table(spark, d, "part").select("p_partkey", K.rift_number(id_).alias("number"), K.rift_number_matches(id_, F.lit("012/298")).cast("int").alias("matches"))


def sets_of_codes(spark, d):
    sets = table(spark, d, "nation").select(F.lower("n_name").alias("set_id"), F.substring("n_name", 1, 3).alias("abbreviation"))
    wanted = table(spark, d, "nation").select(col("if(n_nationkey % 2 = 0, n_name, lower(substring(n_name, 1, 3)))").alias("code"))
    return K.resolved_sets(wanted, sets)


def references(spark, d):
    url = col("if(page_id % 5 = 0, replace(url, 'http:', 'https:'), if(page_id % 5 = 1, concat('https://me@', string(page_id)), if(page_id % 5 = 2, 'x.png', url)))")
    return table(spark, d, "pages").select("page_id", F.coalesce(K.reference_problem(F.lit(None).cast("string"), F.lit(None).cast("bigint"), url), F.lit("ok")).alias("problem"))


def wanted(spark, d):
    grades = F.array(*[F.struct(F.lit(c).alias("company"), col(f"(p_partkey * {k} % 21) / 2.0D").alias("grade"), col(f"if(p_partkey % {k} = 0, 'Pristine', 'Mint')").alias("label"), col(f"if(p_partkey % 29 = {k}, 99, 1)").alias("tier")) for c, k in (("PSA", 3), ("CGC", 5), ("TAG", 7))])
    return table(spark, d, "part").select("p_partkey", F.array_join(P.wanted_grades(grades), ",").alias("grades"))


def ladder(spark, d):
    prices = F.map_from_arrays(F.array(F.lit("loose-price"), F.lit("graded-price"), F.lit("bgs-10-price")), F.array(F.col("p_retailprice"), F.col("p_retailprice") * 2, F.col("p_retailprice") * 3))
    return P.full_ladder(table(spark, d, "part").select("p_partkey", prices.alias("prices")), "p_partkey", "prices").select("p_partkey", "rung", "price")


def paired_auc(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "lang", "quality", "n_chars")
    arms = rows.select("doc_id", "lang", "quality", F.lit("x").alias("arm"), F.col("n_chars").alias("score"), col("doc_id % 7 <> 0").alias("able")).unionByName(rows.select("doc_id", "lang", "quality", F.lit("y").alias("arm"), col("n_chars * 7 % 101").alias("score"), col("doc_id % 5 <> 0").alias("able")))
    return E.paired_stats(E.paired(arms, ["doc_id", "lang", "quality"], "arm", "x", "y", "score", "able"), ["lang"], "quality")


def axes(spark, d):
    e = table(spark, d, "lineitem").select(col("if(l_suppkey % 2 = 0, 'front', 'back')").alias("side"), col("if(l_partkey % 2 = 0, 'lr', 'tb')").alias("axis"), col("if(l_linenumber = 3, null, double(l_quantity) / 8 - 3)").alias("error"))
    return E.axis_summary(e, ["side", "axis"], "error")


def defects(spark, d):
    c = table(spark, d, "orders").select(col("o_orderkey % 4").alias("listed"), col("o_custkey % 3").alias("matched"), col("o_orderkey % 5").alias("extra"), col("o_custkey % 6").alias("flags"))
    return E.defect_summary(c, "listed", "matched", "extra", "flags")


def deviations(spark, d):
    return S.median_deviation(table(spark, d, "orders").select("o_orderpriority", col("double(o_totalprice)").alias("v")), ["o_orderpriority"], "v")


def percentiles(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(col("double(o_totalprice)")).alias("v"))
    return a.select("o_custkey", S.percentile_of(F.col("v"), 90).alias("p90"), S.upper_middle(F.col("v")).alias("middle"))


def lines(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", col("double(l_linenumber)").alias("x"), col("double(l_quantity)").alias("y"))
    out = S.fitted_line(p, ["l_suppkey"], "x", "y")
    return out.select("l_suppkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def densest(spark, d):
    return S.densest_window(table(spark, d, "orders").select("o_custkey", col("double(o_totalprice)").alias("v")), ["o_custkey"], "v", 20000.0)


def erfs(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.erf(F.col("value") / 50 - 1), 9).alias("erf"))


def first_answers(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", col("length(text) % 7").alias("q"), col("length(text) % 5 = 0").alias("found"))
    return K.first_answer(t, "conv_id", "turn", "q", F.col("found"))


def memory(spark, d):
    e = table(spark, d, "events").select("user_id", R.lookup_key(F.col("event_type"), F.lit(" A"), F.lit(None).cast("string"), F.lit("x"), F.lit("EN")).alias("key"), "event_id")
    return K.asked_once(e, "user_id", "key", "event_id")


def jobs(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts", col("ts + make_dt_interval(0, 0, 0, event_id % 40)").alias("done"))
    return K.timed_out(e, "event_type", "ts", "done", {"error": 20, "purchase": 8, "click": 5, "view": 30, "signup": 12}).select("event_id", "ended_us", F.col("stopped").cast("int").alias("stopped"))


QUERIES = {
    "q_has_report": has_report, "q_language": languages, "q_prior_state": prior_state, "q_carry_forward": carried, "q_byte_totals": byte_totals, "q_numeric_keys": key_sort, "q_binding_factors": binding,
    "q_weakest_areas": weakest, "q_unread_note": unread, "q_defect_text": defect_texts, "q_rule_caps": caps, "q_game": games, "q_name_number_match": matches, "q_exact_total_first": exact_total,
    "q_listed_candidates": listed, "q_listed_twice": twice, "q_rift_numbers": rift, "q_set_codes": sets_of_codes, "q_reference_problem": references, "q_wanted_grades": wanted, "q_full_ladder": ladder,
    "q_paired_auc": paired_auc, "q_axis_summary": axes, "q_defect_summary": defects, "q_median_deviation": deviations, "q_percentiles": percentiles, "q_fitted_lines": lines, "q_densest_window": densest,
    "q_erf": erfs, "q_first_answer": first_answers, "q_request_memory": memory, "q_job_timeouts": jobs,
}

_SHOW = "CASE WHEN v >= 10.5 THEN '10 (Pristine)' ELSE regexp_replace(v::VARCHAR, '\\.0$', '') END"
_PART_ROWS = " UNION ALL ".join(f"SELECT p_partkey, {i} AS i, '{n}' AS n, (p_partkey * {k} % 22) / 2.0 AS v, CASE WHEN p_partkey % {k} = 0 THEN ': why {n}' ELSE '' END AS d FROM part" for i, (n, k) in enumerate(_PARTS.items()))
_AREA_ROWS = " UNION ALL ".join(f"SELECT p_partkey, {i} AS i, 'Front {n}' AS n, 400 + (p_partkey * {k * 37}) % 600 AS v, CASE WHEN p_partkey % {k} = 0 THEN ': why' ELSE '' END AS d FROM part" for i, (n, k) in enumerate(_PARTS.items()))
_WANTED_ROWS = " UNION ALL ".join(
    f"SELECT p_partkey, {i} AS i, CASE WHEN p_partkey % 29 = {k} OR g < 1 THEN NULL WHEN '{c}' <> 'PSA' AND g >= 10 AND p_partkey % {k} = 0 THEN '{c} Pristine 10' ELSE '{c} ' || regexp_replace(g::VARCHAR, '\\.0$', '') END AS s FROM (SELECT p_partkey, ((p_partkey * {k} % 21) / 2.0)::DOUBLE AS g FROM part)"
    for i, (c, k) in enumerate((("PSA", 3), ("CGC", 5), ("TAG", 7)), 1)
)
_PAIRED_AUC = """(SELECT lang, sum(pos * (before + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT lang, {s} AS s, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality <> 1) AS neg FROM p GROUP BY ALL)) GROUP BY lang)"""
_PAIRED_RECALL = """(SELECT lang, arg_min(tp::DOUBLE / np, t) FILTER (WHERE np > 0 AND nn > 0 AND fp::DOUBLE / nn <= 0.10) AS recall FROM (
  SELECT th.lang, t, count(*) FILTER (WHERE quality = 1 AND {s} > t) AS tp, count(*) FILTER (WHERE quality <> 1 AND {s} > t) AS fp, count(*) FILTER (WHERE quality = 1) AS np, count(*) FILTER (WHERE quality <> 1) AS nn
  FROM (SELECT DISTINCT lang, {s} AS t FROM p UNION SELECT DISTINCT lang, 0 FROM p) th JOIN p ON p.lang = th.lang GROUP BY ALL) GROUP BY lang)"""
_FIT = "SELECT l_suppkey, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS a FROM {0} GROUP BY l_suppkey HAVING count(*) >= 2 AND abs(count(*) * sum(x * x) - sum(x) * sum(x)) >= 1e-9"


def _fit_sql(points: str, name: str) -> str:
    return f"{name}a AS ({_FIT.format(points)}), {name} AS (SELECT p.l_suppkey, any_value(a) AS a, (sum(y) - any_value(a) * sum(x)) / count(*) AS b FROM {points} p JOIN {name}a USING (l_suppkey) GROUP BY p.l_suppkey)"


def _near_sql(line: str, name: str) -> str:
    return f"{name}r AS (SELECT p.*, abs(y - (a * x + b)) AS r FROM p JOIN {line} USING (l_suppkey)), {name} AS (SELECT * FROM (SELECT *, greatest(1.0, 2.5 * median(r) OVER (PARTITION BY l_suppkey)) AS lim FROM {name}r) WHERE r <= lim)"


ORACLE_SQL = {
    "q_has_report": "SELECT o_orderkey, (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_totalprice IS NOT NULL AND o_orderstatus <> 'P')::INT AS has FROM orders",
    "q_language": "SELECT p_partkey, CASE WHEN contains(upper(p_type), 'JAPANESE') OR p_size < 10 THEN 'japanese' ELSE 'english' END AS language FROM part",
    "q_prior_state": "WITH k AS (SELECT sha256(text) AS sha, min(struct_pack(w := n_chars, l := lang)) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, m.w AS width, m.l AS lang FROM documents LEFT JOIN k ON sha = sha256(text)",
    "q_carry_forward": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'store' END AS pool, CASE WHEN c_acctbal > 0 THEN 'listed' ELSE 'recorded' END AS origin FROM customer WHERE (c_acctbal > 0 OR c_custkey % 3 = 0) AND c_nationkey <> 3",
    "q_byte_totals": "SELECT lang, sum(coalesce(n_chars, 0))::BIGINT AS recorded, sum(coalesce(strlen(text), 0))::BIGINT AS on_disk FROM documents GROUP BY lang",
    "q_numeric_keys": "SELECT *, row_number() OVER (ORDER BY coalesce(try_cast(value AS DOUBLE), -1), value) AS place FROM (SELECT CASE WHEN p_size % 13 = 0 THEN 'None' ELSE p_size::VARCHAR END AS value, count(*) AS n FROM part GROUP BY 1)",
    "q_binding_factors": f"SELECT p_partkey, string_agg(upper(n[1]) || n[2:] || ' ' || {_SHOW} || d, ' | ' ORDER BY v, i) AS factors FROM (SELECT *, min(v) OVER (PARTITION BY p_partkey) AS o FROM (SELECT p_partkey, i, n, v::DOUBLE AS v, d FROM ({_PART_ROWS}))) WHERE v <= o + 0.5 GROUP BY p_partkey",
    "q_weakest_areas": f"SELECT p_partkey, coalesce(string_agg(n || ' ' || v || ' pts' || d, ' | ' ORDER BY v, i) FILTER (WHERE k <= 3 AND v < 990), '') AS areas FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY v, i) AS k FROM ({_AREA_ROWS})) GROUP BY p_partkey",
    "q_unread_note": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'Centering wasn''t measured (' || concat_ws(', ', CASE WHEN p_partkey % 2 = 0 THEN 'front left/right' END, CASE WHEN p_partkey % 3 = 0 THEN 'back top/bottom' END) || '), so it counts as 55/45, just making Gem Mint. That''s this lab''s convention, not a grading company''s rule.' END AS note FROM part",
    "q_defect_text": "SELECT p_partkey, ['micro','minor','major'][p_partkey % 3 + 1] || ' ' || lower(p_name) || ' (' || CASE WHEN p_size > 25 THEN 'front' ELSE 'back' END || CASE WHEN p_partkey % 5 = 0 THEN ' surface' WHEN p_partkey % 2 = 0 THEN ' top left corner' ELSE ' bottom edge' END || ')' AS text FROM part",
    "q_rule_caps": "SELECT c_custkey, CASE WHEN (n_regionkey % 2 = 0) = (c_custkey % 2 = 0) THEN n_nationkey::DOUBLE END AS cap FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "q_game": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'pokemon' WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 4 = 0 THEN 'riftbound' ELSE 'pokemon' END AS game FROM part",
    "q_name_number_match": "SELECT p_partkey, (split_part(p_name, ' ', 2) <> '' AND contains(lower(p_name), lower(split_part(p_name, ' ', 2))))::INT AS name_ok, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 4 = p_partkey % 3)::INT END AS number_ok FROM part",
    "q_exact_total_first": "SELECT * FROM (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3 <> l_orderkey % 3, l_partkey * 10 + l_linenumber)::INT AS place FROM lineitem) WHERE place <= 3",
    "q_listed_candidates": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place, count(*) OVER (PARTITION BY user_id) AS total_matches, greatest(0, count(*) OVER (PARTITION BY user_id) - 8) AS not_shown FROM events) WHERE place <= 8",
    "q_listed_twice": "SELECT l_partkey AS card, coalesce(min(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_suppkey % 3 = 0), min(l_orderkey * 10 + l_linenumber)) AS at FROM lineitem GROUP BY l_partkey",
    "q_rift_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'SP' ELSE '' END || (p_partkey % 40) || CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/298' END AS number, (p_partkey % 3 <> 0 AND p_partkey % 40 = 12)::INT AS matches FROM part",
    "q_set_codes": """WITH s AS (SELECT lower(n_name) AS set_id, upper(n_name[1:3]) AS ab FROM nation), w AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name[1:3]) END AS code FROM nation),
      a AS (SELECT DISTINCT code, set_id, 'id' AS via FROM w JOIN s ON set_id IN (code, lower(code))), h AS (SELECT code, set_id, ab, count(*) OVER (PARTITION BY code) AS n FROM (SELECT DISTINCT code FROM w WHERE code NOT IN (SELECT code FROM a)) JOIN s ON contains(ab, upper(code)))
      SELECT * FROM a UNION ALL SELECT code, set_id, 'abbreviation' FROM h WHERE n <= 4 AND ab = upper(code)""",
    "q_reference_problem": "SELECT page_id, CASE WHEN u = '' THEN 'missing' WHEN NOT regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+') THEN 'address' WHEN NOT regexp_matches(u, '^(?i)https://') THEN 'https' WHEN regexp_matches(u, '^(?i)https://[^/?#]*@') THEN 'login' ELSE 'ok' END AS problem FROM (SELECT page_id, trim(CASE page_id % 5 WHEN 0 THEN replace(url, 'http:', 'https:') WHEN 1 THEN 'https://me@' || page_id WHEN 2 THEN 'x.png' ELSE url END) AS u FROM pages)",
    "q_wanted_grades": f"SELECT p_partkey, string_agg(s, ',' ORDER BY i) AS grades FROM (SELECT p_partkey, s, min(i) AS i FROM (SELECT p_partkey, 0 AS i, 'Ungraded' AS s FROM part UNION ALL {_WANTED_ROWS} UNION ALL SELECT p_partkey, 8, 'PSA 10' FROM part UNION ALL SELECT p_partkey, 9, 'PSA 9' FROM part) WHERE s IS NOT NULL GROUP BY ALL) GROUP BY p_partkey",
    "q_full_ladder": "SELECT p_partkey, r::INT AS rung, CASE r WHEN 0 THEN p_retailprice WHEN 9 THEN p_retailprice * 2 WHEN 12 THEN p_retailprice * 3 END AS price FROM part, range(19) t(r)",
    "q_paired_auc": f"""WITH p AS (SELECT doc_id, lang, quality, n_chars AS a, n_chars * 7 % 101 AS b FROM labels JOIN documents USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)
      SELECT g.lang, areas, positive, clean, x.auc AS auc_a, y.auc AS auc_b, u.recall AS recall10_a, v.recall AS recall10_b FROM (SELECT lang, count(*) AS areas, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality <> 1) AS clean FROM p GROUP BY lang) g
      JOIN {_PAIRED_AUC.format(s="a")} x USING (lang) JOIN {_PAIRED_AUC.format(s="b")} y USING (lang) JOIN {_PAIRED_RECALL.format(s="a")} u USING (lang) JOIN {_PAIRED_RECALL.format(s="b")} v USING (lang)""",
    "q_axis_summary": "WITH e AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, CASE WHEN l_partkey % 2 = 0 THEN 'lr' ELSE 'tb' END AS axis, CASE WHEN l_linenumber <> 3 THEN l_quantity / 8.0 - 3 END AS e FROM lineitem) SELECT side, axis, count(e) AS read, count(*) AS of, round(avg(abs(e)), 2) AS mae, count(*) FILTER (WHERE abs(e) <= 2) AS within_2 FROM e GROUP BY ALL",
    "q_defect_summary": "SELECT sum(o_orderkey % 4)::BIGINT AS listed, sum(o_custkey % 3)::BIGINT AS matched, sum(o_orderkey % 5)::BIGINT AS extra_flags, sum(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 6 ELSE 0 END)::BIGINT AS extra_on_clean_cards, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS clean_cards FROM orders",
    "q_median_deviation": "SELECT o_orderpriority, median(o_totalprice) AS median, mad(o_totalprice) AS mad FROM orders GROUP BY 1",
    "q_percentiles": "SELECT o_custkey, quantile_cont(o_totalprice::DOUBLE, 0.9) AS p90, list_sort(list(o_totalprice::DOUBLE))[count(*) // 2 + 1] AS middle FROM orders GROUP BY 1",
    "q_fitted_lines": f"WITH p AS (SELECT l_suppkey, l_linenumber::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem), {_fit_sql('p', 'f')}, {_near_sql('f', 'n')}, {_fit_sql('n', 'g')}, g2 AS (SELECT f.l_suppkey, coalesce(g.a, f.a) AS a, coalesce(g.b, f.b) AS b FROM f LEFT JOIN g USING (l_suppkey)), {_near_sql('g2', 'm')}, {_fit_sql('m', 'h')} SELECT s.l_suppkey, round(coalesce(h.a, g2.a), 6) AS a, round(coalesce(h.b, g2.b), 6) AS b FROM (SELECT DISTINCT l_suppkey FROM p) s LEFT JOIN g2 USING (l_suppkey) LEFT JOIN h USING (l_suppkey)",
    "q_densest_window": "WITH w AS (SELECT o_custkey, count(*) OVER x AS n, min(o_totalprice) OVER x AS low FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_totalprice::DOUBLE RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW)) SELECT o_custkey, arg_min(low, struct_pack(a := -n, b := low))::DOUBLE AS low, max(n) AS n, count(*) AS of FROM w GROUP BY o_custkey",
    "q_erf": "SELECT event_id, round(sign(x) * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)), 9) AS erf FROM (SELECT event_id, value / 50 - 1 AS x, 1 / (1 + 0.3275911::DOUBLE * abs(value / 50 - 1)) AS t FROM events)",
    "q_first_answer": "WITH a AS (SELECT conv_id, length(text) % 7 AS q, min(turn) AS turn, arg_min(length(text) % 5 = 0, struct_pack(a := turn, b := length(text) % 5 = 0)) AS found FROM conversations GROUP BY ALL) SELECT conv_id, min(turn) AS turn, arg_min(q, struct_pack(a := turn, b := q)) AS q FROM a WHERE found GROUP BY conv_id",
    "q_request_memory": "SELECT user_id, '[\"' || lower(event_type) || '\",\"a\",\"\",\"x\",\"en\"]' AS key, min(event_id) AS event_id, count(*) - 1 AS from_memory FROM events GROUP BY ALL",
    "q_job_timeouts": "SELECT event_id, epoch_us(ts) + least(event_id % 40, l) * 1000000 AS ended_us, (event_id % 40 > l)::INT AS stopped FROM (SELECT *, CASE event_type WHEN 'error' THEN 20 WHEN 'purchase' THEN 8 WHEN 'click' THEN 5 WHEN 'view' THEN 30 ELSE 12 END AS l FROM events)",
}
