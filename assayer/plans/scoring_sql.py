"""Oracle SQL of the scoring queries, generated from the rule tables: joins and ordered lookups, unlike the engine."""

from __future__ import annotations

from assayer.plans import criteria as C
from assayer.plans.inspections import SHARES


def values(rows) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{float(x)!r}::DOUBLE" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(map(v, r)) + ")" for r in rows)


KINDS = [(i, n, "|".join(w), q, n in C.FATAL) for i, (n, w, _, q) in enumerate(C.DEFECTS)]
CAPS = [(i, j, float(c)) for i, d in enumerate(C.DEFECTS) for j, c in enumerate(d[2])]
ROWS = [(s, i, float(g), float(f), None if o is None else float(o), float(b)) for s, rows in C.CENTERING.items() for i, (g, f, o, b) in enumerate(rows)]


def _shares() -> str:
    return ", ".join(f"50.0 + ((o_orderkey * {a}) % {b}) / 2.0 AS {n}, (o_orderkey % {c} = 0) AS {n}_unread" for n, (a, b, c) in SHARES.items())


BASE = f"""
kinds(k, kind, wh, qualifier, fatal) AS (VALUES {values(KINDS)}),
caps(k, sev, cap) AS (VALUES {values(CAPS)}),
crows(scheme, ord, grade, front, other, back) AS (VALUES {values(ROWS)}),
card AS (SELECT o_orderkey AS id, {_shares()} FROM orders),
graded AS (SELECT id, {", ".join(f"CASE WHEN {n}_unread THEN greatest({n}, 55.0) ELSE {n} END AS {n}" for n in SHARES)} FROM card),
axes AS (SELECT id, greatest(front_lr, front_tb) AS fw, least(front_lr, front_tb) AS fb, greatest(back_lr, back_tb) AS bw FROM graded),
defect AS (
  SELECT l_orderkey AS id, kind, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 1 END AS side,
    string_split(wh, '|')[((l_partkey // 21) % len(string_split(wh, '|'))) + 1] AS component,
    l_linenumber % 4 AS sev, (CAST(l_quantity AS BIGINT) % 10 <> 0) AS confirmed, qualifier, fatal, cap,
    l_linenumber::BIGINT * 1000000000 + l_partkey AS pos
  FROM (SELECT *, CASE WHEN l_partkey % 21 = 20 AND l_orderkey % 97 <> 0 THEN 11 ELSE l_partkey % 21 END AS kk FROM lineitem) l
  JOIN kinds ON kinds.k = kk JOIN caps ON caps.k = kk AND caps.sev = l_linenumber % 4),
area AS (SELECT o_orderkey AS id, s AS side, c AS comp_no, ['corners','edges','surface'][c + 1] AS component,
    ((o_orderkey + 3 * s + c) % 11 <> 0) AS seen, ((o_orderkey + 2 * s + c) % 13 = 0) AS limited, ((o_orderkey + s + 2 * c) % 17 = 0) AS hand
  FROM orders, (VALUES (0), (1)) sd(s), (VALUES (0), (1), (2)) cp(c)),
assessed AS (SELECT a.*, (hand OR (NOT (limited AND NOT hand) AND (seen OR EXISTS (SELECT 1 FROM defect d WHERE d.id = a.id AND d.side = a.side AND d.component = a.component AND d.confirmed)))) AS ok FROM area a),
altered AS (SELECT id, bool_or(confirmed AND fatal) AS altered FROM defect GROUP BY id)"""


def condition(keys: str, name: str, source: str = "defect", assessed: str = "assessed") -> str:
    """CTEs with one row per group of the complete grid: {name}(keys, ok, grade)."""
    on = " AND ".join(f"g.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_grid AS (SELECT {keys}, bool_and(ok) AS ok FROM {assessed} GROUP BY {keys}),
{name}_facts AS (SELECT {keys}, min(cap) FILTER (WHERE confirmed) AS worst, count(*) FILTER (WHERE confirmed AND cap < 10) AS low,
   count(*) FILTER (WHERE confirmed AND sev = 0) AS micro, min(greatest(cap, 9.0)) FILTER (WHERE NOT confirmed) AS lim FROM {source} GROUP BY {keys}),
{name}_sure AS (SELECT g.*, f.worst, f.lim, f.micro, CASE WHEN f.worst IS NOT NULL THEN f.worst - least(0.5 * (f.low - CASE WHEN f.worst < 10 THEN 1 ELSE 0 END), 1.5) END AS stacked
   FROM {name}_grid g LEFT JOIN {name}_facts f ON {on}),
{name}_done AS (SELECT *, CASE WHEN worst IS NOT NULL THEN greatest(1.0, CASE WHEN micro >= 3 AND stacked > 9.5 THEN 9.5 ELSE stacked END) WHEN ok THEN 10.5 END AS sure FROM {name}_sure),
{name} AS (SELECT {keys}, ok, CASE WHEN lim IS NOT NULL AND lim < coalesce(sure, 10.5) THEN lim ELSE sure END AS grade FROM {name}_done)"""


CENTER = """
center AS (SELECT a.id, c.scheme, coalesce(arg_min(c.grade, c.ord) FILTER (WHERE a.fw <= c.front + 0.5 AND (c.other IS NULL OR a.fb <= c.other + 0.5) AND a.bw <= c.back + 0.5), arg_max(c.grade, c.ord)) AS grade
  FROM axes a, crows c GROUP BY a.id, c.scheme)"""


def floor_sql(labels, value: str) -> str:
    g = sorted(float(x) for x, _ in labels)
    return f"coalesce(list_max(list_filter({g}::DOUBLE[], lambda x: x <= ({value}) + 1e-9)), {g[0]})"


def label_sql(labels, value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} = {float(g)!r} THEN '{s}'" for g, s in labels) + " END"


def tier_sql(labels, value: str, first: int = 0) -> str:
    return "CASE " + " ".join(f"WHEN {value} = {float(g)!r} THEN {i + first}" for i, (g, _) in enumerate(labels)) + " END"


MISSING = """
missing AS (
  SELECT id, 0 AS s, 0 AS p, 'front centering (left/right)' AS name FROM card WHERE front_lr_unread
  UNION ALL SELECT id, 0, 1, 'front centering (top/bottom)' FROM card WHERE front_tb_unread
  UNION ALL SELECT id, 1, 0, 'back centering (left/right)' FROM card WHERE back_lr_unread
  UNION ALL SELECT id, 1, 1, 'back centering (top/bottom)' FROM card WHERE back_tb_unread
  UNION ALL SELECT id, side, 2 + comp_no, CASE side WHEN 0 THEN 'front ' ELSE 'back ' END || component ||
    CASE WHEN limited AND NOT hand THEN CASE WHEN component = 'surface' THEN ' (photo can''t show it)' ELSE ' (photo can''t show them)' END ELSE '' END FROM assessed WHERE NOT ok),
missing_list AS (SELECT id, string_agg(name, ', ' ORDER BY s, p) AS unassessed FROM missing GROUP BY id)"""

BOTH = condition("id, component", "both_c")
SIDE = condition("id, side, component", "side_c")


def pivot(scheme: str, expr: str) -> str:
    """id, centering and components of a scheme; expr maps ``v`` (the ceiling) to the scheme's scale."""
    one = lambda c: f"max(CASE WHEN component = '{c}' THEN {expr} END) AS {c}"
    k = scheme.lower()
    return f"""
{k}_parts AS (SELECT b.id, {one('corners')}, {one('edges')}, {one('surface')} FROM (SELECT id, component, coalesce(grade, 10.5) AS v FROM both_c) b GROUP BY b.id),
{k}_subs AS (SELECT p.*, c.grade AS centering, list_sort([p.corners, p.edges, p.surface, c.grade]) AS subs FROM {k}_parts p JOIN center c ON c.id = p.id AND c.scheme = '{scheme}')"""


PSA = (
    pivot("PSA", floor_sql(C.PSA, "least(10.0, v)"))
    + f""",
psa AS (SELECT id, centering, corners, edges, surface, least(corners, edges, surface) AS body, {floor_sql(C.PSA, 'least(corners, edges, surface, centering)')} AS overall FROM psa_subs)"""
)
BGS = (
    pivot("BGS", f"CASE WHEN v >= 10.5 THEN 10.0 ELSE {floor_sql(C.BGS, 'least(v, 9.5)')} END")
    + f""",
bgs1 AS (SELECT *, CASE WHEN subs[1] = subs[2] THEN subs[1] WHEN subs[2] - subs[1] >= 2.5 THEN least(subs[1] + 1, subs[2]) ELSE least(subs[1] + 0.5, subs[2]) END AS a FROM bgs_subs),
bgs2 AS (SELECT *, CASE WHEN a >= 9.5 AND subs[1] < 9 THEN 9.0 ELSE a END AS b FROM bgs1),
bgs3 AS (SELECT *, CASE WHEN b >= 10 AND (len(list_filter(subs, lambda x: x >= 10)) < 3 OR subs[1] < 9.5) THEN 9.5 ELSE b END AS c FROM bgs2),
bgs4 AS (SELECT *, {floor_sql(C.BGS, 'c')} AS overall FROM bgs3),
bgs AS (SELECT id, centering, corners, edges, surface, overall, CASE WHEN subs[1] = 10 THEN '{C.BLACK_LABEL}' ELSE {label_sql(C.BGS, 'overall')} END AS label, CASE WHEN subs[1] = 10 THEN 0 ELSE {tier_sql(C.BGS, 'overall', 1)} END AS tier FROM bgs4)"""
)
CGC = (
    pivot("CGC", floor_sql(C.CGC, "v"))
    + f""",
cgc1 AS (SELECT *, {floor_sql(C.CGC, 'CASE WHEN subs[1] >= 9.5 OR subs[1] = subs[2] THEN subs[1] ELSE least(subs[1] + 0.5, subs[2], 9.5) END')} AS overall FROM cgc_subs),
cgc AS (SELECT id, centering, corners, edges, surface, overall, least(overall, 10.0) AS grade, {label_sql(C.CGC, 'overall')} AS label, {tier_sql(C.CGC, 'overall')} AS tier FROM cgc1)"""
)


def _points(side: str, column: str) -> str:
    p = C.TAG_CENTERING_POINTS[side]
    out = f"CASE WHEN {column} <= {float(p[0][0])!r} THEN {float(p[0][1])!r}"
    for (a, y), (b, z) in zip(p, p[1:]):
        out += f" WHEN {column} <= {float(b)!r} THEN {float(y)!r} + ({column} - {float(a)!r}) / {float(b - a)!r} * {float(z - y)!r}"
    return out + f" ELSE {float(p[-1][1])!r} END"


_AREA = lambda s, c: f"max(p) FILTER (WHERE side = {s} AND component = '{c}')"
TAG = f"""
points(g, p) AS (VALUES {values([(float(a), float(b)) for a, b in C.TAG_CONDITION_POINTS])}),
bands(ord, low, grade, label) AS (VALUES {values([(i, a, float(g), s) for i, (a, g, s) in enumerate(C.TAG_BANDS)])}),
tag0 AS (SELECT s.id, s.side, s.component, arg_max(p.p, p.g) AS p FROM (SELECT *, coalesce(grade, 10.5) AS v FROM side_c) s JOIN points p ON p.g <= s.v + 1e-9 GROUP BY ALL),
tag1 AS (SELECT id, {", ".join(f"{_AREA(i, c)} AS a{i}_{c}" for i in (0, 1) for c in C.COMPONENTS)} FROM tag0 GROUP BY id),
tag2 AS (SELECT t.*, {_points('front', 'fw')} AS a0_centering, {_points('back', 'bw')} AS a1_centering FROM tag1 t JOIN axes USING (id)),
tag3 AS (SELECT *, 0.85::DOUBLE * least({", ".join(f"a{i}_{c}" for i in (0, 1) for c in ("centering", *C.COMPONENTS))}) + {1 - C.TAG_WEAKEST_WEIGHT!r}::DOUBLE * (0.0::DOUBLE {"".join(f" + a{i}_{c} * {C.TAG_SIDE_WEIGHTS[s] / 4!r}::DOUBLE" for i, s in enumerate(C.SIDES) for c in ("centering", *C.COMPONENTS))}) AS raw FROM tag2),
tagcap AS (SELECT c.id, c.grade AS centering, min(b.ord) AS at FROM center c JOIN bands b ON b.grade <= c.grade WHERE c.scheme = 'TAG' GROUP BY c.id, c.grade),
tag4 AS (SELECT t.*, k.centering, CASE WHEN k.at > 0 THEN least(raw, (SELECT low FROM bands WHERE ord = k.at - 1) - 1) ELSE raw END AS capped FROM tag3 t JOIN tagcap k USING (id)),
tag5 AS (SELECT *, round_even(greatest(100.0, least(1000.0, capped)), 0)::INTEGER AS score FROM tag4),
tag AS (SELECT t.id, t.centering, t.score, t.a0_centering, t.a1_centering, least(arg_min(b.grade, b.ord), 10.0) AS grade, arg_min(b.label, b.ord) AS label, min(b.ord) AS tier FROM tag5 t JOIN bands b ON t.score >= b.low GROUP BY ALL)"""


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in (BASE, *ctes)) + "\n" + select
