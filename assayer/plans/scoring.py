"""Queries of the scoring engine over the derived inspection records, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.grades import band, interpolate
from assayer.operators import grading as G
from assayer.plans import criteria as C
from assayer.plans import scoring_sql as S
from assayer.plans.inspections import cards, defects


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conditions(cards(spark, sf_dir), defects(spark, sf_dir))


def component_condition(spark, sf_dir):
    """Stacked caps and the unconfirmed limiter, both sides together."""
    items = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"cond_{c}").alias("grade")) for c in C.COMPONENTS])
    return _conditions(spark, sf_dir).select("id", F.explode(items).alias("x")).select("id", "x.component", "x.grade")


def component_condition_side(spark, sf_dir):
    items = F.array(*[F.struct(F.lit(i).alias("side"), F.lit(c).alias("component"), F.col(f"cond_{s}_{c}").alias("grade")) for i, s in enumerate(C.SIDES) for c in C.COMPONENTS])
    return _conditions(spark, sf_dir).select("id", F.explode(items).alias("x")).select("id", "x.side", "x.component", "x.grade")


def centering(scheme: str):
    def run(spark, sf_dir):
        return _conditions(spark, sf_dir).select("id", G.centering(scheme).alias("grade"))

    return run


def assessed_grid(spark, sf_dir):
    items = F.array(*[F.struct(F.lit(i).alias("side"), F.lit(c).alias("component"), F.col(f"assessed_{s}_{c}").alias("ok")) for i, s in enumerate(C.SIDES) for c in C.COMPONENTS])
    return _conditions(spark, sf_dir).select("id", F.explode(items).alias("x")).select("id", "x.side", "x.component", F.col("x.ok").cast("int").alias("ok"))


def unassessed(spark, sf_dir):
    return _conditions(spark, sf_dir).select("id", F.array_join(G.missing_areas(), ", ").alias("unassessed")).where("unassessed <> ''")


def psa(spark, sf_dir):
    df = G.psa(_conditions(spark, sf_dir))
    return df.select("id", *[F.col(f"psa_{k}").alias(k) for k in ("centering", *C.COMPONENTS)], F.col("psa_overall").alias("overall"), F.col("psa_label").alias("label"), F.col("psa_tier").alias("tier"))


def bgs(spark, sf_dir):
    df = G.bgs(_conditions(spark, sf_dir))
    return df.select("id", *[F.col(f"bgs_{k}").alias(k) for k in ("centering", *C.COMPONENTS)], F.col("bgs_grade").alias("overall"), F.col("bgs_label").alias("label"), F.col("bgs_tier").alias("tier"))


def cgc(spark, sf_dir):
    df = G.cgc(_conditions(spark, sf_dir))
    return df.select("id", *[F.col(f"cgc_{k}").alias(k) for k in ("centering", *C.COMPONENTS, "overall", "grade", "label", "tier")])


def tag(spark, sf_dir):
    df = G.tag(_conditions(spark, sf_dir))
    return df.select("id", F.col("tag_centering").alias("centering"), F.col("tag_score").alias("score"), F.col("tag_grade").alias("grade"), F.col("tag_label").alias("label"), F.col("tag_tier").alias("tier"))


def psa_whatif(spark, sf_dir):
    df = G.psa(_conditions(spark, sf_dir))
    items = F.array(*[F.struct(F.lit(q).alias("qualifier"), F.col(f"psa_without_{q}").alias("alt")) for q, _ in C.QUALIFIERS])
    return df.select("id", F.col("psa_overall").alias("overall"), F.explode(items).alias("x")).where("x.alt is not null").select("id", "overall", "x.qualifier", "x.alt")


def qualifiers(spark, sf_dir):
    df = G.psa(_conditions(spark, sf_dir))
    # the test is on an exploded column: a filter on the stages' own columns would be pushed below them, with all their rules written out
    told = F.array(F.when(F.size("psa_qualifiers") > 0, F.array_join("psa_qualifiers", ",")))
    return df.select("id", F.explode(told).alias("qualifiers")).where("qualifiers is not null")


def tag_interpolate(spark, sf_dir):
    return _conditions(spark, sf_dir).select("id", interpolate(C.TAG_CENTERING_POINTS["front"], F.col("most_front")).alias("front"), interpolate(C.TAG_CENTERING_POINTS["back"], F.col("most_back")).alias("back"))


def tag_band(spark, sf_dir):
    score = F.pmod(F.col("id") * 37, F.lit(1001)).cast("double")
    return cards(spark, sf_dir).select("id", score.alias("score"), band(C.TAG_BANDS, score, 1).alias("grade"), band(C.TAG_BANDS, score, 2).alias("label"))


def _report(spark, sf_dir) -> DataFrame:
    return G.report(cards(spark, sf_dir), defects(spark, sf_dir))


def grade_report(spark, sf_dir):
    names = [f"{s.lower()}_{k}" for s in G.GRADERS for k in ("grade", "label", "tier")]
    return _report(spark, sf_dir).select("id", F.col("complete").cast("int").alias("complete"), F.array_join("unassessed", ", ").alias("unassessed"), "best_fit", "tag_score", *names)


def best_shot(spark, sf_dir):
    return _report(spark, sf_dir).where("complete").select("id", "best_shot", "best_shot_rank")


def label_distribution(spark, sf_dir):
    """The flagship: how many cards get each label of each scheme."""
    labels = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(f"{s.lower()}_label").alias("label")) for s in G.GRADERS])
    return _report(spark, sf_dir).select(F.explode(labels).alias("x")).groupBy("x.scheme", "x.label").agg(F.count(F.lit(1)).alias("n"))


def tag_rank(spark, sf_dir):
    """1 + how many complete cards score higher; counts per score first, so only the scores are ranked."""
    df = G.tag(_conditions(spark, sf_dir)).select("id", "tag_score", "altered", (F.size(G.missing_areas()) == 0).alias("complete"))
    df = df.where("complete and not altered").select("id", "tag_score")
    before = Window.orderBy(F.col("tag_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("tag_score").agg(F.count(F.lit(1)).alias("n"))  # at most 901 rows
    place = counts.select("tag_score", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("place"))
    return df.join(F.broadcast(place), "tag_score").select("id", "tag_score", "place")


def _wrapped(scheme: str, k: str) -> str:
    return f"CASE WHEN altered THEN '{C.ALTERED_LABELS[scheme]}' WHEN unassessed <> '' THEN 'Up to ' || {k} || ' · incomplete' ELSE {k} END"


_REPORT = f"""
rep0 AS (SELECT card.id, coalesce(x.altered, false) AS altered, CASE WHEN coalesce(x.altered, false) THEN '' ELSE coalesce(m.unassessed, '') END AS unassessed,
    p.overall AS pg, {S.label_sql(C.PSA, 'p.overall')} AS pl, {S.tier_sql(C.PSA, 'p.overall')} AS pt, b.overall AS bg, b.label AS bl, b.tier AS bt, c.grade AS cg, c.label AS cl, c.tier AS ct, t.grade AS tg, t.label AS tl, t.tier AS tt, t.score AS ts
  FROM card JOIN psa p USING (id) JOIN bgs b USING (id) JOIN cgc c USING (id) JOIN tag t USING (id) LEFT JOIN altered x USING (id) LEFT JOIN missing_list m USING (id)),
rep AS (SELECT id, altered, CASE WHEN unassessed = '' THEN 1 ELSE 0 END AS complete, unassessed, CASE WHEN NOT altered THEN ts END AS tag_score,
    {", ".join(f"CASE WHEN altered THEN 0.0 ELSE {k}g END AS {s.lower()}_grade, {_wrapped(s, k + 'l')} AS {s.lower()}_label, CASE WHEN altered THEN 99 WHEN unassessed = '' THEN {k}t END AS {s.lower()}_tier" for s, k in zip(G.GRADERS, "pbct"))} FROM rep0)"""
_ALL = (S.CENTER, S.BOTH, S.SIDE, S.PSA, S.BGS, S.CGC, S.TAG, S.MISSING, _REPORT)
_BEST = "CASE WHEN complete = 1 THEN CASE least(psa_tier, bgs_tier, cgc_tier, tag_tier) WHEN psa_tier THEN 'PSA' WHEN bgs_tier THEN 'BGS' WHEN cgc_tier THEN 'CGC' ELSE 'TAG' END END AS best_fit"


def _rank(k: str) -> str:
    return f"CASE WHEN altered THEN -1.0 WHEN {k}_label LIKE '%Black Label%' THEN 11.0 WHEN {k}_label LIKE 'Pristine%' THEN 10.5 ELSE {k}_grade END"


_WHATIF = "SELECT w.id, p.overall, w.qualifier, w.alt FROM whatif w JOIN psa p ON p.id = w.id"


def _whatif_ctes() -> str:
    heavy = "(d.confirmed AND d.sev >= 2 AND d.qualifier = q.qualifier)"
    return f"""
trig AS (SELECT DISTINCT id, qualifier FROM defect WHERE confirmed AND sev >= 2 AND qualifier IS NOT NULL),
wd AS (SELECT d.id || '/' || q.qualifier AS id, d.side, d.component, d.sev, d.confirmed, d.cap FROM trig q JOIN defect d ON d.id = q.id AND NOT coalesce({heavy}, false)),
wa AS (SELECT a.id || '/' || q.qualifier AS id, a.component, (hand OR (NOT (limited AND NOT hand) AND (seen OR EXISTS (SELECT 1 FROM wd WHERE wd.id = a.id || '/' || q.qualifier AND wd.side = a.side AND wd.component = a.component AND wd.confirmed)))) AS ok FROM trig q JOIN area a ON a.id = q.id),
{S.condition("id, component", "wc", "wd", "wa").strip()},
wbody AS (SELECT id, min({S.floor_sql(C.PSA, 'least(10.0, coalesce(grade, 10.5))')}) AS body FROM wc GROUP BY id),
whatif AS (SELECT split_part(w.id, '/', 1)::BIGINT AS id, split_part(w.id, '/', 2) AS qualifier, {S.floor_sql(C.PSA, 'least(w.body, c.grade)')} AS alt
  FROM wbody w JOIN center c ON c.id = split_part(w.id, '/', 1)::BIGINT AND c.scheme = 'PSA')"""


QUERIES = {
    "q_component_condition": component_condition,
    "q_component_condition_side": component_condition_side,
    **{f"q_centering_first_row_{s.lower()}": centering(s) for s in G.GRADERS},
    "q_assessed_grid": assessed_grid,
    "q_unassessed": unassessed,
    "q_psa": psa,
    "q_bgs": bgs,
    "q_cgc": cgc,
    "q_tag": tag,
    "q_psa_qualifier_whatif": psa_whatif,
    "q_psa_qualifiers": qualifiers,
    "q_tag_interpolate": tag_interpolate,
    "q_tag_band": tag_band,
    "q_grade_report_best_fit": grade_report,
    "q_best_shot_rank": best_shot,
    "q_tag_rank": tag_rank,
    "q_label_distribution": label_distribution,
}

ORACLE_SQL = {
    "q_component_condition": S.query("SELECT id, component, grade FROM both_c", S.BOTH),
    "q_component_condition_side": S.query("SELECT id, side, component, grade FROM side_c", S.SIDE),
    **{f"q_centering_first_row_{s.lower()}": S.query(f"SELECT id, grade FROM center WHERE scheme = '{s}'", S.CENTER) for s in G.GRADERS},
    "q_assessed_grid": S.query("SELECT id, side, component, CASE WHEN ok THEN 1 ELSE 0 END AS ok FROM assessed"),
    "q_unassessed": S.query("SELECT id, unassessed FROM missing_list", S.MISSING),
    "q_psa": S.query(f"SELECT id, centering, corners, edges, surface, overall, {S.label_sql(C.PSA, 'overall')} AS label, {S.tier_sql(C.PSA, 'overall')} AS tier FROM psa", S.CENTER, S.BOTH, S.PSA),
    "q_bgs": S.query("SELECT * FROM bgs", S.CENTER, S.BOTH, S.BGS),
    "q_cgc": S.query("SELECT * FROM cgc", S.CENTER, S.BOTH, S.CGC),
    "q_tag": S.query("SELECT id, centering, score, grade, label, tier FROM tag", S.CENTER, S.SIDE, S.TAG),
    "q_psa_qualifier_whatif": S.query(_WHATIF, S.CENTER, S.BOTH, S.PSA, _whatif_ctes()),
    "q_psa_qualifiers": S.query(
        "SELECT id, string_agg(q, ',' ORDER BY pos) AS qualifiers FROM (SELECT id, 'OC' AS q, -1 AS pos FROM psa WHERE centering < body "
        "UNION ALL SELECT id, qualifier, min(pos) FROM defect WHERE confirmed AND sev >= 2 AND qualifier IS NOT NULL GROUP BY id, qualifier) GROUP BY id",
        S.CENTER, S.BOTH, S.PSA,
    ),
    "q_tag_interpolate": S.query(f"SELECT id, {S._points('front', 'fw')} AS front, {S._points('back', 'bw')} AS back FROM axes"),
    "q_tag_band": f"WITH bands(ord, low, grade, label) AS (VALUES {S.values([(i, a, float(g), s) for i, (a, g, s) in enumerate(C.TAG_BANDS)])}), s AS (SELECT o_orderkey AS id, ((o_orderkey * 37) % 1001)::DOUBLE AS score FROM orders) "
    "SELECT s.id, s.score, coalesce(arg_min(b.grade, b.ord) FILTER (WHERE s.score >= b.low), arg_max(b.grade, b.ord)) AS grade, coalesce(arg_min(b.label, b.ord) FILTER (WHERE s.score >= b.low), arg_max(b.label, b.ord)) AS label FROM s, bands b GROUP BY s.id, s.score",
    "q_grade_report_best_fit": S.query(f"SELECT id, complete, unassessed, tag_score, {', '.join(f'{s.lower()}_{k}' for s in G.GRADERS for k in ('grade', 'label', 'tier'))}, {_BEST} FROM rep", *_ALL),
    "q_best_shot_rank": S.query(
        f"SELECT id, best_shot_rank, CASE best_shot_rank WHEN pr THEN 'PSA' WHEN br THEN 'BGS' WHEN cr THEN 'CGC' ELSE 'TAG' END AS best_shot FROM (SELECT *, greatest(pr, br, cr, tr) AS best_shot_rank FROM (SELECT id, complete, {_rank('psa')} AS pr, {_rank('bgs')} AS br, {_rank('cgc')} AS cr, {_rank('tag')} AS tr FROM rep)) WHERE complete = 1",
        *_ALL,
    ),
    "q_tag_rank": S.query("SELECT id, tag_score, rank() OVER (ORDER BY tag_score DESC) AS place FROM rep WHERE complete = 1 AND tag_score IS NOT NULL", *_ALL),
    "q_label_distribution": S.query(" UNION ALL ".join(f"SELECT '{s}' AS scheme, {s.lower()}_label AS label, count(*) AS n FROM rep GROUP BY 2" for s in G.GRADERS), *_ALL),
}
