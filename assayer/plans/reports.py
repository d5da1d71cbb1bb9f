"""Queries of report texts, with their oracles: pages are put together from orders and line items, then read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import reports as P
from assayer.functions.tables import table

PLACES = ("TOP LEFT", "TOP", "BOTTOM EDGE", "CENTER/LEFT")
TYPES = ("CORNER WEAR", "EDGE CHIP", "SURFACE / WRINKLE/CREASE")


def report_pages(spark, sf_dir) -> DataFrame:
    """o_orderkey and the text of a page in one of two layouts, with blank lines and padding."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int"))
    s = lambda c: c.cast("string")
    p, k = F.col("l_partkey"), F.col("o_orderkey")
    side = F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "Front").otherwise("Back")
    centering = F.concat(side, F.lit("\nCentering\n"), s(F.pmod(p, F.lit(50)) + 30), F.lit("L/50R"))
    placed = F.concat(side, F.lit(" / "), pick(PLACES, p), F.lit("\n"), pick(TYPES, F.col("l_suppkey")), F.lit("\nVIEW"))
    entry = F.struct("l_linenumber", "l_partkey", F.when(F.pmod(p, F.lit(11)) == 0, centering).otherwise(placed).alias("t"))
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "\n").alias("listed"))
    o = table(spark, sf_dir, "orders").join(listed, "o_orderkey", "left")
    plus = F.pmod(k, F.lit(3)) == 0
    text = F.concat_ws(
        "\n", F.lit("HOME"), F.lit(" EN "), F.concat(F.lit("  Card "), s(F.col("o_custkey"))), F.concat(F.lit("199"), s(F.pmod(k, F.lit(10))), F.lit(" #"), s(F.pmod(k, F.lit(150))), F.lit("/150")), F.lit(""), F.col("o_orderpriority"),
        F.when(F.pmod(k, F.lit(4)) == 0, "Holo\nFirst"), F.when(plus, s(F.pmod(k, F.lit(1000)))).otherwise("VIEW SCORE"), F.when(F.pmod(k, F.lit(5)) != 0, "TAG SCORE"), F.concat(s(F.pmod(k, F.lit(19)) / 2 + 1), F.lit("  ")), F.concat(F.lit("GRADE "), F.col("o_orderstatus")),
        F.when(F.pmod(k, F.lit(7)) != 0, F.concat(F.lit("CORNERS\nF:\n"), s(F.pmod(k, F.lit(6))), F.lit(" DINGS\nB:\n"), F.when(F.pmod(k, F.lit(2)) == 0, "NO DINGS").otherwise("1 DING"))), F.lit("EDGES\nF:\n3DINGS"),
        F.when(F.col("listed").isNotNull(), F.concat(F.lit("Snapshot Of Defects (all)\n"), F.col("listed"), F.lit("\nDINGS MAP\nBack\nx"))), F.concat(F.lit("GRADED "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")),
    )
    return o.select("o_orderkey", text.alias("text"))


def report_records(spark, sf_dir):
    pages = report_pages(spark, sf_dir).select("o_orderkey", P.lines_of(F.col("text")).alias("lines"))
    r = P.report_records(pages, F.col("lines")).withColumnRenamed("record", "r")
    dings = F.array_join(F.transform("r.ding_list", lambda d: F.concat(d["side"], F.lit(" "), d["location"], F.lit(": "), d["type"])), "; ")
    return r.select(
        "o_orderkey", "r.card_name", "r.year_line", "r.set_line", "r.variant", "r.score", "r.grade", "r.grade_label", "r.graded_on", F.col("r.corners.front").alias("corners_front"), F.col("r.dings.corners.back").alias("corner_dings_back"),
        F.col("r.dings.edges.front").alias("edge_dings_front"), F.col("r.dings.edges.back").alias("edge_dings_back"), dings.alias("dings"),
    )


QUERIES = {"q_report_records": report_records}

_PAGES = """
item AS (SELECT l_orderkey, string_agg(CASE WHEN l_partkey % 11 = 0 THEN side || chr(10) || 'Centering' || chr(10) || (l_partkey % 50 + 30) || 'L/50R'
    ELSE side || ' / ' || ['TOP LEFT', 'TOP', 'BOTTOM EDGE', 'CENTER/LEFT'][l_partkey % 4 + 1] || chr(10) || ['CORNER WEAR', 'EDGE CHIP', 'SURFACE / WRINKLE/CREASE'][l_suppkey % 3 + 1] || chr(10) || 'VIEW' END, chr(10)
    ORDER BY l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN side || chr(10) || 'Centering' ELSE side || ' / ' || ['TOP LEFT', 'TOP', 'BOTTOM EDGE', 'CENTER/LEFT'][l_partkey % 4 + 1] || chr(10) || ['CORNER WEAR', 'EDGE CHIP', 'SURFACE / WRINKLE/CREASE'][l_suppkey % 3 + 1] END) AS listed
  FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'Front' ELSE 'Back' END AS side FROM lineitem) GROUP BY l_orderkey),
page AS (SELECT o_orderkey, concat_ws(chr(10), 'HOME', ' EN ', '  Card ' || o_custkey, '199' || (o_orderkey % 10) || ' #' || (o_orderkey % 150) || '/150', '', o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'Holo' || chr(10) || 'First' END,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000)::VARCHAR ELSE 'VIEW SCORE' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'TAG SCORE' END, ((o_orderkey % 19) / 2.0 + 1)::DOUBLE || '  ', 'GRADE ' || o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'CORNERS' || chr(10) || 'F:' || chr(10) || (o_orderkey % 6) || ' DINGS' || chr(10) || 'B:' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'NO DINGS' ELSE '1 DING' END END, 'EDGES' || chr(10) || 'F:' || chr(10) || '3DINGS',
    CASE WHEN listed IS NOT NULL THEN 'Snapshot Of Defects (all)' || chr(10) || listed || chr(10) || 'DINGS MAP' || chr(10) || 'Back' || chr(10) || 'x' END, 'GRADED ' || strftime(o_orderdate, '%Y-%m-%d')) AS text
  FROM orders LEFT JOIN item ON l_orderkey = o_orderkey),
l AS MATERIALIZED (SELECT o_orderkey, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM page)"""

ORACLE_SQL = {
    "q_report_records": f"""
WITH RECURSIVE {_PAGES},
m AS (SELECT *, CASE WHEN list_position(l, 'TAG SCORE') > 1 THEN list_position(l, 'TAG SCORE') WHEN list_position(l, 'VIEW SCORE') > 1 THEN list_position(l, 'VIEW SCORE') END AS mark, coalesce(list_position(l, 'TAG SCORE') > 1, false) AS scored FROM l),
h AS (SELECT *, l[coalesce(list_max(list_filter(range(1, mark), lambda i: l[i] = 'EN')), 0) + 1 : mark - 1] AS head FROM m),
d AS (SELECT *, CASE WHEN scored AND (regexp_matches(head[-1], '^[0-9]+$') OR head[-1] = 'VIEW SCORE') THEN head[1 : len(head) - 1] ELSE head END AS named,
    CASE WHEN list_contains(l, 'CORNERS') THEN l[list_position(l, 'CORNERS') :] END AS c, CASE WHEN list_contains(l, 'EDGES') THEN l[list_position(l, 'EDGES') :] END AS e,
    list_filter(l[coalesce(list_position(list_transform(l, lambda x: starts_with(x, 'Snapshot Of Defects')), true), len(l) + 1) + 1 :], lambda x: x <> 'VIEW') AS seg FROM h),
step(o_orderkey, i, mode, place, told) AS (
  SELECT o_orderkey, 0::BIGINT, 0, '', '' FROM d
  UNION ALL
  SELECT o_orderkey, i + 1, CASE mode WHEN 0 THEN CASE WHEN regexp_matches(lower(x), '^(front|back)\\b') THEN 1 ELSE 9 END
      WHEN 1 THEN CASE WHEN lower(x) = 'centering' AND NOT contains(place, '/') THEN 2 WHEN regexp_matches(lower(x), '^(front|back)\\b') THEN 9 ELSE 0 END ELSE 0 END,
    CASE WHEN mode = 0 THEN x ELSE place END,
    told || CASE WHEN mode = 2 THEN '; ' || lower(trim(place)) || ' card: centering ' || x
      WHEN mode = 1 AND NOT (lower(x) = 'centering' AND NOT contains(place, '/')) AND NOT regexp_matches(lower(x), '^(front|back)\\b') THEN '; ' || lower(trim(split_part(place, '/', 1))) || ' ' || regexp_replace(lower(split_part(place, '/', 2)), '\\s+', '', 'g') || ': ' || lower(x) ELSE '' END
  FROM (SELECT step.*, seg[i + 1] AS x, len(seg) AS n FROM step JOIN d USING (o_orderkey)) WHERE i < n AND mode <> 9),
fin AS (SELECT o_orderkey, told FROM step QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY i DESC) = 1)
SELECT o_orderkey, coalesce(named[1], '') AS card_name, coalesce(named[2], '') AS year_line, coalesce(named[3], '') AS set_line, coalesce(array_to_string(named[4:], ' '), '') AS variant,
  CASE WHEN scored AND regexp_matches(head[-1], '^[0-9]+$') THEN head[-1]::INT END AS score, try_cast(l[mark + 1] AS DOUBLE) AS grade, coalesce(l[mark + 2], '') AS grade_label,
  coalesce(substr(list_filter(l, lambda x: starts_with(x, 'GRADED '))[1], 8), '') AS graded_on, c[list_position(c, 'F:') + 1] AS corners_front,
  try_cast(nullif(regexp_extract(c[list_position(c, 'B:') + 1], '(\\d+)\\s*DINGS?', 1), '') AS INT) AS corner_dings_back,
  try_cast(nullif(regexp_extract(e[list_position(e, 'F:') + 1], '(\\d+)\\s*DINGS?', 1), '') AS INT) AS edge_dings_front,
  try_cast(nullif(regexp_extract(e[list_position(e, 'B:') + 1], '(\\d+)\\s*DINGS?', 1), '') AS INT) AS edge_dings_back, substr(told, 3) AS dings
FROM d JOIN fin USING (o_orderkey)""",
}
