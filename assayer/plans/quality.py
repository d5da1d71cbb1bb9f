"""Queries of validation and of runs, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import shared_dir, table
from assayer.operators import rebuild as B
from assayer.operators import runs
from assayer.operators import schema as S

#: The rule table of the records below: path, type, required, enum, pattern.
RULES = [
    ("cert", "string", True, None, "[0-9]{3,}"),
    ("pool", "string", True, "O|F", None),
    ("grade", "number|null", True, None, None),
    ("tag", "object", True, None, None),
    ("tag.score", "integer", False, None, None),
    ("tag.ding_list", "array", True, None, None),
    ("tag.ding_list[]", "object", False, None, None),
    ("tag.ding_list[].side", "string", True, "front|back", None),
    ("tag.ding_list[].pos", "integer", True, None, None),
    ("images", "object", True, None, None),
    ("images.*", "object", False, None, None),
    ("images.*.sha256", "string|null", True, None, "[0-9a-f]{64}"),
    ("images.*.bytes", "integer", True, None, None),
]


def json_records(spark, sf_dir) -> DataFrame:
    """o_orderkey and a nested record as JSON text; some are broken in every way that a rule tells."""
    s = lambda c: c.cast("string")
    side = F.when(F.pmod("l_suppkey", F.lit(5)) == 0, "top").when(F.pmod("l_suppkey", F.lit(2)) == 0, "front").otherwise("back")
    pos = F.when(F.col("l_linenumber") == 6, F.lit('"6"')).otherwise(s(F.col("l_linenumber")))
    ding = F.concat(F.lit('{"side":"'), side, F.when(F.pmod("l_partkey", F.lit(50)) == 0, F.lit('"}')).otherwise(F.concat(F.lit('","pos":'), pos, F.lit("}"))))
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", ding.alias("t")))), lambda e: e["t"]), ",").alias("listed"))
    o, k = table(spark, sf_dir, "orders").join(listed, "o_orderkey", "left"), F.col("o_orderkey")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    grade = F.when(every(11), "").when(every(7), F.lit(',"grade":"9"')).when(every(5), F.lit(',"grade":null')).otherwise(F.concat(F.lit(',"grade":'), s(F.pmod(k, F.lit(19)) / 2 + 1)))
    dings = F.when(every(23), F.lit("{}")).otherwise(F.concat(F.lit("["), F.coalesce("listed", F.lit("")), F.lit("]")))
    sha = F.when(every(13), F.lit('"ABC"')).when(every(14), F.lit("null")).otherwise(F.concat(F.lit('"'), F.sha2(s(k), 256), F.lit('"')))
    text = F.concat(
        F.lit('{"cert":'), F.when(every(17), s(k)).otherwise(F.concat(F.lit('"'), s(k), F.lit('"'))), F.lit(',"pool":"'), F.col("o_orderstatus"), F.lit('"'), grade, F.lit(',"tag":{"score":'), F.when(every(9), "3.5").otherwise(s(F.pmod(k, F.lit(1000)))),
        F.lit(',"ding_list":'), dings, F.lit('},"images":{"front":{"sha256":'), sha, F.lit(',"bytes":'), s(k * 3), F.lit("}"), F.when(every(8), F.lit(',"back":{"bytes":1}')).otherwise(""), F.when(every(101), "").otherwise("}}"),
    )
    return o.select("o_orderkey", text.alias("record"))


def record_schema(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "path string, type string, required boolean, enum string, pattern string")
    document = S.schema_of_rules(rules.collect())
    found = json_records(spark, sf_dir).select("o_orderkey", S.schema_errors(F.col("record"), document).alias("errors"))
    # outer: for a plain explode Spark tests the array below the projection, and makes and checks each record twice
    return found.select("o_orderkey", F.explode_outer("errors").alias("error")).where("error is not null")


def _marked(spark, sf_dir) -> DataFrame:
    rows = runs.numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return rows.withColumn("marked", F.col("event_type").isin("view", "click"))


def marked_runs(spark, sf_dir):
    """Runs of a user's views and clicks, of three events or more, with one other event between at most."""
    return runs.marked_runs(_marked(spark, sf_dir), "user_id", "pos", F.col("marked"), 1, 3)


def first_run(spark, sf_dir):
    return runs.first_run(_marked(spark, sf_dir), "user_id", "pos", F.col("marked"), 3)


def incremental_rebuild(spark, sf_dir):
    """The store after a second build: some orders are new, some changed, some lost their input, some failed to be fetched
    again, some are excluded. Only the changed ones are computed; the result is that of a build from scratch."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice"), F.col("o_orderkey")
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    compute = lambda d: d.select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("cents"))
    told = lambda d: d.withColumn("digest", B.digest_of("o_orderstatus", "o_custkey", "o_totalprice"))
    B.rebuild(told(o.where("o_orderkey % 10 <> 9")).withColumn("failed", F.lit(False)), path, compute, "o_orderkey", "v1", parts=256)
    moved = (F.pmod(k, F.lit(97)) == 0) | (F.pmod(k, F.lit(89)) == 0) | (F.pmod(k, F.lit(83)) == 0)
    later = told(o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(moved, 1.0).otherwise(0.0))).withColumn("failed", F.pmod(k, F.lit(83)) == 0)
    later = later.withColumn("digest", F.when(F.pmod(k, F.lit(89)) != 0, F.col("digest")))
    B.rebuild(later, path, compute, "o_orderkey", "v1", o.where("o_orderkey % 79 = 0").select("o_orderkey"), parts=256)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "cents")


QUERIES = {"q_incremental_rebuild": incremental_rebuild, "q_record_schema": record_schema, "q_marked_runs": marked_runs, "q_first_run": first_run}

_RECORDS = """
d AS (SELECT l_orderkey, string_agg('{"side":"' || side || CASE WHEN l_partkey % 50 = 0 THEN '"}' ELSE '","pos":' || CASE WHEN l_linenumber = 6 THEN '"6"' ELSE l_linenumber::VARCHAR END || '}' END, ',' ORDER BY l_linenumber, l_partkey,
    side || CASE WHEN l_partkey % 50 = 0 THEN '"}' ELSE '",' END) AS listed
  FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 'top' WHEN l_suppkey % 2 = 0 THEN 'front' ELSE 'back' END AS side FROM lineitem) GROUP BY l_orderkey),
t AS (SELECT o_orderkey, '{"cert":' || CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey::VARCHAR ELSE '"' || o_orderkey || '"' END || ',"pool":"' || o_orderstatus || '"'
    || CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN ',"grade":"9"' WHEN o_orderkey % 5 = 0 THEN ',"grade":null' ELSE ',"grade":' || (o_orderkey % 19) / 2.0 + 1 END
    || ',"tag":{"score":' || CASE WHEN o_orderkey % 9 = 0 THEN '3.5' ELSE (o_orderkey % 1000)::VARCHAR END || ',"ding_list":' || CASE WHEN o_orderkey % 23 = 0 THEN '{}' ELSE '[' || coalesce(listed, '') || ']' END
    || '},"images":{"front":{"sha256":' || CASE WHEN o_orderkey % 13 = 0 THEN '"ABC"' WHEN o_orderkey % 14 = 0 THEN 'null' ELSE '"' || sha256(o_orderkey::VARCHAR) || '"' END || ',"bytes":' || (o_orderkey * 3) || '}'
    || CASE WHEN o_orderkey % 8 = 0 THEN ',"back":{"bytes":1}' ELSE '' END || CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '}}' END AS record FROM orders LEFT JOIN d ON l_orderkey = o_orderkey),
j AS MATERIALIZED (SELECT o_orderkey, record::JSON AS r FROM t WHERE json_valid(record)),
ding AS (SELECT o_orderkey, unnest(json_extract(r, '$.tag.ding_list[*]')) AS x, unnest(range(json_array_length(r, '$.tag.ding_list')::BIGINT)) AS i FROM j WHERE json_type(r, '$.tag.ding_list') = 'ARRAY'),
img AS (SELECT o_orderkey, unnest(json_keys(r, '$.images')) AS side, r FROM j), im AS (SELECT o_orderkey, side, json_extract(r, '$.images.' || side) AS x FROM img)"""
_BY_USER = "e AS (SELECT user_id, event_type IN ('view', 'click') AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), k AS (SELECT user_id, pos FROM e WHERE m)"
ORACLE_SQL = {
    "q_incremental_rebuild": """SELECT o_orderkey, o_orderstatus, floor((o_totalprice + CASE WHEN o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 THEN 0 WHEN o_orderkey % 97 = 0 THEN 1.0 ELSE 0 END) * 100 + 0.5)::BIGINT AS cents
      FROM orders WHERE o_orderkey % 79 <> 0 AND (o_orderkey % 10 <> 9 OR (o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0))""",
    "q_record_schema": f"""WITH {_RECORDS.replace("(o_orderkey % 19) / 2.0 + 1 END", "((o_orderkey % 19) / 2.0 + 1)::VARCHAR END")}
SELECT o_orderkey, '$: not JSON' AS error FROM t WHERE NOT json_valid(record)
UNION ALL SELECT o_orderkey, CASE WHEN json_type(r, '$.cert') <> 'VARCHAR' THEN '$.cert: not string' ELSE '$.cert: malformed' END FROM j WHERE json_type(r, '$.cert') <> 'VARCHAR' OR NOT regexp_full_match(r->>'$.cert', '[0-9]{{3,}}')
UNION ALL SELECT o_orderkey, '$.pool: not one of O, F' FROM j WHERE (r->>'$.pool') NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, CASE WHEN json_type(r, '$.grade') IS NULL THEN '$.grade: missing' ELSE '$.grade: not number or null' END FROM j WHERE coalesce(json_type(r, '$.grade'), 'no') NOT IN ('NULL', 'DOUBLE', 'BIGINT', 'UBIGINT')
UNION ALL SELECT o_orderkey, '$.tag.score: not integer' FROM j WHERE json_type(r, '$.tag.score') NOT IN ('BIGINT', 'UBIGINT')
UNION ALL SELECT o_orderkey, '$.tag.ding_list: not array' FROM j WHERE json_type(r, '$.tag.ding_list') <> 'ARRAY'
UNION ALL SELECT o_orderkey, '$.tag.ding_list[' || i || '].side: not one of front, back' FROM ding WHERE (x->>'$.side') NOT IN ('front', 'back')
UNION ALL SELECT o_orderkey, '$.tag.ding_list[' || i || '].pos: ' || CASE WHEN json_type(x, '$.pos') IS NULL THEN 'missing' ELSE 'not integer' END FROM ding WHERE coalesce(json_type(x, '$.pos'), 'no') NOT IN ('BIGINT', 'UBIGINT')
UNION ALL SELECT o_orderkey, '$.images.' || side || '.sha256: ' || CASE WHEN json_type(x, '$.sha256') IS NULL THEN 'missing' ELSE 'malformed' END FROM im WHERE json_type(x, '$.sha256') IS NULL OR NOT regexp_full_match(x->>'$.sha256', '[0-9a-f]{{64}}')""",
    "q_marked_runs": f"""WITH {_BY_USER}, n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM n)
      SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS marks FROM g GROUP BY user_id, run HAVING max(pos) - min(pos) + 1 >= 3""",
    "q_first_run": f"WITH {_BY_USER}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM k), r AS (SELECT user_id, min(pos) AS start FROM g GROUP BY user_id, run HAVING count(*) >= 3) SELECT user_id, min(start) AS start FROM r GROUP BY user_id",
}
