"""Queries of the keyed state machines (their batch twins) over the event stream, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions.tables import table
from assayer.streaming import machines as M

HOUR = 3_600_000
#: Caps of the query's kinds: hours instead of seconds, as a user's events lie hours apart.
CAPS = {"view": 20 * HOUR, "click": 8 * HOUR, "purchase": 5 * HOUR}
OTHER = 10 * HOUR


def job_lanes(spark, sf_dir):
    """What becomes of each request of each user; a result is one of the user's event before it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp")), "event_id"))
    pick = F.pmod("event_id", F.lit(7))
    action = F.when(F.pmod("event_id", F.lit(23)) == 0, "cancel").when(pick.isin(1, 4), "result").when(pick == 2, "supersede").otherwise("request")
    e = e.withColumn("before", before).withColumn("action", action).withColumn("job", F.when(F.col("action") == "result", F.coalesce("before", F.lit(-1))).otherwise(F.col("event_id")))
    rows = M.events_for(M.Lane, e, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type"), F.col("action"), F.col("job"))
    return M.replayed(rows, lambda: M.Lane(CAPS, OTHER))


def answer_cache(spark, sf_dir):
    """Lookups of a few items per kind of event, kept for a day; some events forget all of their kind."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    item, action = F.pmod("user_id", F.lit(40)).cast("string"), F.when(F.pmod("event_id", F.lit(197)) == 0, "purge").otherwise("lookup")
    rows = M.events_for(M.Cache, e, F.concat(F.col("event_type"), F.lit("/"), F.pmod("user_id", F.lit(4)).cast("string")), F.col("ts"), F.col("event_id"), item, action, F.col("event_id"))
    return M.replayed(rows, lambda: M.Cache(24 * HOUR))


def late_results(spark, sf_dir):
    """Results that come up to a day after their request, while it is still the user's newest."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    asked = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.timestamp_micros(at).alias("asked"))
    came = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.timestamp_micros(at + F.floor("value") * 600_000_000).alias("came"))
    out = M.current_results(asked, came, "30 hours")
    return out.select("key", "revision", F.unix_micros("came").alias("came_us"))


QUERIES = {"q_job_lanes": job_lanes, "q_answer_cache": answer_cache, "q_late_results": late_results}

_CAP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items()) + f" ELSE {OTHER} END"
ORACLE_SQL = {
    "q_job_lanes": f"""
WITH RECURSIVE o AS (SELECT *, epoch_us(ts) // 1000 AS "at", lag(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS before,
    CASE WHEN event_id % 23 = 0 THEN 'cancel' WHEN event_id % 7 IN (1, 4) THEN 'result' WHEN event_id % 7 = 2 THEN 'supersede' ELSE 'request' END AS action FROM events),
  e AS (SELECT user_id::VARCHAR AS key, "at", action, {_CAP}::BIGINT AS cap, CASE WHEN action = 'result' THEN coalesce(before, -1) ELSE event_id END AS job,
    row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS r FROM o),
  x AS (
    SELECT DISTINCT key, 0::BIGINT AS r, NULL::BIGINT AS a, NULL::BIGINT AS d, NULL::BIGINT AS p, NULL::BIGINT AS c, []::STRUCT(job BIGINT, outcome VARCHAR, "at" BIGINT)[] AS outs FROM e
    UNION ALL
    SELECT key, r,
      CASE action WHEN 'result' THEN CASE WHEN a = job THEN p ELSE a END WHEN 'cancel' THEN NULL WHEN 'supersede' THEN job ELSE coalesce(a, job) END,
      CASE action WHEN 'result' THEN CASE WHEN a = job THEN "at" + c ELSE d END WHEN 'cancel' THEN NULL WHEN 'supersede' THEN "at" + cap ELSE CASE WHEN a IS NULL THEN "at" + cap ELSE d END END,
      CASE action WHEN 'result' THEN CASE WHEN a = job THEN NULL ELSE p END WHEN 'request' THEN CASE WHEN a IS NOT NULL THEN job END END,
      CASE action WHEN 'result' THEN CASE WHEN a = job THEN NULL ELSE c END WHEN 'request' THEN CASE WHEN a IS NOT NULL THEN cap END END,
      list_concat(timed, list_filter(CASE WHEN action = 'result' THEN [struct_pack(job := job, outcome := CASE WHEN a = job THEN 'done' ELSE 'late' END, "at" := "at")]
        ELSE [struct_pack(job := p, outcome := CASE WHEN action = 'cancel' THEN 'cancelled' ELSE 'stale' END, "at" := "at"),
              struct_pack(job := CASE WHEN action <> 'request' THEN a END, outcome := CASE WHEN action = 'cancel' THEN 'cancelled' ELSE 'superseded' END, "at" := "at")] END, lambda s: s.job IS NOT NULL))
    FROM (SELECT key, r, "at", action, cap, job, CASE WHEN NOT t1 THEN a WHEN NOT t2 THEN p END AS a, CASE WHEN NOT t1 THEN d WHEN NOT t2 THEN d + c END AS d,
        CASE WHEN NOT t1 THEN p END AS p, CASE WHEN NOT t1 THEN c END AS c,
        list_filter([struct_pack(job := CASE WHEN t1 THEN a END, outcome := 'timeout', "at" := d), struct_pack(job := CASE WHEN t2 THEN p END, outcome := 'timeout', "at" := d + c)], lambda s: s.job IS NOT NULL) AS timed
      FROM (SELECT e.*, x.a, x.d, x.p, x.c, coalesce(x.d <= e."at", false) AS t1, coalesce(x.d <= e."at" AND x.d + x.c <= e."at", false) AS t2 FROM x JOIN e ON e.key = x.key AND e.r = x.r + 1))),
  last AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1),
  told AS (SELECT key, unnest(outs) AS s FROM x UNION ALL SELECT key, struct_pack(job := a, outcome := 'timeout', "at" := d) FROM last WHERE a IS NOT NULL
    UNION ALL SELECT key, struct_pack(job := p, outcome := 'timeout', "at" := d + c) FROM last WHERE p IS NOT NULL)
SELECT key, s.job AS job, s.outcome AS outcome, s."at" AS "at" FROM told""",
    "q_answer_cache": f"""
WITH RECURSIVE e AS (SELECT event_type || '/' || (user_id % 4) AS key, (user_id % 40)::VARCHAR AS item, event_id, epoch_us(ts) // 1000 AS "at", event_id % 197 = 0 AS purge FROM events),
  g AS (SELECT *, count(*) FILTER (WHERE purge) OVER (PARTITION BY key ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
  l AS (SELECT * FROM g WHERE NOT purge),
  k AS (SELECT key, item, g, min("at") AS "at" FROM l GROUP BY key, item, g
    UNION ALL SELECT key, item, g, (SELECT min(l."at") FROM l WHERE l.key = k.key AND l.item = k.item AND l.g = k.g AND l."at" >= k."at" + {24 * HOUR}) FROM k WHERE "at" IS NOT NULL),
  kept AS (SELECT k.key, k.item, k.g, k."at", min(l.event_id) AS id FROM k JOIN l ON l.key = k.key AND l.item = k.item AND l.g = k.g AND l."at" = k."at" GROUP BY ALL)
SELECT l.key, l.item, l.event_id <> kept.id AS hit, kept.id::VARCHAR AS answer, l."at" FROM l ASOF JOIN kept ON l.key = kept.key AND l.item = kept.item AND l.g = kept.g AND l."at" >= kept."at" """,
    "q_late_results": """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) + floor(value)::BIGINT * 600000000 AS came FROM events)
SELECT user_id AS key, event_id AS revision, came AS came_us FROM e WHERE came - us BETWEEN 0 AND 108000000000
  AND NOT EXISTS (SELECT 1 FROM e n WHERE n.user_id = e.user_id AND n.event_id > e.event_id AND n.us <= e.came AND n.us >= e.came - 108000000000)""",
}
