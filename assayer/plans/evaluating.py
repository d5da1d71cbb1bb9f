"""Queries of the evaluation kit over labels, documents and events, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import table
from assayer.operators import evaluation as E


def labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(docs, "doc_id")


def graded(spark, sf_dir) -> DataFrame:
    """Answers: a true grade and a prediction from key arithmetic; some predictions are missing."""
    k = F.col("doc_id")
    true = (F.pmod(k, F.lit(10)) + 1).cast("double")
    pred = F.when(F.pmod(k, F.lit(13)) != 0, true + (F.pmod(k * 7, F.lit(9)) - 4) / 2)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("doc_id div 3").alias("item"), true.alias("truth"), pred.alias("pred"))


_LABELLED = "l AS (SELECT doc_id, quality, toxic, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"
_GRADED = "g AS (SELECT doc_id, lang, source, doc_id // 3 AS item, (doc_id % 10 + 1)::DOUBLE AS truth, CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 10 + 1)::DOUBLE + ((doc_id * 7) % 9 - 4) / 2.0 END AS pred FROM documents)"

STATUS = {"error": 3, "purchase": 2, "click": 1, "view": 0, "signup": 0}


def status_rollup(spark, sf_dir):
    """The worst status of each user, by rank; ties by name."""
    rank = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])[F.col("event_type")]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(rank, "event_type")).alias("verdict"), F.count_if(rank >= 3).alias("failures"))


def calibration(spark, sf_dir):
    """True grade -> sorted answers, repeated ones as often as given."""
    return graded(spark, sf_dir).where("pred is not null").groupBy("truth").agg(F.array_join(F.array_sort(F.collect_list(F.col("pred").cast("decimal(6,1)"))).cast("array<string>"), ",").alias("answers"))


def paired_stats(spark, sf_dir):
    df = labelled(spark, sf_dir)
    lab = F.col("quality") == 1
    a, b = F.pmod(F.col("n_chars"), F.lit(7)), F.pmod(F.col("doc_id"), F.lit(5))
    rate = lambda test, base: F.try_divide(F.count_if(test & base).cast("double"), F.count_if(base).cast("double"))
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("areas"), F.count_if(lab).alias("positive"), F.count_if(~lab).alias("clean"),
        rate(a > 0, ~lab).alias("flag_rate_a"), rate(b > 0, ~lab).alias("flag_rate_b"), rate(a > 0, lab).alias("recall_a"), rate(b > 0, lab).alias("recall_b"),
    )


def _boot(spark, sf_dir, replicates=2000):
    df = labelled(spark, sf_dir).select("source", "quality", F.col("n_chars").alias("a"), F.pmod(F.col("n_chars") * 7 + F.col("doc_id"), F.lit(1009)).alias("b"))
    return E.bootstrap_auc_difference(df, "source", "quality", "a", "b", replicates)


def _auc_sql(group: str, source: str, score: str, w: str = "1") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}sum(pos) AS positive, sum(neg) AS clean, sum(pos * (before + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT {g}{score}, sum(CASE WHEN quality = 1 THEN {w} ELSE 0 END) AS pos, sum(CASE WHEN quality = 1 THEN 0 ELSE {w} END) AS neg FROM {source} GROUP BY {g}{score})) GROUP BY {group}"""


_RANKS = "(rank() OVER (PARTITION BY lang ORDER BY {c}) + (count(*) OVER (PARTITION BY lang, {c}) - 1) / 2.0)::DOUBLE"

QUERIES = {
    "q_rank_avg": lambda spark, d: E.average_ranks(labelled(spark, d).select("doc_id", "lang", "n_chars"), ["lang"], "n_chars").select("doc_id", "rank"),
    "q_spearman": lambda spark, d: E.spearman(labelled(spark, d).select("lang", "quality", "n_chars"), ["lang"], "quality", "n_chars"),
    "q_auc": lambda spark, d: E.auc(labelled(spark, d), ["lang"], "n_chars", "quality"),
    "q_recall_at_fpr": lambda spark, d: E.recall_at_fpr(labelled(spark, d), ["lang"], "n_chars", "quality"),
    "q_paired_stats": paired_stats,
    "q_bootstrap_ci": _boot,
    "q_eval_summary": lambda spark, d: E.error_summary(graded(spark, d), ["lang"], "truth", "pred"),
    "q_blind_summary": lambda spark, d: E.error_summary(graded(spark, d), ["source"], "truth", "pred").select("source", "n", "exact", "within_05", "within_1", "mae", "bias"),
    "q_repeat_agreement": lambda spark, d: E.repeat_agreement(graded(spark, d).where("pred is not null"), ["lang"], "item", "pred"),
    "q_true_to_answers": calibration,
    "q_status_rollup": status_rollup,
}

#: How often a unit is drawn: Poisson(1) from the same hash.
_POISSON = "(" + " + ".join(f"(md5(r.range || '/' || source)[:8] >= '{t}')::INT" for t in E.POISSON) + ") AS w"
_SUMMARY = "count(*) AS n, count(*) FILTER (WHERE abs(pred - truth) < 0.01) AS exact, count(*) FILTER (WHERE abs(pred - truth) <= 0.5) AS within_05, count(*) FILTER (WHERE abs(pred - truth) <= 1) AS within_1, avg(abs(pred - truth)) AS mae, avg(pred - truth) AS bias"
ORACLE_SQL = {
    "q_rank_avg": f"WITH {_LABELLED} SELECT doc_id, {_RANKS.format(c='n_chars')} AS rank FROM l",
    "q_spearman": f"WITH {_LABELLED}, r AS (SELECT lang, {_RANKS.format(c='quality')} AS x, {_RANKS.format(c='n_chars')} AS y FROM l) SELECT lang, count(*) AS n, corr(x, y) AS spearman FROM r GROUP BY lang",
    "q_auc": f"WITH {_LABELLED} " + _auc_sql("lang", "l", "n_chars"),
    "q_recall_at_fpr": f"""WITH {_LABELLED}, t AS (SELECT DISTINCT lang, n_chars AS thr FROM l UNION SELECT DISTINCT lang, 0 FROM l),
      s AS (SELECT t.lang, thr, count(*) FILTER (WHERE quality = 1 AND n_chars > thr) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars > thr) AS fp, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS n FROM t JOIN l ON l.lang = t.lang GROUP BY ALL)
      SELECT lang, arg_min(tp::DOUBLE / p, thr) FILTER (WHERE p > 0 AND n > 0 AND fp::DOUBLE / n <= 0.10) AS recall FROM s GROUP BY lang""",
    "q_paired_stats": f"""WITH {_LABELLED} SELECT lang, count(*) AS areas, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality <> 1) AS clean,
      avg((n_chars % 7 > 0)::INT) FILTER (WHERE quality <> 1) AS flag_rate_a, avg((doc_id % 5 > 0)::INT) FILTER (WHERE quality <> 1) AS flag_rate_b, avg((n_chars % 7 > 0)::INT) FILTER (WHERE quality = 1) AS recall_a, avg((doc_id % 5 > 0)::INT) FILTER (WHERE quality = 1) AS recall_b FROM l GROUP BY lang""",
    "q_bootstrap_ci": f"""WITH {_LABELLED}, u AS (SELECT source, r.range AS replicate, {_POISSON} FROM (SELECT DISTINCT source FROM l), range(2000) r),
      x AS (SELECT replicate, w, quality, n_chars AS a, (n_chars * 7 + doc_id) % 1009 AS b FROM l JOIN u USING (source) WHERE w > 0),
      ra AS ({_auc_sql("replicate", "x", "a", "w")}), rb AS ({_auc_sql("replicate", "x", "b", "w")}),
      d AS (SELECT list_sort(list(rb.auc - ra.auc)) AS d FROM ra JOIN rb USING (replicate) WHERE ra.auc IS NOT NULL AND rb.auc IS NOT NULL)
      SELECT len(d) AS replicates, d[floor(0.025 * len(d))::INT + 1] AS low, d[floor(0.975 * len(d))::INT] AS high FROM d""",
    "q_eval_summary": f"WITH {_GRADED} SELECT lang, {_SUMMARY}, median(pred - truth) AS median_error, count(*) FILTER (WHERE pred >= truth) AS ceiling_ok FROM g WHERE pred IS NOT NULL GROUP BY lang",
    "q_blind_summary": f"WITH {_GRADED} SELECT source, {_SUMMARY} FROM g WHERE pred IS NOT NULL GROUP BY source",
    "q_repeat_agreement": f"WITH {_GRADED}, p AS (SELECT lang, item, max(pred) - min(pred) AS spread FROM g WHERE pred IS NOT NULL GROUP BY lang, item HAVING count(*) > 1) SELECT lang, count(*) AS items, count(*) FILTER (WHERE spread < 0.01) AS identical, avg(spread) AS mean_spread FROM p GROUP BY lang",
    "q_true_to_answers": f"WITH {_GRADED} SELECT truth, string_agg(p, ',' ORDER BY p::DECIMAL(6,1)) AS answers FROM (SELECT truth, pred::DECIMAL(6,1)::VARCHAR AS p FROM g WHERE pred IS NOT NULL) GROUP BY truth",
    "q_status_rollup": "SELECT user_id, arg_max(event_type, CASE event_type WHEN 'error' THEN '3' WHEN 'purchase' THEN '2' WHEN 'click' THEN '1' ELSE '0' END || event_type) AS verdict, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id",
}
