"""Rank metrics, calibration, intervals and comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.operators import bootstrap, ranking, replicates
from rankforge.plans.base import SCORED, UNIVERSE, query, scored, universe
from rankforge.session import rounded

_RANKED = SCORED + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, ord) AS rn FROM scored
)"""
_AP = """steps AS (
  SELECT {by}, {score} AS s, CAST(sum(y{w}) AS DOUBLE) AS tp, CAST(sum(1{w}) AS DOUBLE) AS n FROM {table} GROUP BY {by}, {score}
), summed AS (
  SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY s DESC) AS ctp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC) AS cn FROM steps
), ap AS (
  SELECT {by}, sum(tp * ctp / cn) / sum(tp) AS auprc FROM summed GROUP BY {by} HAVING sum(tp) > 0
)"""


def ap_sql(table: str, by: str, score: str, weight: str = "") -> str:
    return _AP.format(table=table, by=by, score=score, w=f" * {weight}" if weight else "")


@query("flagship_context_auprc", f"WITH {UNIVERSE}, {ap_sql('universe', 'segment', 'score')} SELECT segment, round(auprc, 9) AS auprc FROM ap")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Does popularity before the cutoff rank the parts that enter a segment after it?"""
    return ranking.average_precision(universe(spark, sf), ["segment"]).select("segment", rounded("auprc").alias("auprc"))


@query(
    "r01_precision_at_k",
    f"WITH {_RANKED} SELECT context, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y) FILTER (rn <= 20), 9) AS precision FROM ranked GROUP BY 1",
)
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.precision_recall_at(scored(spark, sf), ["context"], 20).select("context", "n", "positives", rounded("precision").alias("precision"))


@query("r02_recall_at_k", f"WITH {_RANKED} SELECT context, round(sum(y) FILTER (rn <= 50) / CAST(sum(y) AS DOUBLE), 9) AS recall FROM ranked GROUP BY 1")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.precision_recall_at(scored(spark, sf), ["context"], 50).select("context", rounded("recall").alias("recall"))


@query("r03_reciprocal_rank", f"WITH {_RANKED} SELECT context, round(1.0::DOUBLE / min(rn) FILTER (y = 1), 9) AS rr FROM ranked GROUP BY 1")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.reciprocal_rank(scored(spark, sf), ["context"]).select("context", rounded("rr").alias("rr"))


@query("r04_average_precision", f"WITH {SCORED}, {ap_sql('scored', 'context', 'score')} SELECT context, round(auprc, 9) AS auprc FROM ap")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.average_precision(scored(spark, sf), ["context"]).select("context", rounded("auprc").alias("auprc"))


_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in ranking.bin_edges(10)) + "]"


@query(
    "r05_calibration_error",
    f"""WITH {SCORED}, cells AS (
  SELECT context, len(list_filter({_EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, avg(y) AS seen, avg(p) AS said FROM scored GROUP BY 1, 2
) SELECT context, round(sum(n * abs(seen - said)) / sum(n), 9) AS ece FROM cells GROUP BY 1""",
)
def r05(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.calibration_error(scored(spark, sf), ["context"]).select("context", rounded("ece").alias("ece"))


@query(
    "r06_metric_bundle",
    f"""WITH {_RANKED}, {ap_sql('scored', 'context', 'score')}
SELECT context, round(avg(y) FILTER (rn <= 20), 9) AS precision, round(sum(y) FILTER (rn <= 20) / CAST(sum(y) AS DOUBLE), 9) AS recall,
       round(1.0::DOUBLE / min(rn) FILTER (y = 1), 9) AS rr, round(any_value(auprc), 9) AS auprc
FROM ranked JOIN ap USING (context) GROUP BY 1""",
)
def r06(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.metric_bundle(scored(spark, sf), ["context"])
    return out.select("context", *[rounded(c).alias(c) for c in ("precision", "recall", "rr", "auprc")])


REPLICATES, SEED = 400, 11
_DRAWN = replicates.draws_sql("scored", REPLICATES, SEED)
_INTERVAL = "round(quantile_cont({0}, 0.025), 9) AS lower, round(quantile_cont({0}, 0.975), 9) AS upper, count(*) AS valid"


@query(
    "r07_bootstrap_interval",
    f"WITH {SCORED}, {_DRAWN}, {ap_sql('drawn', 'replicate', 'score', 'times')} SELECT 'score' AS method, {_INTERVAL.format('auprc')} FROM ap",
)
def r07(spark: SparkSession, sf: str) -> DataFrame:
    out = bootstrap.auprc_interval(scored(spark, sf), ["score"], REPLICATES, SEED)
    return out.select("method", rounded("lower").alias("lower"), rounded("upper").alias("upper"), "valid")


def _best_f1(t: replicates.Thresholds) -> np.ndarray:
    """The best F1 over the thresholds of a part."""
    return (2 * t.upto_positives / np.maximum(t.upto_rows + t.all_positives, 1)).max(1)


#: A metric of the caller's own, merged by the maximum.
BEST_F1 = replicates.Metric("best_f1", _best_f1, lambda m, p, n: np.where(p > 0, m, np.nan), "max")

_SUMMED = """steps AS (
  SELECT replicate, p AS s, CAST(sum(y * times) AS DOUBLE) AS tp, CAST(sum(times) AS DOUBLE) AS n FROM drawn GROUP BY 1, 2
), summed AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY replicate) AS tpos, sum(n) OVER (PARTITION BY replicate) AS rows
  FROM steps WINDOW w AS (PARTITION BY replicate ORDER BY s DESC)
)"""
_OWN = {
    "auroc": "CASE WHEN any_value(tpos) > 0 AND any_value(tpos) < any_value(rows) THEN sum((n - tp) * (ctp - tp / 2)) / (any_value(tpos) * (any_value(rows) - any_value(tpos))) END",
    "brier": "sum(tp * (1 - s) * (1 - s) + (n - tp) * s * s) / any_value(rows)",
    "best_f1": "CASE WHEN any_value(tpos) > 0 THEN max(2 * ctp / (cn + tpos)) END",
}


def _own_interval(spark: SparkSession, sf: str, metric: replicates.Metric) -> DataFrame:
    values = replicates.replicate_metrics(scored(spark, sf), {"p": "p"}, [metric], REPLICATES, SEED)
    return bootstrap.interval(values, ["metric"], "value").select("metric", rounded("lower").alias("lower"), rounded("upper").alias("upper"), "valid")


def _own_sql(name: str) -> str:
    return f"WITH {SCORED}, {_DRAWN}, {_SUMMED}, each AS (SELECT replicate, {_OWN[name]} AS value FROM summed GROUP BY 1) SELECT '{name}' AS metric, {_INTERVAL.format('value')} FROM each WHERE value IS NOT NULL"


@query("r07_bootstrap_auroc", _own_sql("auroc"))
def r07_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return _own_interval(spark, sf, replicates.AUROC)


@query("r07_bootstrap_brier", _own_sql("brier"))
def r07_brier(spark: SparkSession, sf: str) -> DataFrame:
    return _own_interval(spark, sf, replicates.BRIER)


@query("r07_bootstrap_own_metric", _own_sql("best_f1"))
def r07_own(spark: SparkSession, sf: str) -> DataFrame:
    """A metric that the caller brings along."""
    return _own_interval(spark, sf, BEST_F1)


_PAIRED = f"""WITH {SCORED}, {_DRAWN}, {ap_sql('drawn', 'replicate', 'alt', 'times').replace('steps', 'steps_a').replace('summed', 'summed_a').replace('ap AS', 'ap_a AS')},
{ap_sql('drawn', 'replicate', 'score', 'times').replace('steps', 'steps_b').replace('summed', 'summed_b').replace('ap AS', 'ap_b AS')},
diff AS (SELECT replicate, a.auprc - b.auprc AS difference FROM ap_a a JOIN ap_b b USING (replicate))"""


@query("r08_paired_difference", f"{_PAIRED} SELECT {_INTERVAL.format('difference')} FROM diff")
def r08(spark: SparkSession, sf: str) -> DataFrame:
    diff = bootstrap.paired_difference(scored(spark, sf), "alt", "score", REPLICATES, SEED)
    return bootstrap.interval(diff, [], "difference").select(rounded("lower").alias("lower"), rounded("upper").alias("upper"), "valid")


@query(
    "r09_comparison_state",
    f"""{_PAIRED}, i AS (SELECT quantile_cont(difference, 0.025) AS lower, quantile_cont(difference, 0.975) AS upper FROM diff)
SELECT CASE WHEN lower IS NULL OR upper IS NULL THEN 'NOT_COMPUTED' WHEN lower > 0 THEN 'DETECTABLE_GAIN' WHEN upper < 0 THEN 'DETECTABLE_LOSS'
       ELSE 'NO_DETECTABLE_DIFFERENCE' END AS state FROM i""",
)
def r09(spark: SparkSession, sf: str) -> DataFrame:
    diff = bootstrap.paired_difference(scored(spark, sf), "alt", "score", REPLICATES, SEED)
    return bootstrap.interval(diff, [], "difference").select(ranking.interval_state(F.col("lower"), F.col("upper")).alias("state"))


@query(
    "r10_label_check",
    f"""WITH {SCORED} SELECT context, count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS not_binary, CAST(sum(y) AS BIGINT) AS positives,
       CASE WHEN count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) = 0 AND sum(y) > 0 THEN 'OK' ELSE 'ABSTAIN' END AS state FROM scored GROUP BY 1""",
)
def r10(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1))
    out = scored(spark, sf).groupBy("context").agg(bad.alias("not_binary"), F.sum("y").cast("long").alias("positives"))
    return out.withColumn("state", F.when((F.col("not_binary") == 0) & (F.col("positives") > 0), "OK").otherwise("ABSTAIN"))


@query(
    "r11_excess_per_effort",
    f"""WITH {SCORED}, {ap_sql('scored', 'context', 'alt').replace('steps', 'steps_a').replace('summed', 'summed_a').replace('ap AS', 'ap_a AS')},
{ap_sql('scored', 'context', 'score').replace('steps', 'steps_b').replace('summed', 'summed_b').replace('ap AS', 'ap_b AS')}
SELECT context, round(a.auprc - b.auprc, 9) AS excess, round((a.auprc - b.auprc) / nullif(length(context) - 2.0::DOUBLE, 0), 9) AS per_gpu_hour,
       round((a.auprc - b.auprc) / 3, 9) AS per_configuration
FROM ap_a a JOIN ap_b b USING (context)""",
)
def r11(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    a = ranking.average_precision(rows, ["context"], "alt").withColumnRenamed("auprc", "a")
    both = a.join(ranking.average_precision(rows, ["context"], "score"), "context").withColumn("excess", F.col("a") - F.col("auprc"))
    gpu = (F.length("context") - 2).cast("double")
    return both.select(
        "context", rounded("excess").alias("excess"), rounded(ranking.per_effort(F.col("excess"), gpu)).alias("per_gpu_hour"),
        rounded(ranking.per_effort(F.col("excess"), F.lit(3))).alias("per_configuration"),
    )


@query(
    "r12_macro_metrics",
    f"""WITH {_RANKED}, {ap_sql('scored', 'context', 'score')}, mid AS (
  SELECT context, score, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2
), below AS (
  SELECT *, coalesce(sum(n - tp) OVER (PARTITION BY context ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM mid
), roc AS (
  SELECT context, sum(tp * (nb + (n - tp) / 2)) / nullif(sum(tp) * sum(n - tp), 0) AS auroc FROM below GROUP BY 1
), per AS (
  SELECT context, avg(y) FILTER (rn <= 10) AS p10, sum(y) FILTER (rn <= 100) / CAST(sum(y) AS DOUBLE) AS r100, 1.0::DOUBLE / min(rn) FILTER (y = 1) AS rr,
         avg(pow(p - y, 2)) AS brier, avg(-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END) AS log_loss
  FROM ranked GROUP BY 1
) SELECT round(avg(p10), 9) AS macro_p10, round(avg(r100), 9) AS macro_r100, round(avg(rr), 9) AS macro_mrr, round(avg(auroc), 9) AS macro_auroc,
         round(avg(brier), 9) AS macro_brier, round(avg(log_loss), 6) AS macro_log_loss, round(avg(auprc), 9) AS macro_auprc
FROM per JOIN roc USING (context) JOIN ap USING (context)""",
)
def r12(spark: SparkSession, sf: str) -> DataFrame:
    rows, by = scored(spark, sf), ["context"]
    parts = [
        ranking.precision_recall_at(rows, by, 10).select("context", F.col("precision").alias("p10")),
        ranking.precision_recall_at(rows, by, 100).select("context", F.col("recall").alias("r100")),
        ranking.reciprocal_rank(rows, by), ranking.auroc(rows, by), ranking.brier_and_log_loss(rows, by), ranking.average_precision(rows, by),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by)
    names = {"p10": "macro_p10", "r100": "macro_r100", "rr": "macro_mrr", "auroc": "macro_auroc", "brier": "macro_brier", "log_loss": "macro_log_loss", "auprc": "macro_auprc"}
    return out.agg(*[rounded(F.avg(a), 6 if a == "log_loss" else 9).alias(b) for a, b in names.items()])


_TIED = """, l AS (
  SELECT *, rank() OVER (PARTITION BY context ORDER BY score) + (count(*) OVER (PARTITION BY context, score) - 1) / 2.0::DOUBLE AS rl,
         rank() OVER (PARTITION BY context ORDER BY p) + (count(*) OVER (PARTITION BY context, p) - 1) / 2.0::DOUBLE AS rr
  FROM scored
)"""


@query("r13_spearman", f"WITH {SCORED}{_TIED} SELECT context, count(*) AS n, round(corr(rl, rr), 9) AS spearman FROM l GROUP BY 1")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.spearman(scored(spark, sf), ["context"], "score", "p").select("context", "n", rounded("spearman").alias("spearman"))


@query(
    "r14_signed_top_overlap",
    f"""WITH {SCORED}, v AS (SELECT ord, score - 4 AS a, alt - 3000 AS b FROM scored),
ra AS (SELECT *, row_number() OVER (ORDER BY abs(a) DESC, ord) AS x, row_number() OVER (ORDER BY abs(b) DESC, ord) AS z FROM v)
SELECT round(count(*) FILTER (x <= 100 AND z <= 100) / least(count(*), 100)::DOUBLE, 9) AS overlap,
       round(coalesce(avg((sign(a) = sign(b))::INTEGER) FILTER (x <= 100 AND z <= 100), 0), 9) AS direction FROM ra""",
)
def r14(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("ord", (F.col("score") - 4).alias("a"), (F.col("alt") - 3000).alias("b"))
    return ranking.signed_top_overlap(rows, "a", "b", 100).select(rounded("overlap").alias("overlap"), rounded("direction").alias("direction"))


@query(
    "r17_fraction_positive_difference",
    f"{_PAIRED} SELECT round(avg((difference > 0)::INTEGER), 9) AS fraction, count(*) AS replicates FROM diff",
)
def r17(spark: SparkSession, sf: str) -> DataFrame:
    diff = bootstrap.paired_difference(scored(spark, sf), "alt", "score", REPLICATES, SEED)
    return diff.agg(rounded(F.avg((F.col("difference") > 0).cast("double"))).alias("fraction"), F.count(F.lit(1)).alias("replicates"))


@query(
    "w01_percentile_rank",
    f"WITH {SCORED} SELECT ord, context, round((row_number() OVER (PARTITION BY context ORDER BY score, ord) - 1) / greatest(count(*) OVER (PARTITION BY context) - 1, 1)::DOUBLE, 9) AS percentile_rank FROM scored",
)
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.percentile_rank(scored(spark, sf), ["context"], "score").select("ord", "context", rounded("percentile_rank").alias("percentile_rank"))


@query(
    "w07_largest_share",
    f"WITH {SCORED} SELECT ord, alt FROM (SELECT *, row_number() OVER (ORDER BY alt DESC, ord) AS rn, count(*) OVER () AS n FROM scored) WHERE rn <= greatest(20, n * 5 // 100)",
)
def w07(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    return rows.orderBy(F.desc("alt"), "ord").limit(max(20, rows.count() * 5 // 100)).select("ord", "alt")


@query("w08_total_order", f"WITH {SCORED} SELECT ord, context, alt FROM scored ORDER BY alt DESC, ord LIMIT 1000")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).orderBy(F.desc("alt"), "ord").limit(1000).select("ord", "context", "alt")


@query(
    "w10_best_configuration",
    f"WITH {SCORED}, t AS (SELECT context, y, avg(alt) AS value FROM scored GROUP BY 1, 2) SELECT context, arg_max(y, value) AS best, round(max(value), 6) AS value FROM t GROUP BY 1",
)
def w10(spark: SparkSession, sf: str) -> DataFrame:
    per = scored(spark, sf).groupBy("context", "y").agg(F.avg("alt").alias("value"))
    return per.groupBy("context").agg(F.max_by("y", F.struct("value", -F.col("y"))).alias("best"), rounded(F.max("value"), 6).alias("value"))


@query(
    "a15_interval_by_method",
    f"WITH {SCORED} SELECT context, round(quantile_cont(alt, 0.025), 9) AS lower, round(quantile_cont(alt, 0.5), 9) AS middle, round(quantile_cont(alt, 0.975), 9) AS upper FROM scored GROUP BY 1",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile("alt", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = scored(spark, sf).groupBy("context").agg(q.alias("q"))
    return out.select("context", *[rounded(F.col("q")[i]).alias(n) for i, n in enumerate(("lower", "middle", "upper"))])


@query("a16_min_median_max", f"WITH {SCORED} SELECT context, min(alt) AS low, round(median(alt), 9) AS middle, max(alt) AS high FROM scored GROUP BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("context").agg(F.min("alt").alias("low"), rounded(F.percentile("alt", 0.5)).alias("middle"), F.max("alt").alias("high"))


@query(
    "w02_forward_fill",
    "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events",
)
def w02(spark: SparkSession, sf: str) -> DataFrame:
    from rankforge.session import table

    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sparse = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", "user_id", F.last(sparse, ignorenulls=True).over(upto).alias("filled"))
