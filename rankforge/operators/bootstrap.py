"""Bootstrap intervals: exact replicates of rows and of clusters.

Draws are hashes of (seed, replicate, position), so they can be repeated anywhere.
`replicates` makes them and computes metrics over them; here are intervals, paired
differences and whole clusters.  `poisson_weights` is an approximation that needs
no numbering of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalar import uniform
from rankforge.operators import replicates as exact
from rankforge.operators.ranking import position
from rankforge.session import settle

#: A one-class draw of clusters is drawn anew so many times at most, all but the first in these rounds.
ATTEMPTS = (1, 7, 42)


def poisson_weights(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Approximate resampling: every row times a Poisson(1) count, zeros left out."""
    cells = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = uniform(F.concat_ws("|", "replicate", "ord"), seed)
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    return cells.withColumn("times", F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= u))).where("times > 0")


def interval(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, lower, upper, valid: the 2.5 and 97.5 percentiles over the replicates there are."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(q.alias("q"), F.count(value).alias("valid")).select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "valid")


def auprc_interval(df: DataFrame, scores: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """method, lower, upper, valid of the average precision; replicates without a positive have none."""
    return interval(exact.replicate_metrics(df, {s: s for s in scores}, [exact.AVERAGE_PRECISION], replicates, seed), ["method"], "value")


def paired_difference(df: DataFrame, score: str, reference: str, replicates: int, seed: int, metric: exact.Metric = exact.AVERAGE_PRECISION) -> DataFrame:
    """replicate, difference of a metric on the same draws."""
    both = exact.replicate_metrics(df, {"a": score, "b": reference}, [metric], replicates, seed)
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    return both.groupBy("replicate").agg((side("a") - side("b")).alias("difference")).where("difference IS NOT NULL")


def cluster_draws(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, cluster, times: whole clusters drawn with replacement, both classes in every replicate.

    `clusters` has cluster, without repeats, and the booleans yes and no: whether it
    has rows of each class.  A draw of one class is drawn anew; its first valid
    attempt counts, and a replicate without one among all attempts is an error.
    """
    spark = clusters.sparkSession
    numbered = settle(position(clusters.select("cluster", "yes", "no"), [], ["cluster"]))
    n, left, first, found = numbered.count(), list(range(replicates)), 0, []
    for attempts in ATTEMPTS:
        ids = [(r, a) for r in left for a in range(first, first + attempts)]
        draws = exact.draw(spark, n, [a * replicates + r for r, a in ids], seed)
        names = F.broadcast(spark.createDataFrame([(k, *i) for k, i in enumerate(ids)], "replicate long, of long, attempt long"))
        drawn = exact.counts(numbered, draws).groupBy("replicate", "position").agg(F.sum("times").alias("times"))
        drawn = settle(drawn.join(numbered, "position").join(names, "replicate").select(F.col("of").alias("replicate"), "attempt", "cluster", "times", "yes", "no"))
        valid = drawn.groupBy("replicate", "attempt").agg(F.max("yes").alias("y"), F.max("no").alias("n")).where("y AND n")
        valid = settle(valid.groupBy("replicate").agg(F.min("attempt").alias("attempt")))
        found.append(drawn.join(valid, ["replicate", "attempt"]).select("replicate", "cluster", "times"))
        left = sorted(set(left) - {r["replicate"] for r in valid.select("replicate").collect()})  # a row for each replicate
        first += attempts
        if not left:
            break
    else:
        raise ValueError(f"{len(left)} of {replicates} replicates have one class only after {first} attempts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cluster_contrast(values: DataFrame, draws: DataFrame) -> DataFrame:
    """replicate, entity, delta: weighted mean of `value` over responders minus non-responders.

    `values` has cluster, entity, responder (boolean), value; an entity that a draw
    sees in one class only gets no row there.
    """
    weighted = values.join(draws, "cluster").groupBy("replicate", "entity")
    side = lambda yes: F.try_divide(
        F.sum(F.when(F.col("responder") == yes, F.col("value") * F.col("times"))), F.sum(F.when(F.col("responder") == yes, F.col("times")))
    )
    return weighted.agg((side(F.lit(True)) - side(F.lit(False))).alias("delta")).where("delta IS NOT NULL")
