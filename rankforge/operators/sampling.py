"""Splits and samples that depend on keys, not on row order.

Every choice is the order of a SHA-256 digest.  Shares of a group use the exact
rank of the digest (positions across range partitions); caps use a window that
the planner limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalar import order_digest
from rankforge.operators.ranking import position


def at_risk(pre: Column, entry: Column, post: Column) -> Column:
    """Not a historical positive, and either never entered or entered in the window."""
    return (pre == 0) & (entry.isNull() | (post == 1))


def landmark_labels(entry: Column, cutoff: Column, end: Column) -> tuple[Column, Column]:
    """(label before the cutoff, label between cutoff and end)."""
    before = F.coalesce((entry < cutoff).cast("int"), F.lit(0))
    return before, F.coalesce(((entry >= cutoff) & (entry < end)).cast("int"), F.lit(0))


def stratified_split(df: DataFrame, key: str, label: str, seed: int, share: float = 0.7) -> DataFrame:
    """Adds `is_train`: the first round(share * n) rows of each label in digest order."""
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * share + 0.5).alias("__train"))
    ranked = position(df.withColumn("__digest", order_digest(F.col(key), seed)), [label], ["__digest"])
    return ranked.join(sizes, label).withColumn("is_train", F.col("position") < F.col("__train")).drop("__digest", "__train", "position")


def capped_subset(df: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """All positives, and negatives in digest order up to `most` rows in all."""
    positives = df.where(F.col(label) == 1)
    n = positives.count()
    if n > most:
        raise ValueError("the cap is below the number of positives")
    negatives = df.where(F.col(label) == 0).withColumn("__digest", order_digest(F.col(key), seed)).orderBy("__digest").limit(most - n).drop("__digest")
    return positives.unionByName(negatives)


def stratum_sample(df: DataFrame, key: str, strata: Sequence[str], least: int, most: int, seed: int) -> DataFrame:
    """Up to `most` rows of each stratum in digest order; strata under `least` rows drop out."""
    if most < least:
        raise ValueError("the cap is below the minimum")
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata})
    sizes = filled.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    order = Window.partitionBy(*strata).orderBy(order_digest(F.col(key), seed), F.col(key))
    return filled.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= most).drop("__rn").join(sizes, list(strata))


def cover_then_fill(df: DataFrame, key: str, groups: Sequence[str], most: int, seed: int) -> DataFrame:
    """One row of each group first, then any, in digest order, `most` in all."""
    order = Window.partitionBy(*groups).orderBy(order_digest(F.col(key), seed), F.col(key))
    digest = order_digest(F.col(key), seed)
    first = df.withColumn("__rn", F.row_number().over(order)).where("`__rn` = 1").drop("__rn").withColumn("__late", F.lit(0))
    rest = df.join(first.select(key), key, "left_anti").withColumn("__late", F.lit(1))
    both = first.unionByName(rest).withColumn("__digest", digest)
    return both.orderBy("__late", "__digest", key).limit(most).drop("__late", "__digest")


def donor_capped(df: DataFrame, key: str, donor: Column, per_donor: int, most: int, seed: int) -> DataFrame:
    """The first `per_donor` rows of each donor by key, then at most `most` in digest order."""
    order = Window.partitionBy("__donor").orderBy(key)
    capped = df.withColumn("__donor", donor).withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= per_donor)
    return capped.withColumn("__digest", order_digest(F.col(key), seed)).orderBy("__digest", key).limit(most).drop("__donor", "__rn", "__digest")


def balanced_subset(df: DataFrame, key: str, strata: Sequence[str], most: int, seed: int) -> DataFrame:
    """An equal quota of every stratum, topped up from what the strata have beyond it."""
    n, groups = df.count(), df.select(*strata).distinct().count()
    if n <= most:
        return df
    quota = max(1, most // groups)
    order = Window.partitionBy(*strata).orderBy(order_digest(F.col(key), seed), F.col(key))
    # beyond its quota a stratum can add `most` rows at most
    ranked = df.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= quota + most)
    digest = order_digest(F.col(key), seed)
    return ranked.orderBy((F.col("__rn") > quota).cast("int"), digest, key).limit(most).drop("__rn")
