"""Ranks, rank metrics and calibration as aggregates.

Every ranked frame has a label `y` (0 or 1), a score and a column `ord` that
breaks ties.  Metrics that only depend on score groups aggregate by score first;
top-k metrics keep k rows per group before anything is shuffled.  None sorts an
unbounded group in one task: running sums of groups with many distinct scores and
exact positions are made inside of range partitions and over their totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import settle

#: Distinct values of a group that one window may sum.
WINDOW_ROWS = 1 << 20


def _keys(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


def top(df: DataFrame, by: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """The k best rows of each group with their rank `rn`; the planner limits groups before the shuffle."""
    order = Window.partitionBy(*(_keys(by) or [F.lit(0)])).orderBy(F.desc(score), F.asc("ord"))
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def _totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))


def precision_recall_at(df: DataFrame, by: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """by, n, positives, precision, recall; k counts at most the group's rows."""
    hits = top(df, by, k, score).groupBy(*by).agg(F.sum("y").cast("double").alias("hits"), F.count(F.lit(1)).alias("taken"))
    both = _totals(df, by).join(hits, list(by)) if by else _totals(df, by).join(hits)
    return both.select(*by, "n", "positives", (F.col("hits") / F.col("taken")).alias("precision"), F.try_divide("hits", "positives").alias("recall"))


def reciprocal_rank(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, rr: one over the rank of the first positive, found by counting the rows before it; no positive gives no row."""
    place = F.struct((-F.col(score)).alias("s"), F.col("ord").alias("o"))
    first = df.where("y = 1").groupBy(*by).agg(F.min(place).alias("first")).where("first IS NOT NULL")
    joined = df.join(first, list(by)) if by else df.join(first)
    before = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(place < F.col("first")).alias("before")).where("n > 0")
    return before.select(*by, (1.0 / (1 + F.col("before"))).alias("rr"))


def running(steps: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], descending: bool = False, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds, as `sums` names them, the sums of columns over all rows of the group that come before.

    `steps` has one row for each (group, order value).  Groups of at most `most`
    rows are summed by one window each.  Where any has more, the rows lie in range
    partitions of the group and the value; a window sums inside of a partition, and
    another one over the partitions' totals.  Both give the same.
    """
    held = settle(steps)
    turn = F.desc if descending else F.asc
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    keys = _keys(by) or [F.lit(0)]
    largest = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (largest[0] or 0) <= most:
        return held.withColumns({name: before(c, Window.partitionBy(*keys).orderBy(turn(order))) for c, name in sums.items()})
    parts = max(2, -(-largest[1] // most))
    placed = settle(held.repartitionByRange(parts, *by, turn(order)).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    across = Window.partitionBy(*keys).orderBy("__part")
    totals = totals.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate([*by, "__part"])], *[before(f"__{c}", across).alias(f"__{name}") for c, name in sums.items()])
    inside = Window.partitionBy(*by, "__part").orderBy(turn(order))
    inner = placed.withColumns({name: before(c, inside) for c, name in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate([*by, "__part"])]
    joined = inner.join(totals, reduce(lambda a, b: a & b, same))
    return joined.select(*steps.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in sums.values()])


def average_precision(df: DataFrame, by: Sequence[str], score: str = "score", weight: Column | None = None) -> DataFrame:
    """by, auprc; tied scores are one threshold; `weight` is each row's multiplicity; no positive gives no row."""
    weight = F.lit(1) if weight is None else weight
    steps = df.groupBy(*by, score).agg(F.sum(F.col("y") * weight).cast("double").alias("tp"), F.sum(weight).cast("double").alias("n"))
    steps = running(steps, by, score, {"tp": "tp_before", "n": "n_before"}, descending=True)
    precision = (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n"))
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("tp") * precision), F.sum("tp")).alias("auprc")).where("auprc IS NOT NULL")


def auroc(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, auroc from mid-ranks; a group of one class has NULL."""
    steps = df.groupBy(*by, score).agg(F.sum("y").cast("double").alias("tp"), F.sum(1.0 - F.col("y")).alias("fp"))
    steps = running(steps, by, score, {"fp": "fp_before"})
    won = F.sum(F.col("tp") * (F.col("fp_before") + F.col("fp") / 2))
    return steps.groupBy(*by).agg(F.try_divide(won, F.sum("tp") * F.sum("fp")).alias("auroc"))


def bin_edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(1, bins)]


def calibration_error(df: DataFrame, by: Sequence[str], probability: str = "p", bins: int = 10) -> DataFrame:
    """by, ece over equal-width bins whose last is closed; empty bins don't count."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    at = F.size(F.filter(edges, lambda e: e <= F.col(probability)))
    cells = df.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("seen"), F.avg(probability).alias("said"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("seen") - F.col("said"))) / F.sum("n")).alias("ece"))


def brier_and_log_loss(df: DataFrame, by: Sequence[str], probability: str = "p", floor: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col(probability), F.lit(1 - floor)), F.lit(floor))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(probability) - F.col("y"), F.lit(2))).alias("brier"), F.avg(loss).alias("log_loss"))


def position(df: DataFrame, by: Sequence[str], order: Sequence[str], rows_per_part: int = 500_000) -> DataFrame:
    """`position` from 0 in the order of (`order`) within each group, without a window over a group.

    Rows are range partitioned; a row's position is its place inside its
    partition plus the sizes of the partitions before.
    """
    cut = settle(df)
    parts = max(1, -(-cut.count() // rows_per_part))
    placed = settle(cut.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(_keys(by) or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", *by).orderBy(*order)
    placed = placed.withColumn("__in", F.row_number().over(inside) - 1)
    return placed.join(sizes, [*by, "__part"]).withColumn("position", F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "percentile_rank") -> DataFrame:
    """position / (n - 1), ties split by `ord`."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    ranked = position(df, by, [value, "ord"])
    joined = ranked.join(n, list(by)) if by else ranked.join(n)
    return joined.withColumn(name, F.col("position") / F.greatest(F.col("__rows") - 1, F.lit(1))).drop("position", "__rows")


def tied_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean rank of each value among the group's rows, from counts by value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    ranks = running(counts, by, value, {"__n": "__below"}).select(*by, value, (F.col("__below") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """by, n, spearman over rows where both are finite; NULL below three rows or where one is constant."""
    valid = df.where(_finite(left) & _finite(right))
    ranked = tied_rank(tied_rank(valid, by, left, "__left"), by, right, "__right")
    # not corr(): under ANSI it fails where one side is constant
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("__left", "__right").alias("c"), (F.stddev_pop("__left") * F.stddev_pop("__right")).alias("s"))
    return out.select(*by, "n", F.when(F.col("n") >= 3, F.try_divide("c", "s")).alias("spearman"))


def _finite(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def signed_top_overlap(df: DataFrame, prediction: str, truth: str, most: int = 500) -> DataFrame:
    """overlap, direction of the `most` largest absolute values of both columns; zeros without overlap."""
    largest = lambda c: top(df.select("ord", prediction, truth, F.abs(c).alias("__size")), [], most, "__size")
    both = largest(prediction).join(largest(truth).select("ord"), "ord")
    hit = (F.signum(prediction) == F.signum(truth)).cast("double")
    got = both.agg(F.count(F.lit(1)).alias("shared"), F.avg(hit).alias("direction"))
    return got.join(df.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("k"))).select((F.col("shared") / F.col("k")).alias("overlap"), F.coalesce("direction", F.lit(0.0)).alias("direction"))


def interval_state(lower: Column, upper: Column) -> Column:
    return (
        F.when(lower.isNull() | upper.isNull(), "NOT_COMPUTED").when(lower > 0, "DETECTABLE_GAIN").when(upper < 0, "DETECTABLE_LOSS").otherwise("NO_DETECTABLE_DIFFERENCE")
    )


def per_effort(gain: Column, effort: Column) -> Column:
    """Gain per unit of effort, NULL without effort."""
    return F.when(effort > 0, gain / effort)


def metric_bundle(df: DataFrame, by: Sequence[str], k: int = 20, score: str = "score") -> DataFrame:
    """by, precision, recall, rr, auprc."""
    parts = [precision_recall_at(df, by, k, score).drop("n", "positives"), reciprocal_rank(df, by, score), average_precision(df, by, score)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(by)) if by else out.join(part)
    return out
