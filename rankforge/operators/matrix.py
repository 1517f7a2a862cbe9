"""Sparse matrix aggregation: a row is a non-zero (gene, cell, value).

Zeros are never stored, so means divide by the number of cells from the
metadata, not by the number of rows.  Aggregates combine before they shuffle;
metadata join as dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sums(cells: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Pseudobulk: the sum of a gene over each group."""
    return cells.groupBy("gene", *by).agg(F.sum(value).alias("total"))


def group_means(cells: DataFrame, sizes: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """gene, by, mean over all cells of the group; `sizes` has by and n_cells."""
    return group_sums(cells, by, value).join(sizes, list(by)).select("gene", *by, (F.col("total") / F.col("n_cells")).alias("mean"))


def cell_summary(cells: DataFrame, n_cells: Column, value: str = "value") -> DataFrame:
    """gene, fraction_positive, mean_per_cell, with all cells in the denominator."""
    return cells.groupBy("gene").agg((F.count_if(F.col(value) > 0) / n_cells).alias("fraction_positive"), (F.sum(value) / n_cells).alias("mean_per_cell"))


def cpm(sums: DataFrame, sample: str = "sample", log: str | None = "log1p") -> DataFrame:
    """Adds cpm (counts per million of the sample's library) and its log: log1p, log2 (of x + 1) or none."""
    library = sums.groupBy(sample).agg(F.greatest(F.sum("total"), F.lit(1.0)).alias("library"))
    out = sums.join(library, sample).withColumn("cpm", F.col("total") / F.col("library") * 1e6)
    if log == "log1p":
        out = out.withColumn("log_cpm", F.log1p("cpm"))
    elif log == "log2":
        out = out.withColumn("log_cpm", F.log2(F.col("cpm") + 1))
    return out.drop("library")


def contrast(samples: DataFrame, first: Column, second: Column, n_first: Column, n_second: Column, value: str = "log_cpm") -> DataFrame:
    """gene, delta: mean over the first group's samples minus the second's, NULL if one has none.

    A gene without a row in a sample counts zero there, so the denominators are
    the groups' numbers of samples.
    """
    mean = lambda cond, n: F.when(n > 0, F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0)) / n)
    return samples.groupBy("gene").agg((mean(first, n_first) - mean(second, n_second)).alias("delta"))


def specificity(means: DataFrame, group: str) -> DataFrame:
    """gene, specificity (largest share of the group means), dominant (its group; the first by name on ties)."""
    best = F.max_by(group, F.struct("mean", (-F.col("rank")).alias("r")))
    names = means.select(group).distinct().withColumn("rank", F.row_number().over(Window.orderBy(group)))
    ranked = means.join(names, group)
    return ranked.groupBy("gene").agg((F.max("mean") / F.greatest(F.sum("mean"), F.lit(1e-12))).alias("specificity"), best.alias("dominant"))


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, centrality: neighbours / (nodes - 1) of the undirected graph; a loop counts twice; 1 for a graph of one node.

    With `nodes`, those absent from the graph have 0.
    """
    clean = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = clean.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = degree.agg(F.count(F.lit(1)).alias("n"))
    out = degree.join(n).select("node", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))
    if nodes is None:
        return out
    return nodes.select("node").join(out, "node", "left").select("node", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
