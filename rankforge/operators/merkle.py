"""Merkle trees over tables: whether the content changed, and where.

A row's digest covers every field with its length, so fields can't run into each
other.  Rows lie in ranges, by an expression over the columns or by their digest.
Leaves are buckets of a range by the digest's first digits; a leaf digests its rows'
digests with how often each is there, in order, a range its leaves, and the root the
ranges, by way of FAN groups of them.  So content gives the root whatever the order,
the files or the partitions, rows that repeat are counted before they move, and a
range with very many rows is as many leaves' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a digest that name a leaf of a range, groups of ranges under the root.
LEAF_DIGITS, FAN = 2, 1024
BY_DIGEST = "CAST(conv(substring(__digest, 1, 3), 16, 10) AS BIGINT)"


def row_digest(columns: Sequence[str]) -> Column:
    field = lambda c: F.coalesce(F.concat(F.char_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _digest(parts: Column) -> Column:
    """Of a group's strings in order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ",").cast("binary"), 256)


def ranges(df: DataFrame, columns: Sequence[str], by: str = BY_DIGEST) -> DataFrame:
    """range, n_rows, root; `by` is an SQL expression for a long over the columns or __digest."""
    rows = df.withColumn("__digest", row_digest(columns)).select(F.expr(by).cast("long").alias("range"), F.col("__digest").alias("digest"))
    counted = rows.groupBy("range", "digest").agg(F.count(F.lit(1)).alias("n"))
    leaf = F.substring("digest", 1, LEAF_DIGITS)
    leaves = counted.groupBy("range", leaf.alias("leaf")).agg(F.sum("n").alias("n"), _digest(F.concat_ws(":", "digest", F.col("n").cast("string"))).alias("root"))
    return leaves.groupBy("range").agg(F.sum("n").alias("n_rows"), _digest(F.concat_ws(":", "leaf", "root")).alias("root"))


def root(tree: DataFrame) -> DataFrame:
    """n_rows and root of all ranges, one row."""
    named = F.concat_ws(":", F.coalesce(F.format_string("%020d", "range"), F.lit("-")), F.col("n_rows").cast("string"), "root")
    groups = tree.groupBy(F.pmod(F.coalesce("range", F.lit(-1)), F.lit(FAN)).alias("g")).agg(F.sum("n_rows").alias("n"), _digest(named).alias("root"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), _digest(F.concat_ws(":", F.format_string("%05d", "g"), "root")).alias("root"))


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """range, n_before, n_after of the ranges whose content differs; a range that one side lacks has 0 rows there."""
    a = before.select("range", F.col("n_rows").alias("a"), F.col("root").alias("ra"))
    b = after.select(F.col("range").alias("other"), F.col("n_rows").alias("b"), F.col("root").alias("rb"))
    both = a.join(b, F.col("range").eqNullSafe(F.col("other")), "full").where(~F.col("ra").eqNullSafe(F.col("rb")))
    return both.select(F.coalesce("range", "other").alias("range"), F.coalesce("a", F.lit(0)).alias("n_before"), F.coalesce("b", F.lit(0)).alias("n_after"))
