"""Connected components of an edge list by alternating star operations.

Each round joins every node's larger neighbours, then its smaller ones, to the
least node it knows, until nothing changes; the number of rounds is about
logarithmic in the longest path.  Edges are aggregated before they are shuffled,
every round is checkpointed, and nothing but a count and a checksum reaches the
driver.  A list of at most `ONE_TASK` edges is worked on in one partition, where
the same steps need no exchange.  Self-loops and repeated edges are harmless; an edge with a null end is
ignored; an empty list has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import count_rows, settle

#: Edges up to which one task does the work.
ONE_TASK = 50_000


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root) for all nodes but the roots; a root is its component's least node."""
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"))
    few = count_rows(now) <= ONE_TASK
    now = now.coalesce(1).distinct() if few else settle(now.distinct())
    before = None
    while (state := _sum(now)) != before:
        before = state
        both = _ends(now, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        now = settle(_ends(large.join(lowest, "u"), ("v", "m"), ("u", "m")).distinct())
        now = now.coalesce(1) if few else now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _ends(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each of the pairs of columns, loops left out."""
    both = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return rows.select(F.explode(both).alias("e")).select("e.u", "e.v").where("u != v")
