"""What the two vector searches share: valid vectors, blocks and merging.

Both deal all vectors into blocks of bounded size and all queries into blocks of
bounded size; a task holds one of each, so memory doesn't grow with the input,
no pair of rows is ever made by a join, and only the best k of a block leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import settle

#: Vectors in a block, queries in a part.
BLOCK, QUERIES = 4096, 4096
FOUND = "uid long, query_id long, vec_id long, score {score}"


def usable(vector: Column) -> Column:
    """Not null and without a null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=dtype)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def search_blocks(entries: DataFrame, queries: DataFrame, find: Callable, score: str, n_queries: int) -> DataFrame:
    """uid, query_id, vec_id, score from find(entries of a block, queries of a part) as Arrow tables.

    `entries` has a column block, `queries` a column blocks: the blocks that a
    query must see.  A block only goes to the parts with a query that asks for it.
    """
    parts = max(1, -(-n_queries // QUERIES))
    asked = settle(queries.withColumn("block", F.explode("blocks")).drop("blocks").withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")))
    pairs = asked.select(F.col("block").alias("at"), F.col("part").alias("to")).distinct()
    dealt = entries.join(pairs, F.col("block") == F.col("at")).drop("at").withColumnRenamed("to", "part")
    return dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(find, FOUND.format(score=score))


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; a query's rows are at most k per block."""
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def keep_best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best entries, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.searchsorted(owner, owner, side="left")
    return order[np.arange(len(owner)) - start < k]


def as_found(uid, query_id, vec_id, score) -> pa.Table:
    return pa.table({"uid": pa.array(uid, pa.int64()), "query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score)})
