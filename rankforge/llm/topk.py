"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length, longest first, into blocks, and a block into
buckets of `BUCKET` vectors of similar length.  For a query with a known k-th
score t, a vector of bucket b can only matter if its cosine with the query is at
least t / (|q| * longest of b), the bucket's local threshold:

* above 1, the bucket is skipped, and so are all after it;
* from `COORDINATE` on, coordinate pruning: at that cosine a vector's normalised
  component f lies in an interval around q_f's, so only vectors inside the
  intervals of the query's `FOCUS` largest components are verified;
* below, length pruning: only vectors with |v| >= t / |q|, a prefix of the bucket
  for each query (queries go in groups of `TOGETHER` with prefixes of like length).

Survivors are verified with their exact integer products.  Every query starts
with the k-th score among the `SEEDS` longest vectors, which also tells which
blocks it must see at all.

Defined cases: vectors that are null or hold a null, NaN or infinite component
and rows with a null vec_id take no part; components are floor(256 * x) in
double precision; vectors shorter than the longest end in zeros; rows with the
query's own vec_id are its own; repeated rows are candidates each, repeated
query rows count once; ties go to the smaller vec_id; extra columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, settle, table
from rankforge.llm.vectors import BLOCK, as_found, best, keep_best, matrix, search_blocks, usable

K = 5
SCALE = 256
BUCKET = 512
SEEDS = 4096
COORDINATE = 0.55
FOCUS = 3
TOGETHER = 64
_EXACT = float(1 << 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices: in floats where no sum can leave their exact range."""
    width = max(1, a.shape[1])
    if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * width < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, bucket: int = BUCKET, verified: list[int] | None = None):
    """(query position, vec_id, score) of each query's k best, given a lower bound of its k-th score.

    Vectors may come in any order.  The numbers of products made go to `verified`.
    """
    size, asked = lengths(vectors), np.maximum(lengths(queries), 1e-300)
    order = np.argsort(-size, kind="stable")
    ids, vectors, size = ids[order], vectors[order], size[order]
    unit = vectors / np.maximum(size, 1e-300)[:, None]
    unit_q = queries / asked[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    bound = floor.astype(np.float64).copy()
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for begin in range(0, len(ids), bucket):
        part = slice(begin, begin + bucket)
        if size[begin] > 0:
            local = bound / (asked * size[begin])
        else:
            local = np.where(bound > 0, np.inf, -np.inf)
        live = np.flatnonzero(local <= 1 + 1e-9)
        if not len(live):
            continue
        got = [held]
        by_length = live[local[live] < COORDINATE]
        stops = begin + np.searchsorted(-size[part], -np.maximum(0.0, bound[by_length] / asked[by_length]) * (1 - 1e-9), side="right")
        ranked = np.argsort(-stops, kind="stable")
        for at in range(0, len(ranked), TOGETHER):
            some = by_length[ranked[at : at + TOGETHER]]
            stop = stops[ranked[at]]
            if stop == begin:
                break
            score = products(queries[some], vectors[begin:stop])
            q, v = np.nonzero((score >= bound[some][:, None]) & (query_ids[some][:, None] != ids[begin:stop]))
            got.append((some[q], ids[begin:stop][v], score[q, v]))
            if verified is not None:
                verified.append(score.size)
        for q in live[local[live] >= COORDINATE]:
            t = min(1.0, local[q])
            f = focus[q]
            reach = np.sqrt((1 - unit_q[q, f] ** 2).clip(0) * (1 - t * t)) + 1e-9
            here = unit[part][:, f]
            # for t <= |q_f| the interval is one-sided: beyond its far end the cosine only grows
            low, high = unit_q[q, f] * t - reach, unit_q[q, f] * t + reach
            low, high = np.where(t <= -unit_q[q, f], -np.inf, low), np.where(t <= unit_q[q, f], np.inf, high)
            inside = begin + np.flatnonzero(((here >= low) & (here <= high)).all(1) & (ids[part] != query_ids[q]))
            score = products(queries[q : q + 1], vectors[inside])[0]
            good = score >= bound[q]
            if verified is not None:
                verified.append(len(inside))
            got.append((np.full(good.sum(), q), ids[inside[good]], score[good]))
        owner, who, score = (np.concatenate(x) for x in zip(*got, strict=True))
        kept = keep_best(owner, score, who, k)
        held = owner[kept], who[kept], score[kept]
        count = np.bincount(held[0], minlength=len(queries))
        last = np.cumsum(count) - 1
        full = count >= k
        bound[full] = np.maximum(bound[full], held[2][last[full]])
    return held


def top_k(rows: DataFrame, asks: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; `rows` has vec_id and an integer vector in `ints`."""
    rows = settle(rows.where("vec_id IS NOT NULL AND ints IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "ints").withColumn("norm", _norm("ints")))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("ints"))).first()
    width = max(1, width or 0)
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "ints").toArrow()
    seed_ids, seed_vectors = seeds["vec_id"].to_numpy(), matrix(seeds["ints"], width, np.int64)
    # equal lengths are spread by the id's hash, so that they fill several blocks
    blocks = rows.repartitionByRange(max(1, -(-n // BLOCK)), F.desc("norm"), F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id())
    blocks = settle(blocks.select("block", "vec_id", "ints", "norm"))
    # one number for each block: what a query must see is a run of blocks from the first on
    longest = np.array([most for _, most in sorted(tuple(r) for r in blocks.groupBy("block").agg(F.max("norm")).collect())] or [0.0])
    queries = settle(rows.where(asks).select("vec_id", "ints").distinct().select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").alias("query_id"), "ints"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first bound of each query, and the blocks that can pass it."""
        for batch in batches:
            vectors = matrix(batch.column(2), width, np.int64)
            bound = np.full(len(vectors), -np.inf)
            owner, _, score = search(seed_ids, seed_vectors, batch.column(1).to_numpy(), vectors, bound, k)
            count = np.bincount(owner, minlength=len(vectors))
            full = count >= k
            bound[full] = score[(np.cumsum(count) - 1)[full]]
            norm = lengths(vectors)
            least = np.where(bound > 0, bound / np.maximum(norm, 1e-300) / (1 + 1e-9), -1.0)
            see = np.searchsorted(-longest, -least, side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound, pa.float64()), pa.array(see, pa.int32())], names=["uid", "query_id", "ints", "bound", "see"])

    def find(entries: pa.Table, asked: pa.Table) -> pa.Table:
        uid, query_id = asked["uid"].to_numpy(), asked["query_id"].to_numpy()
        if not len(uid) or not len(entries):
            return as_found([], [], [], np.empty(0, np.int64))
        owner, who, score = search(
            entries["vec_id"].to_numpy(), matrix(entries["ints"], width, np.int64), query_id, matrix(asked["ints"], width, np.int64), asked["bound"].to_numpy(), k
        )
        return as_found(uid[owner], query_id[owner], who, score)

    asked = queries.count()
    queries = queries.repartition(max(1, -(-asked // 512)), "uid")
    ready = arrow_map(queries, begin, "uid long, query_id long, ints array<bigint>, bound double, see int")
    ready = ready.where("see > 0").withColumn("blocks", F.sequence(F.lit(0), F.col("see") - 1)).drop("see")
    return best(search_blocks(blocks.select("block", "vec_id", "ints"), ready, find, "long", asked), k)


def _norm(column: str) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def to_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component, x as double; null for an unusable vector."""
    return F.when(usable(vector), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", to_integers(F.col("embedding")).alias("ints"))
    return top_k(rows, F.col("vec_id") % 50 == 0)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
