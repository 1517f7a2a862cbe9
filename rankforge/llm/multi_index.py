"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook of `CODES`
centroids, which gives CODES^2 cells.  The codebooks are fitted on a bounded
sample (`SAMPLE` vectors by a hash of vec_id); every vector is indexed.  A query
orders the cells by the sum of its two halves' distances (the negative inner
product with the centroid): a heap walks the pairs in that order until the
visited cells hold a share of all entries, or `LEAST` if that is more.  The
entries of the visited cells are reranked with exact inner products in double
precision.

The share is fitted on the sample too: the least one at which `RECALL` of the true
neighbours of `TRIALS` of its vectors are in visited cells.  It is small for data
with structure; vectors that are close to random in 64 dimensions need 0.3 to 0.4.

Neighbouring cells are put together into blocks of bounded size (a large cell is
spread over several), and a query only goes to blocks with a cell that it visits.
What a query must remember of its walk is one number, the largest visited sum:
the visited cells are those with no larger one.

Defined cases: vectors that are null, zero or hold a null, NaN or infinite
component and rows with a null vec_id take no part; vectors shorter than the
longest end in zeros; rows with the query's own vec_id are its own; repeated
rows are candidates each, repeated query rows count once; ties go to the smaller
vec_id; extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, settle, table
from rankforge.llm.vectors import BLOCK, as_found, best, keep_best, matrix, search_blocks, usable

K = 20
CODES = 128
SAMPLE = 8192
LEAST = 4 * K
RECALL = 0.94
TRIALS = 256


def centroids(points: np.ndarray, codes: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm; fewer centroids if there are fewer distinct points."""
    points = np.unique(points, axis=0)
    centre = points[np.random.default_rng(seed).permutation(len(points))[:codes]].copy()
    for _ in range(rounds):
        owner = nearest(points, centre)
        total = np.zeros_like(centre)
        np.add.at(total, owner, points)
        count = np.bincount(owner, minlength=len(centre))
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1) - 2 * points @ centre.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> float:
    """The sum of distances up to which cells are visited so that they hold `enough` entries.

    first[i] + second[j] is the distance of cell (i, j), counts[i, j] its entries.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    held = counts[by_first][:, by_second].tolist()
    heap, reached, found, last = [(a[0] + b[0], 0, 0)], [0] * len(a), 0, float("-inf")
    while heap and found < enough:
        last, i, j = heappop(heap)
        found += held[i][j]
        reached[i] = j + 1
        # a pair enters once both pairs before it, to the left and above, have left the heap
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return last


def blocks_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours share a block of about `size` entries, a larger cell has several to itself."""
    start, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > size:
            block, held = block + 1, 0
        start[cell], number[cell] = block, max(1, -(-n // size))
        held += n
        if number[cell] > 1:
            block, held = block + number[cell], 0
    return start, number


def share_for(points: np.ndarray, first: np.ndarray, second: np.ndarray, n: int, k: int = K, recall: float = RECALL, trials: int = TRIALS) -> float:
    """The least share of entries, in order of their cells' distances, that holds `recall` of the neighbours of some sampled vectors.

    The k nearest of n entries are about the k * len(points) / n nearest of the sample.
    """
    half, m = first.shape[1], len(points)
    near = min(max(2, round(k * m / max(n, 1))), m - 1)
    if near < 1:
        return 1.0
    asked = np.random.default_rng(5).permutation(m)[:trials]
    own = points[asked]
    distance = -(own[:, :half] @ first.T)[:, nearest(points[:, :half], first)] - (own[:, half:] @ second.T)[:, nearest(points[:, half:], second)]
    score = own @ points.T
    score[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-score, near - 1, axis=1)[:, :near]
    limit = np.take_along_axis(distance, true, 1)
    # a cell is visited as a whole, so an entry needs all that are as near as it is
    rank = np.stack([np.searchsorted(np.sort(d), x, side="right") for d, x in zip(distance, limit, strict=True)])
    return float(np.quantile(rank / m, recall))


def rerank(ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, visits: np.ndarray, k: int):
    """(query position, vec_id, score) of each query's k best among the entries of its cells.

    visits[q, c] tells whether query q visits cell c; cells are numbered from 0.
    """
    order = np.argsort(cells, kind="stable")
    ids, vectors, cells = ids[order], vectors[order], cells[order]
    edge = np.flatnonzero(np.diff(np.concatenate(([-1], cells, [-1]))))
    score = np.full((len(queries), len(ids)), -np.inf)
    for begin, end in zip(edge[:-1], edge[1:], strict=True):
        who = np.flatnonzero(visits[:, cells[begin]])
        if len(who):
            score[who, begin:end] = queries[who] @ vectors[begin:end].T
    score[query_ids[:, None] == ids] = -np.inf
    at = max(0, score.shape[1] - k)
    kth = np.partition(score, at, axis=1)[:, at]
    # sums in another order may differ in the last bits: the final score is one fixed sum per pair
    q, v = np.nonzero((score >= (kth - 1e-9 * np.maximum(1.0, np.abs(kth)))[:, None]) & (score > -np.inf))
    exact = (queries[q] * vectors[v]).sum(1)
    kept = keep_best(q, exact, ids[v], k)
    return q[kept], ids[v][kept], exact[kept]


def neighbours(rows: DataFrame, asks: Column, k: int = K, codes: int = CODES, share: float | None = None, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score; `rows` has vec_id and embedding, `share` stands in for the fitted one."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    width, n = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = max(2, width or 0)
    half = width // 2
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    points = matrix(fitted["vector"], width) if len(fitted) else np.zeros((1, width))
    first, second = centroids(points[:, :half], codes), centroids(points[:, half:], codes)
    share = share_for(points, first, second, n, k) if share is None else share
    codes = len(second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1), width)
            cell = nearest(own[:, :half], first) * codes + nearest(own[:, half:], second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["vec_id", "vector", "cell"])

    index = settle(arrow_map(rows, assign, "vec_id long, vector array<double>, cell int"))
    counts = np.zeros(len(first) * codes, np.int64)
    for cell, entries in index.groupBy("cell").agg(F.count(F.lit(1))).collect():  # a row for each cell at most
        counts[cell] = entries
    start, number = blocks_of(counts, BLOCK)
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, spread = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(start[cell] + spread % number[cell], pa.int32()), *batch.columns[:3]], names=["block", "vec_id", "vector", "cell"])

    spread = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)).alias("spread")
    index = arrow_map(index.select("vec_id", "vector", "cell", spread), deal, "block int, vec_id long, vector array<double>, cell int")
    enough = max(least, int(np.ceil(share * n)))
    queries = settle(rows.where(asks).distinct().select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").alias("query_id"), "vector"))

    def distances(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(own[:, :half] @ first.T), -(own[:, half:] @ second.T)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = counts.reshape(len(first), codes)
        for batch in batches:
            a, b = distances(matrix(batch.column(2), width))
            limit = np.array([walk(x, y, grid, enough) for x, y in zip(a, b, strict=True)])
            see = []
            for x, y, most in zip(a, b, limit, strict=True):
                cells = np.flatnonzero((x[:, None] + y <= most).ravel() & (counts > 0))
                wide = cells[number[cells] > 1]
                see.append(np.unique(np.concatenate([start[cells], *(start[c] + np.arange(number[c]) for c in wide)])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limit, pa.float64()), pa.array(see, pa.list_(pa.int32()))], names=["uid", "query_id", "vector", "most", "blocks"])

    def find(entries: pa.Table, asked: pa.Table) -> pa.Table:
        uid, query_id = asked["uid"].to_numpy(), asked["query_id"].to_numpy()
        if not len(uid) or not len(entries):
            return as_found([], [], [], np.empty(0))
        own, most = matrix(asked["vector"], width), asked["most"].to_numpy()
        cells, number = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        ids, vectors = entries["vec_id"].to_numpy(), matrix(entries["vector"], width)
        got = []
        for at in range(0, len(uid), 512):
            part = slice(at, at + 512)
            a, b = distances(own[part])
            visits = a[:, cells // codes] + b[:, cells % codes] <= most[part][:, None] + 1e-12
            q, who, score = rerank(ids, vectors, number, query_id[part], own[part], visits, k)
            got.append((at + q, who, score))
        q, who, score = (np.concatenate(x) for x in zip(*got, strict=True))
        return as_found(uid[q], query_id[q], who, score)

    asked = queries.count()
    queries = queries.repartition(max(1, -(-asked // 128)), "uid")
    ready = arrow_map(queries, visit, "uid long, query_id long, vector array<double>, most double, blocks array<int>")
    return best(search_blocks(index, ready, find, "double", asked), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
