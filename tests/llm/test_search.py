"""The two vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import multi_index, topk
from rankforge.llm.vectors import keep_best

ROW = "vec_id long, embedding array<float>, rank int"


def _table(n=400, width=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) * rng.lognormal(0, 0.7, (n, 1))
    x[5], x[6] = x[4], x[4]  # ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    return rows + [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * width, 0), (1003, [float("inf")] * width, 0), (None, [9.0] * width, 0), (1004, [], 0), (1005, [0.0] * width, 0)]


def _best(rows, query, k, measure, ok):
    scored = sorted((-measure(query[1], r[1]), r[0]) for r in rows if ok(r) and r[0] != query[0])
    return [(i, -s) for s, i in scored[:k]]


def _usable(row):
    return row[0] is not None and row[1] is not None and all(v is not None and np.isfinite(v) for v in row[1])


def _dot(a, b, cast=lambda v: v):
    return sum(cast(p) * cast(q) for p, q in zip(a, b, strict=False))


@pytest.mark.parametrize("coordinate", [0.0, topk.COORDINATE, 2.0])
def test_local_search_is_exact_for_every_pruning(coordinate, monkeypatch):
    monkeypatch.setattr(topk, "COORDINATE", coordinate)
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 100, (700, 8)) * rng.lognormal(0, 1, (700, 1))).astype(np.int64)
    vectors[3] = 0
    ids, ask = np.arange(700), np.arange(0, 700, 9)
    for floor in (np.full(len(ask), -np.inf), np.sort(vectors[ask] @ vectors.T, axis=1)[:, -7].astype(float)):
        owner, who, score = topk.search(ids, vectors, ids[ask], vectors[ask], floor, 5, bucket=64)
        for q, i in enumerate(ask):
            s = vectors @ vectors[i]
            others = np.delete(ids, i)
            want = sorted(others, key=lambda j: (-s[j], j))[:5]
            assert who[owner == q].tolist() == want and score[owner == q].tolist() == [s[j] for j in want]


def test_topk_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "SEEDS", 50)
    rows = _table()
    frame = spark.createDataFrame(rows + [rows[50]], ROW).select("vec_id", topk.to_integers(F.col("embedding")).alias("ints"))
    out = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    cast = lambda v: int(np.floor(256 * np.float64(v)))
    for query in (r for r in rows if _usable(r) and r[0] % 50 == 0):
        every = rows + [rows[50]]
        want = _best(every, query, 5, lambda a, b: _dot(a, b, cast), _usable)
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == query[0])
        assert got == [(k + 1, i, s) for k, (i, s) in enumerate(want)]
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(frame.where("vec_id = 0"), F.lit(True)).count() == 0


def test_each_query_is_pruned_by_its_own_bound(monkeypatch):
    """One query without a bound doesn't make the others verify everything."""
    monkeypatch.setattr(topk, "COORDINATE", 2.0)
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(0, 1, (4000, 16)) * np.exp(rng.uniform(0, 5, (4000, 1))) * 10).astype(np.int64)
    ids, ask = np.arange(4000), np.arange(0, 4000, 20)
    floor = np.sort(vectors[ask] @ vectors.T, axis=1)[:, -6].astype(float)
    counts = []
    for bound in (floor, np.where(ask == 0, -np.inf, floor)):
        verified = []
        topk.search(ids, vectors, ids[ask], vectors[ask], bound, 5, bucket=4000, verified=verified)
        counts.append(sum(verified) / (len(ask) * len(ids)))
    assert counts[0] < 0.3 and counts[1] < counts[0] + topk.TOGETHER / len(ask)


def test_large_products_stay_exact():
    a = np.array([[1 << 31, 1]], dtype=np.int64)
    assert topk.products(a, np.array([[1 << 30, 3]], dtype=np.int64))[0, 0] == (1 << 61) + 3


def test_walk_visits_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.normal(size=7), rng.normal(size=5)
        counts = rng.integers(0, 4, (7, 5))
        enough = int(rng.integers(1, counts.sum() + 1))
        order = np.argsort((a[:, None] + b).ravel())
        held = np.cumsum(counts.ravel()[order])
        want = (a[:, None] + b).ravel()[order][np.searchsorted(held, enough)]
        assert multi_index.walk(a, b, counts, enough) == pytest.approx(want)


def test_multi_index_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 60)
    rows = _table()
    frame = spark.createDataFrame(rows, ROW)
    ok = lambda r: _usable(r) and any(r[1])
    ask = F.col("vec_id") % 20 == 0
    full = multi_index.neighbours(frame, ask, codes=8, least=10_000).collect()
    for query in (r for r in rows if ok(r) and r[0] % 20 == 0):
        want = _best(rows, query, 20, lambda a, b: _dot(a, b, np.float64), ok)
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in full if r["query_id"] == query[0])
        assert [(k, i) for k, i, _ in got] == [(k + 1, i) for k, (i, _) in enumerate(want)]
        assert [s for *_, s in got] == pytest.approx([s for _, s in want])
    truth = {(r["query_id"], r["vec_id"]) for r in full}
    part = multi_index.neighbours(frame, ask, codes=16, share=0.5, least=10).collect()
    assert len(truth & {(r["query_id"], r["vec_id"]) for r in part}) >= 0.9 * len(truth)
    assert multi_index.neighbours(frame.limit(0), ask).count() == 0
    assert multi_index.neighbours(frame.where("vec_id = 0"), ask).count() == 0


def test_blocks_hold_every_cell_once():
    counts = np.array([3, 0, 50, 2, 9, 9, 1, 0, 120])
    start, number = multi_index.blocks_of(counts, 10)
    load = {}
    for cell, n in enumerate(counts):
        for block in range(start[cell], start[cell] + number[cell]):
            load[block] = load.get(block, 0) + n / number[cell]
    assert max(load.values()) <= 10


def test_keep_best_breaks_ties_by_id():
    kept = keep_best(np.array([1, 0, 0, 0]), np.array([5, 7, 7, 9]), np.array([4, 8, 3, 6]), 2)
    assert kept.tolist() == [3, 2, 0]


def _exact(x, asked, k):
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    return [{(int(q), int(j)) for j in np.lexsort((np.arange(len(x)), -s))[:k]} for q, s in zip(asked, score, strict=True)]


def _found(spark, x, folder):
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    frame.write.parquet(f"{folder}/embeddings.parquet")
    return {(r["query_id"], r["vec_id"]) for r in multi_index.query(spark, str(folder)).collect()}


def test_contract_query_recall(spark, tmp_path):
    """At the registered parameters on 12,000 nearly random vectors, like the tables', and on 12,000 in clusters."""
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(12_000, 64))
    tight = rng.normal(size=(300, 64))[rng.integers(0, 300, 12_000)] + 0.25 * rng.normal(size=(12_000, 64))
    for name, x, most in (("loose", loose, 0.5), ("tight", tight, 0.1)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        sample = x[:8192]
        first, second = multi_index.centroids(sample[:, :32], multi_index.CODES), multi_index.centroids(sample[:, 32:], multi_index.CODES)
        share = multi_index.share_for(sample, first, second, len(x))
        assert share < most, (name, share)
        found = _found(spark, x, tmp_path / name)
        truth = set.union(*_exact(x, np.arange(0, 12_000, 20), 20))
        assert len(found) == len(truth) and len(truth & found) >= 0.9 * len(truth), name


def test_contract_query_recall_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {(r["query_id"], r["vec_id"]) for r in multi_index.query(spark, sf).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    ids = np.array([r[0] for r in rows])
    truth = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        truth |= {(int(ids[q]), int(ids[j])) for j in np.lexsort((ids, -s))[:20]}
    assert len(truth & found) >= 0.9 * len(truth)
