"""Exact replicates: totals, distribution, metrics over parts against plain Python, redrawn clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import bootstrap, replicates

Y = "ord long, y int, score double, other double"


def _counts(spark, n, ids, seed):
    """(replicates, n) counts."""
    draws = replicates.draw(spark, n, ids, seed)
    out = np.zeros((len(ids), n), np.int64)
    for r in replicates.counts(spark.range(n).withColumnRenamed("id", "position"), draws).collect():
        out[r["replicate"], r["position"]] += r["times"]
    return out


@pytest.mark.parametrize("n", [1, 7, 143, 144, 3000])
def test_totals_are_exact(spark, n):
    made = _counts(spark, n, range(40), 3)
    assert (made.sum(1) == n).all() and made.min() >= 0
    assert np.array_equal(made[5:8], _counts(spark, n, [5, 6, 7], 3))  # a replicate depends on its own number alone
    if n > 1:
        assert not np.array_equal(made, _counts(spark, n, range(40), 4))


def test_counts_are_multinomial(spark):
    """Means, variances and covariances of 600 rows' counts over 2,000 replicates."""
    n, r = 600, 2000
    made = _counts(spark, n, range(r), 9).astype(float)
    assert replicates.level_of(n) == 2
    assert abs(made.mean(0) - 1).max() < 5 / np.sqrt(r)
    assert made.var(0).mean() == pytest.approx(1 - 1 / n, abs=0.01)
    covariance = np.cov(made.T)
    assert covariance[~np.eye(n, dtype=bool)].mean() == pytest.approx(-1 / n, abs=1e-4)
    share = np.bincount(made.ravel().astype(int), minlength=6)[:6] / made.size
    assert share == pytest.approx([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(6)], abs=0.002)


def test_a_replicate_with_too_many_draws_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(replicates, "LEAST", 1)  # a rate so near 1 that many sums exceed n
    made = _counts(spark, 256, range(200), 1)
    assert replicates.level_of(256) == 4 and (made.sum(1) == 256).all()


def test_counts_are_the_steps_that_hashes_reach():
    """In blocks of any number of replicates, as bytes; by hand from the hashes."""
    for n, some in ((1, 3), (600, 50), (replicates.CACHED // 3, 8), (replicates.CACHED + 5, 2)):
        keys, at = replicates._keys(7, np.arange(some), 0), np.arange(n) * 3
        u = replicates.mix64(keys[:, None] ^ at.astype(np.uint64)) >> np.uint64(12)
        made = replicates.poisson(keys, at, 5)
        assert made.dtype == np.uint8 and np.array_equal(made, sum((u >= np.uint64(s)).astype(int) for s in replicates.steps(5)))


def test_rows_are_read_once(spark):
    """What makes the rows runs once, however many methods, parts and passes there are."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 500, 1, 2).selectExpr("id as ord", "cast(id % 3 = 0 as int) as y", "id * 0.5D as score", "1.0D as other").mapInArrow(count, "ord long, y int, score double, other double")
    out = replicates.replicate_metrics(df, {"a": "score", "b": "other"}, [replicates.AUROC], 6, 2, 64)
    assert out.count() == 12 and seen.value == 500


def _plain(rows, counts):
    """auprc, auroc, brier and best F1 of (position, y, score) under counts, by hand."""
    groups = {}
    for i, y, s in rows:
        tp, n = groups.get(s, (0, 0))
        groups[s] = tp + y * counts[i], n + counts[i]
    positives, total = sum(g[0] for g in groups.values()), sum(g[1] for g in groups.values())
    ap = won = brier = f1 = tp = n = 0.0
    for s in sorted(groups, reverse=True):
        p, m = groups[s]
        won += (m - p) * (tp + p / 2)
        tp, n = tp + p, n + m
        ap += p * tp / n if n else 0
        f1 = max(f1, 2 * tp / max(1, n + positives))
        brier += p * (1 - s) ** 2 + (m - p) * s**2
    return {"auprc": ap / positives if positives else None, "auroc": won / (positives * (total - positives)) if 0 < positives < total else None, "brier": brier / total, "best_f1": f1 if positives else None}


@pytest.mark.parametrize("rows_per_part", [1 << 15, 9])
def test_metrics_equal_plain_python_however_rows_are_parted(spark, rows_per_part):
    rng = np.random.default_rng(2)
    n = 160
    y = (rng.random(n) < 0.04).astype(int)
    score = np.where(rng.random(n) < 0.4, 0.5, rng.integers(0, 8, n) / 8)  # a score that lies in many parts
    other = rng.random(n)
    df = spark.createDataFrame([(int(100 + 3 * i), int(y[i]), float(score[i]), float(other[i])) for i in rng.permutation(n)], Y).repartition(3)
    from rankforge.plans.metrics import BEST_F1

    metrics = [replicates.AVERAGE_PRECISION, replicates.AUROC, replicates.BRIER, BEST_F1]
    got = {(r["metric"], r["method"], r["replicate"]): r["value"] for r in replicates.replicate_metrics(df, {"a": "score", "b": "other"}, metrics, 60, 5, rows_per_part).collect()}
    counts, want = _counts(spark, n, range(60), 5), {}
    for r in range(60):
        for m, s in (("a", score), ("b", other)):
            want |= {(k, m, r): v for k, v in _plain(list(zip(range(n), y.tolist(), s.tolist())), counts[r]).items() if v is not None}
    assert got.keys() == want.keys() and len(want) <= 4 * 2 * 60
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_a_million_close_scores_are_parted(spark):
    """All scores within 1 %: no part holds more than its share, and the value is the plain one."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("ord"), (F.col("id") % 7 == 0).cast("int").alias("y"), (0.99 + (F.col("id") * 7919 % n) / (100.0 * n)).alias("score"))
    out = replicates.replicate_metrics(df, {"s": "score"}, [replicates.AUROC, replicates.AVERAGE_PRECISION], 3, 1)
    got = {(r["metric"], r["replicate"]): r["value"] for r in out.collect()}
    assert len(got) == 6 and all(v == pytest.approx(0.5 if k[0] == "auroc" else 1 / 7, abs=0.01) for k, v in got.items())


def test_odd_rows(spark):
    empty = spark.createDataFrame([], Y)
    assert replicates.replicate_metrics(empty, {"s": "score"}, [replicates.AUROC], 5, 1).count() == 0
    odd = spark.createDataFrame([(1, None, None, 1.0), (2, 1, 0.5, 1.0), (3, 0, float("nan"), 1.0)], Y)
    got = replicates.replicate_metrics(odd, {"s": "score"}, [replicates.AVERAGE_PRECISION], 50, 1).collect()
    assert got and all(r["value"] == 1.0 for r in got)  # null and NaN rank last, so the positive is first


def test_one_class_draws_of_clusters_are_drawn_anew(spark):
    clusters = spark.createDataFrame([(c, c == 0, c > 0) for c in range(6)], "cluster long, yes boolean, no boolean")
    rows = bootstrap.cluster_draws(clusters, 200, 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["replicate"], {})[r["cluster"]] = r["times"]
    assert sorted(by) == list(range(200))  # a plain draw misses cluster 0 in a third of the replicates
    assert all(sum(d.values()) == 6 and d.get(0, 0) and set(d) - {0} for d in by.values())
    # the first attempt that has both classes is the one that counts
    attempts = _counts(spark, 6, [a * 200 + r for r in range(3) for a in range(50)], 4).reshape(3, 50, 6)
    for r in range(3):
        first = next(a for a in attempts[r] if a[0] and a[1:].any())
        assert by[r] == {c: int(t) for c, t in enumerate(first) if t}
    with pytest.raises(ValueError, match="one class only"):
        bootstrap.cluster_draws(clusters.where("cluster > 0"), 5, 4)
