"""Vector codes: bounds never change a code, rounds against plain Lloyd, odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import codes


def lloyd(vectors, parts, entries, rounds):
    """vectors: id -> integer list; (codes, errors, codebooks) by comparing everything with everything."""
    ids = sorted(vectors)
    width = max(map(len, vectors.values())) // parts
    part = {i: [vectors[i][p * width : (p + 1) * width] for p in range(parts)] for i in ids}
    books = [[part[i][p] for i in ids[:entries]] for p in range(parts)]

    def nearest(i, p):
        return min((sum((a - b) ** 2 for a, b in zip(part[i][p], c)), e) for e, c in enumerate(books[p]))

    for r in range(rounds + 1):
        found = {i: [nearest(i, p) for p in range(parts)] for i in ids}
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part[i][p] for i in ids if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return {i: [e for _, e in found[i]] for i in ids}, {i: sum(d for d, _ in found[i]) for i in ids}, books


@pytest.mark.parametrize("low, high", [(-3, 4), (-900, 900), (-(1 << 27), 1 << 27)])
def test_bounds_never_change_an_assignment(low, high):
    rng = np.random.default_rng(high)
    x, entries = rng.integers(low, high, (700, 4)), rng.integers(low, high, (60, 4))
    entries[20:25] = entries[3:8]  # ties
    groups = codes.grouped(entries, 8)
    assert sorted(np.concatenate(groups).tolist()) == list(range(60))
    code = lower = None
    scanned = []
    for r in range(6):
        d = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        count = []
        code, best, lower = codes.assign(x, entries, groups, code, lower, count)
        scanned.append(sum(count))
        assert code.tolist() == d.argmin(1).tolist()
        assert best.tolist() == d.min(1).tolist()
        moved = entries.copy()
        for e in np.unique(code):
            moved[e] = x[code == e].sum(0) // (code == e).sum()
        far = np.sqrt(((moved - entries) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        lower = lower - np.array([far[g].max() for g in groups])
        entries = moved
    assert scanned[0] == 700 * 60 and scanned[-1] < 0.9 * scanned[0]


def test_query_equals_plain_lloyd(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = {int(i) * 3 - 50: rng.normal(size=8).round(2).tolist() for i in range(400)}
    labels = {i: None if i % 5 == 0 else i % 3 for i in vectors}
    rows = [(i, v, labels[i], 1) for i, v in vectors.items()]
    rows += [(-60, None, 1, 1), (-61, [1.0] * 7 + [math.nan], 1, 1), (-62, [1.0] * 7 + [math.inf], 1, 1), (-63, [1.0] * 7 + [None], 1, 1), (None, [1.0] * 8, 1, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, codes int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    code, error, books = lloyd(ints, 4, 256, 4)
    total = {k: sum(error[i] for i in vectors if labels[i] == k) for k in set(labels.values())}
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    got = {r["vec_id"]: tuple(r)[1:] for r in codes.query(spark, str(tmp_path)).collect()}
    assert got == {i: ("".join(f"{c:02x}" for c in code[i]), error[i], total[labels[i]], digest) for i in vectors}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, ints array<long>, row string")
    found, books = codes.compress(empty)
    assert found.collect() == [] and books.shape[:2] == (4, 0)
    rows = [(2, [1, 2, 3], "b"), (1, [9], "a"), (1, [5], "c"), (3, [], "d"), (4, [1 << 60, 0, 0], "e")]
    found, books = codes.compress(spark.createDataFrame(rows, "vec_id long, ints array<long>, row string"), parts=2, entries=3, rounds=0)
    got = {r["row"]["row"]: (r["codes"], r["error"]) for r in found.collect()}
    # parts of two components, the last one padded; the entries are 1:[5], 1:[9], 2:[1,2,3]
    assert books.tolist() == [[[5, 0], [9, 0], [1, 2]], [[0, 0], [0, 0], [3, 0]]]
    assert got["a"] == ([1, 0], 0) and got["b"] == ([2, 2], 0) and got["c"] == ([0, 0], 0) and got["d"] == ([2, 0], 5)
    assert got["e"] == ([1, 0], (codes.LIMIT - 9) ** 2)


def test_counted_join_deals_hot_keys(spark):
    from rankforge.llm.common import join_counted, settle

    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    want = {r["id"]: r["total"] for r in left.join(right, left["key"].eqNullSafe(right["key"])).select("id", "total").collect()}
    got = join_counted(left, settle(right), "key", "n", "id", hot=20)
    assert got.columns == ["id", "key", "total"]
    assert {r["id"]: r["total"] for r in got.collect()} == want
