"""Cross-fitting never shows a model its rows; wide PCA equals the eigen-solution; trees locate changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import crossfit, heads, merkle
from rankforge.sources import sinks


def _labelled(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 0.5)))).astype(int)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "k long, y int, a double, b double, c double, d double"), x, y


def test_no_row_is_scored_or_calibrated_by_a_model_that_saw_it(spark):
    df, _, _ = _labelled(spark)
    names = ["a", "b", "c", "d"]
    plain = crossfit.cross_fit(df, names, "y", "k", epochs=4)
    again = crossfit.cross_fit(df.repartition(7), names, "y", "k", epochs=4)
    by = lambda made: {r["key"]: r for r in made.rows.collect()}
    first, second = by(plain), by(again)
    assert {k: (round(r["raw"], 9), round(r["calibrated"], 9)) for k, r in first.items()} == {k: (round(r["raw"], 9), round(r["calibrated"], 9)) for k, r in second.items()}
    # other labels in fold 2 move every model but its own, and their calibration alone through the others' scores
    fold = {k: r["fold"] for k, r in first.items()}
    swapped = df.join(spark.createDataFrame([(k, f) for k, f in fold.items()], "k long, f int"), "k").withColumn("y", F.when(F.col("f") == 2, 1 - F.col("y")).otherwise(F.col("y"))).drop("f")
    n1, n2 = df.where("y = 1").count(), swapped.where("y = 1").count()
    if n1 == n2:
        assert np.allclose(crossfit.cross_fit(swapped, names, "y", "k", epochs=4).weights[2], plain.weights[2])
    x = np.random.default_rng(0).normal(size=(50, 3))
    f, y = np.arange(50) % 5, np.arange(50) % 2.0
    w = crossfit._epoch(x, y, f, np.zeros((5, 3)), 0.5, 0.0, np.ones(2))
    v = crossfit._epoch(x, np.where(f == 2, 1 - y, y), f, np.zeros((5, 3)), 0.5, 0.0, np.ones(2))
    assert np.array_equal(w[2], v[2]) and not np.allclose(w[[0, 1, 3, 4]], v[[0, 1, 3, 4]])


def test_calibration_of_cross_fitted_scores(spark):
    df, x, y = _labelled(spark, 3000, 5)
    made = crossfit.cross_fit(df, ["a", "b", "c", "d"], "y", "k")
    rows = sorted(made.rows.collect(), key=lambda r: r["key"])
    p = np.array([r["calibrated"] for r in rows])
    truth = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 0.5)))
    assert np.corrcoef(p, truth)[0, 1] > 0.98 and abs(p.mean() - y.mean()) < 0.01
    assert np.mean((p - y) ** 2) < np.mean((truth - y) ** 2) + 0.01
    for k in range(5):  # each fold's calibration is the logistic fit of the other folds' rows
        own = np.array([r["fold"] != k for r in rows])
        s, t = np.array([r["raw"] for r in rows])[own], y[own]
        slope, shift = made.calibration[k]
        q = 1 / (1 + np.exp(-(slope * s + shift)))
        assert abs((t - q).sum()) < 0.1 and abs(((t - q) * s).sum()) < 0.1
    with pytest.raises(ValueError):
        crossfit.cross_fit(df.where("y = 1"), ["a"], "y", "k")


def test_wide_pca_equals_the_eigen_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)) @ rng.normal(size=(64, 64))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(500)], "k long, v array<double>").repartition(6)
    wide, names = heads.unpack(df, "v", 64)
    exact, made = heads.fit_pca(wide, names, 5), heads.fit_wide_pca(df, "v", 5)
    assert np.allclose(exact.explained, made.explained, atol=1e-6) and np.allclose(exact.components, made.components, atol=1e-6)


def test_wide_pca_of_8192_columns(spark):
    """A falling spectrum in 8,192 columns; constants, few rows, and a tree of factors."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 8192))
    x = (rng.normal(size=(300, 12)) * 0.7 ** np.arange(12)) @ base
    x[:, 17] = 4.0
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "k long, v array<double>").repartition(40)
    made = heads.fit_wide_pca(df, "v", 4, spare=16)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    value = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(made.explained, value[:4] / value.sum(), atol=1e-6)
    axes = np.array([r["axes"] for r in made.project(df, "k", "v", "axes").orderBy("k").collect()])
    assert np.allclose(axes.var(0) / 8191, made.explained, atol=1e-6)


def test_trees_locate_changes(spark, tmp_path):
    rows = [(i, "n" if i % 3 else None, float(i)) for i in range(200)] + [(7, "n", 7.0)] * 500
    df = spark.createDataFrame(rows, "k long, name string, v double")
    path = str(tmp_path / "s")
    manifest = sinks.seal(df, path, "rows", ranges="k div 10")
    assert sinks.verify_seal(spark, path) == [] and sinks.altered_ranges(spark, path).isEmpty()
    top = merkle.root(merkle.ranges(df.repartition(9), df.columns, "k div 10")).first()
    assert (top["n_rows"], top["root"]) == (manifest["n_rows"], manifest["root"]) == (700, manifest["root"])

    def after(changed):
        changed.write.mode("overwrite").parquet(f"{path}/data")
        return sinks.verify_seal(spark, path), sorted(map(tuple, sinks.altered_ranges(spark, path).collect()))

    assert after(df.withColumn("v", F.when(F.col("k") == 55, 5.5).otherwise(F.col("v")))) == (["root"], [(5, 10, 10)])
    assert after(df.where("k <> 120").unionByName(spark.createDataFrame([(900, "x", 0.0)], df.schema))) == (["root"], [(12, 10, 9), (90, 0, 1)])
    assert after(df.where("k < 7 OR k > 7").unionByName(df.where("k = 7").limit(500))) == (["n_rows", "root"], [(0, 510, 509)])
    # two values that change places keep every sum, but not the tree
    assert after(df.withColumn("v", F.when(F.col("k") == 1, 2.0).when(F.col("k") == 2, 1.0).otherwise(F.col("v"))))[1] == [(0, 510, 510)]
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(0, 1, "x")], "range long, n_rows long, root string").write.mode("overwrite").parquet(f"{path}/tree")
    assert sinks.verify_seal(spark, path) == ["tree"]


def test_fields_do_not_run_into_each_other(spark):
    pairs = [("a", "b:1"), ("a1:b", "1"), ("", "x"), (None, "x"), ("x", ""), ("x", None), ("1:a-", None)]
    digests = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(merkle.row_digest(["a", "b"])).collect()]
    assert len(set(digests)) == len(pairs)
    empty = merkle.root(merkle.ranges(spark.createDataFrame([], "a string"), ["a"])).first()
    assert empty["n_rows"] == 0 and len(empty["root"]) == 64
