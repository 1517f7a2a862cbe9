"""Hand-computed values, invariance, and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions import scalar
from rankforge.operators import bootstrap, contracts, encoding, heads, matching, matrix, pooling, ranking, sampling

Y = "ord long, y int, score double"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.8), (2, 1, 0.7), (3, 0, 0.1)], Y)


def test_metric_literals(spark, four):
    at2 = ranking.precision_recall_at(four, [], 2).first()
    assert (at2["precision"], at2["recall"]) == (0.5, 0.5)
    assert ranking.reciprocal_rank(four, []).first()["rr"] == 1.0
    assert ranking.average_precision(four, []).first()["auprc"] == pytest.approx(5 / 6)
    assert ranking.precision_recall_at(four, [], 99).first()["precision"] == 0.5
    assert ranking.auroc(four, []).first()["auroc"] == pytest.approx(0.75)
    perfect = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)], "y int, p double")
    assert ranking.calibration_error(perfect, [], bins=2).first()["ece"] == 0.0


def test_tied_scores_are_one_threshold(spark):
    tied = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0)], Y)
    assert ranking.average_precision(tied, []).first()["auprc"] == pytest.approx(2 / 3)


def test_no_positive_abstains(spark):
    none = spark.createDataFrame([(0, 0, 1.0)], Y)
    assert ranking.average_precision(none, []).isEmpty()
    assert ranking.reciprocal_rank(none, []).isEmpty()


def test_row_order_does_not_matter(spark):
    rows = [(i, int(i % 3 == 0), float(i % 4)) for i in range(60)]
    a = spark.createDataFrame(rows, Y)
    b = spark.createDataFrame(rows[::-1], Y).repartition(7)
    for metric in (lambda d: ranking.metric_bundle(d, [], 7), lambda d: ranking.auroc(d, []), lambda d: bootstrap.auprc_interval(d, ["score"], 10, 3)):
        assert metric(a).collect() == metric(b).collect()
    for chosen in (lambda d: sampling.capped_subset(d, "ord", "y", 30, 1), lambda d: sampling.cover_then_fill(d, "ord", ["score"], 9, 2), lambda d: sampling.balanced_subset(d, "ord", ["score"], 13, 2)):
        assert sorted(chosen(a).collect()) == sorted(chosen(b).collect())


def test_position_across_partitions(spark):
    rows = [(i, int(i % 2), float((i * 7) % 10)) for i in range(101)]
    out = ranking.position(spark.createDataFrame(rows, Y), ["y"], ["score", "ord"], rows_per_part=9).collect()
    for y in (0, 1):
        want = [r[0] for r in sorted((r for r in rows if r[1] == y), key=lambda r: (r[2], r[0]))]
        assert [r["ord"] for r in sorted((r for r in out if r["y"] == y), key=lambda r: r["position"])] == want
        assert sorted(r["position"] for r in out if r["y"] == y) == list(range(len(want)))


def test_spearman_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 3.0, 9.0), ("c", float("nan"), 0.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["spearman"]) for r in ranking.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] == (2, None) and got["b"] == (3, None) and got["c"] == (3, pytest.approx(1.0))


def test_intervals_and_states(spark):
    strong = spark.createDataFrame([(i, int(i < 3), float(6 - i), float(i)) for i in range(6)], "ord long, y int, score double, weak double")
    diff = bootstrap.paired_difference(strong, "score", "weak", 100, 3)
    spread = bootstrap.interval(diff, [], "difference").first()
    assert spread["valid"] >= 95 and spread["upper"] > 0
    states = spark.createDataFrame([(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1), (None, 0.1)], "a double, b double").select(ranking.interval_state(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in states] == ["DETECTABLE_GAIN", "DETECTABLE_LOSS", "NO_DETECTABLE_DIFFERENCE", "NOT_COMPUTED"]


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(500).withColumnRenamed("id", "ord")
    assert bootstrap.poisson_weights(df, 20, 1).agg(F.sum("times")).first()[0] / 10_000 == pytest.approx(1.0, abs=0.05)


def test_hash_folds_equal_python(spark):
    import hashlib

    keys = ["TP53", "BRAF", "x"]
    out = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scalar.prefix_fold(F.col("k"), 5), scalar.salted_fold(F.col("k"), "s", 7)).collect()
    for k, a, b in out:
        assert a == int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % 5
        assert b == int(hashlib.sha256(f"s|{k}".encode()).hexdigest(), 16) % 7


def test_stratum_sample(spark):
    rows = [(f"c{i}", "s1" if i < 6 else "s2") for i in range(12)] + [("lonely", None)]
    out = sampling.stratum_sample(spark.createDataFrame(rows, "cell string, sample string"), "cell", ["sample"], 2, 3, 1).collect()
    assert sorted(r["sample"] for r in out) == ["s1"] * 3 + ["s2"] * 3
    with pytest.raises(ValueError):
        sampling.stratum_sample(spark.range(1), "id", ["id"], 3, 2, 1)


def test_identifiers(spark):
    raw = ["P013.post.03", "p7", " P02.PRE.1 ", "odd"]
    out = spark.createDataFrame([(r,) for r in raw], "x string").select(scalar.sample_id(F.col("x")), scalar.patient_id(F.col("x"))).collect()
    assert [tuple(r) for r in out] == [("P13.post.3", "P013.post.03"), ("P7.pre", "P7"), ("P2.pre.1", "P02.PRE.1"), ("odd", "odd")]


def test_views_reproduce_substring_rules(spark):
    df = spark.createDataFrame([("Melanoma ", "unknown", "untreated", "progress"), (None, "cd8_t", "t1", "no_response")], "disease string, cell_compartment string, treatment_state string, response_state string")
    a, b = df.select(*[c.alias(n) for n, c in scalar.views().items()]).collect()
    assert a["melanoma"] and a["immune"] and a["pretreatment"] and a["on_or_post_treatment"] and a["responder"] and a["nonresponder"]
    assert not b["melanoma"] and not b["immune"] and b["on_or_post_treatment"] and b["responder"] and not b["nonresponder"]


def test_matrix_means_count_zeros(spark):
    cells = spark.createDataFrame([("g", "c1", "A", 4.0)], "gene string, cell string, grp string, value double")
    sizes = spark.createDataFrame([("A", 2), ("B", 3)], "grp string, n_cells long")
    assert matrix.group_means(cells, sizes, ["grp"]).first()["mean"] == 2.0
    assert matrix.cell_summary(cells, F.lit(4)).first()["fraction_positive"] == 0.25


def test_centrality_literals(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    got = {r["node"]: r["centrality"] for r in matrix.degree_centrality(edges, spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "node string")).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 1.5, "z": 0.0}
    assert matrix.degree_centrality(spark.createDataFrame([("a", "a")], "src string, dst string")).first()["centrality"] == 1.0


_WANT, _HAVE = "wanted_id long, ord long, normal_id string, patient string", "sample string, patient string"


def test_entity_resolution(spark):
    wanted = spark.createDataFrame([(1, 1, "P13.post.3", "P13"), (2, 2, "P1.post.1", "P1"), (3, 3, "P2.post.1", "P2"), (4, 4, "P2.post.2", "P2")], _WANT)
    available = spark.createDataFrame([("P13.post.2", "P13"), ("P1.post.1", "P1"), ("P2.post.8", "P2"), ("P2.post.9", "P2")], _HAVE)
    got = {r["wanted_id"]: (r["sample"], r["status"][:5]) for r in matching.resolve_entities(wanted, available).collect()}
    assert got == {1: ("P13.post.2", "FALLB"), 2: ("P1.post.1", "EXACT"), 3: (None, "UNRES"), 4: (None, "UNRES")}


def test_entity_resolution_equals_the_consuming_loop(spark):
    """300 small cohorts whose rows compete, also for other patients' samples; each is a block of patients of its own."""
    rng = np.random.default_rng(8)
    wanted, available, want = [], [], {}
    for block in range(300):
        samples = [(f"{block}.{p}.{k}", f"{block}.{p}") for p in range(3) for k in range(rng.integers(0, 4))]
        names = [s for s, _ in samples] + [f"{block}.lost"]
        used = set()
        for i in range(rng.integers(1, 9)):
            row = (block * 10 + i, int(block * 10 + i), str(rng.choice(names)), f"{block}.{rng.integers(0, 3)}")
            wanted.append(row)
            free = [s for s, p in samples if p == row[3] and s not in used]
            if row[2] in names[:-1] and row[2] not in used:
                want[row[0]] = (row[2], "EXACT")
            else:
                want[row[0]] = (free[0], "FALLB") if len(free) == 1 else (None, "UNRES")
            used.add(want[row[0]][0])
        available += samples
    got = matching.resolve_entities(spark.createDataFrame(wanted[::-1], _WANT), spark.createDataFrame(available, _HAVE)).collect()
    assert {r["wanted_id"]: (r["sample"], r["status"][:5]) for r in got} == want and len(got) == len(want)
    assert len({v for v in want.values() if v[1] == "FALLB"}) > 100


def test_case_folding_equals_python(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isprintable()]
    texts = ["".join(every[i : i + 7]) for i in range(0, len(every), 7)] + ["ΟΔΟΣ ΟΔΟΣ", "STRASSE Straße ẞ", "ﬁn İ ı"]
    texts = [t for t in texts if any(c.casefold() != c for c in t)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", scalar.casefold(F.col("x")).alias("y")).collect()
    assert [r["x"] for r in rows if r["y"] != r["x"].casefold()] == []


def test_overlap_by_group(spark):
    reference = spark.createDataFrame([("Straße",), (" two\t",), ("two",), ("three",), (None,)], "text string")
    rows = [("a", "STRASSE"), ("a", "strasse "), ("a", "TWO"), ("b", "four"), (None, "Three"), ("c", None), ("c", "")]
    df = spark.createDataFrame(rows + [("d", f"x{i}") for i in range(3000)], "g string, text string").repartition(5)
    assert {r["g"]: r["shared"] for r in matching.overlap_by_group(df, reference, "g").collect()} == {"a": 2, "b": 0, None: 1, "c": 0, "d": 0}
    both = matching.normal_overlap(df.withColumnRenamed("text", "id"), reference.withColumnRenamed("text", "id")).first()
    assert tuple(both) == (4 + 3000, 3, 3)  # blank ones don't count
    plan = matching.overlap_by_group(df, reference, "g")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" not in plan
    assert matching.overlap_by_group(df.limit(0), reference, "g").count() == 0


def test_bloom_filter(spark, monkeypatch):
    keys = lambda lo, hi: spark.range(lo, hi).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("k"))
    held = matching.bloom_filter(keys(0, 5000).repartition(3))
    numbers = lambda df: matching._halves(df.toArrow()["k"])
    assert held.may_hold(numbers(keys(0, 5000))).all() and held.may_hold(numbers(keys(5000, 25_000))).mean() < 0.02
    monkeypatch.setattr(matching, "BLOOM_BITS", 1 << 12)
    assert matching.bloom_filter(keys(0, 5000)) is None
    reference = spark.range(2000).select(F.col("id").cast("string").alias("text"))  # too many for a filter: the join alone
    df = spark.range(1990, 2010).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("text"))
    assert matching.overlap_by_group(df, reference, "g").first()["shared"] == 10


def test_join_contracts(spark):
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string")
    with pytest.raises(ValueError):
        matching.one_to_one(one, two, ["k"])
    with pytest.raises(ValueError):
        matching.covered(spark.range(3).withColumnRenamed("id", "k"), one, ["k"])
    assert matching.covered(one, one.withColumnRenamed("v", "w"), ["k"]).first()["w"] == "a"
    assert matching.one_to_one(one, one, ["k"]).columns == ["k", "v_x", "v_y"]


def test_balanced_pool_literal(spark):
    rows = [("g", "s1", "c1", [1.0, 1.0]), ("g", "s1", "c2", [3.0, 3.0]), ("g", "s2", "c3", [2.0, 2.0])]
    out = pooling.balanced_pool(spark.createDataFrame(rows, "gene string, sample string, cell string, embedding array<double>"), "gene", "sample", [], "cell").first()
    assert (out["vector"], out["n_cells"], out["n_samples"]) == ([2.0, 2.0], 3, 2)


def test_tokenisers_order(spark):
    counts = spark.createDataFrame([(0, "a", 0, 4.0), (0, "b", 1, 2.0), (0, "c", 2, 0.0), (0, "d", 3, 4.0), (1, "a", 0, 0.0)], "cell long, gene string, ord long, value double")
    dictionary = spark.createDataFrame([("a", 10, 4.0), ("b", 11, 1.0), ("d", 13, 4.0)], "gene string, token long, median double")
    got = pooling.rank_tokens(counts, dictionary, 2).collect()
    assert [(r["cell"], r["tokens"], r["genes"]) for r in got] == [(0, [11, 10], [1, 0])]
    binned = {r["cell"]: (r["tokens"], r["values"]) for r in pooling.binned_tokens(counts, dictionary.select("gene", "token"), 3, 5, 7).collect()}
    assert binned[1] == ([7], [0.0]) and binned[0][0] == [7, 10, 13]


def test_ridge_and_logistic_closed_forms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = x @ [1.0, -0.4, 2.0] + rng.normal(size=120)
    label = (y > np.quantile(y, 0.7)).astype(int)
    df = spark.createDataFrame([(*map(float, r), float(t), int(b)) for r, t, b in zip(x, y, label, strict=True)], "f0 double, f1 double, f2 double, t double, b int")
    names = ["f0", "f1", "f2"]
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2.5 * np.eye(3), z.T @ (y - y.mean()))
    model = heads.fit_ridge(df, names, "t", 2.5)
    assert np.allclose(model.coefficients, want, atol=1e-6) and model.intercept == pytest.approx(y.mean(), abs=1e-6)
    fitted = heads.fit_logistic(df, names, "b", 0.5)
    beta, design = np.append(fitted.coefficients, fitted.intercept), np.column_stack([z, np.ones(120)])
    w = np.where(label == 1, 120 / (2 * label.sum()), 120 / (2 * (120 - label.sum())))
    gradient = 0.5 * design.T @ (w * (label - 1 / (1 + np.exp(-design @ beta)))) - beta
    assert np.abs(gradient).max() < 1e-6
    pca = heads.fit_pca(df, names, 2)
    value = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(pca.explained, value[:2] / value.sum())
    with pytest.raises(ValueError):
        heads.fit_logistic(df.where("b = 1"), names, "b", 1.0)


def test_ridge_by_folds_equals_single_fits(spark):
    from pyspark.sql import functions as F

    from rankforge.functions.scalar import prefix_fold

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 2)) * [1, 40] + [5, -300]
    rows = [(i, *map(float, r), 7.0, float(r[0] + 0.02 * r[1] + rng.normal())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ord long, `f 0` double, f1 double, constant double, t double")
    names = ["f 0", "f1", "constant"]
    alpha, out = heads.ridge_by_folds(df.withColumn("key", F.col("ord").cast("string")), names, "t", "key", (1.0, 10.0), 3)
    got = {r["ord"]: r["prediction"] for r in out.collect()}
    fold = prefix_fold(F.col("ord").cast("string"), 3)
    for k in range(3):
        model = heads.fit_ridge(df.where(fold != k), names, "t", alpha)
        for r in df.where(fold == k).select("ord", model.predict(names).alias("p")).collect():
            assert got[r["ord"]] == pytest.approx(r["p"], abs=1e-6)


def test_random_mlp_shapes(spark):
    net = heads.random_mlp(3, "large", 1)
    assert net.parameters == 4 * 64 + 65 * 32
    df = spark.createDataFrame([(0.1, 0.2, 0.3)], "a double, b double, c double")
    row = df.select(*[c.alias(f"h{i}") for i, c in enumerate(net.columns([F.col(c) for c in "abc"]))]).first()
    first = np.tanh(np.array([0.1, 0.2, 0.3, 1.0]) @ net.first)
    assert np.allclose(row, np.tanh(np.append(first, 1.0) @ net.second))


def test_gate_literal(spark):
    rows = [(f"G{i}", f"I{i % 6}", i % 10, int(i < 20)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, i string, f int, l int")
    limits = {"positive_pairs": 20, "indications_with_positive": 6, "holdout_positive_pairs": 2}
    assert contracts.power_gate(df, "g", "i", "f", "l", 9, limits).first()["gate"] == "PASS"
    few = contracts.power_gate(df.where("l = 0 OR f < 2"), "g", "i", "f", "l", 9, limits).first()
    assert few["gate"] == "WAIT" and "positive_pairs" in few["failures"]
    with pytest.raises(ValueError):
        contracts.power_gate(df.withColumn("my_Score", F.lit(1)), "g", "i", "f", "l", 9, limits)


@pytest.mark.parametrize("name", ["a19_view_means", "u05_column_blocks", "m22_static_embedding_lookup", "a20_balanced_pooling"])
def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path, name):
    """Against SQL as text, which tells -0.0 from 0.0."""
    import duckdb

    from rankforge.plans import registry

    rows = [(i, [float(x) for x in ((-1e-7, 1e-7, -0.0, 0.0) if i % 2 else (-2e-7, 3e-7, -0.25, 0.5))], i % 10) for i in range(46)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    # control 33 of part 74,993 is -3.5e-07 where vectors are that wide
    spark.createDataFrame([(3,), (74_993,)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for table in ("embeddings", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    registry.queries()[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "got"))
    cursor = con.execute(registry.oracle_sql()[name])
    columns = ", ".join(f"{d[0]}::VARCHAR" for d in cursor.description)
    want = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert con.execute(f"SELECT {columns} FROM '{tmp_path}/got/*.parquet' ORDER BY ALL").fetchall() == want
    assert any("-0.0" in v for row in want for v in row if v)


def test_contrast_weights_hold_no_lesion(spark):
    """3,000 lesions of 3 patients: what goes to the tasks has a row for each patient and response, and deltas are those of all lesions."""
    from rankforge.plans import transfer

    cohort = spark.range(3000).selectExpr("id AS lesion", "concat('p', id % 3) AS patient", "id % 2 = 0 AS responder")
    values = spark.range(0, 3000, 5).selectExpr("'g' AS ord", "id AS lesion", "1.0D + id % 7 AS value")
    names, weights = transfer.contrast_weights(cohort, 5, 5)
    assert weights.table.shape == (6, len(names))
    got = {r["contrast"]: r["delta"] for r in transfer.contrasts(values, weights, spark.createDataFrame([("g",), ("none",)], "ord string"), names).where("ord = 'g'").collect()}
    for j, keep in ((0, range(3000)), (names.index("without p1"), [k for k in range(3000) if k % 3 != 1])):
        mean = lambda side: sum(1 + k % 7 for k in keep if k % 5 == 0 and k % 2 == side) / sum(k % 2 == side for k in keep)  # noqa: B023, E731
        assert np.isclose(got[j], mean(0) - mean(1))


def test_encoder_interface(spark):
    with pytest.raises(encoding.UnavailableModel):
        encoding.unavailable("a model")
    df = spark.createDataFrame([(1, [1, 2]), (2, [3])], "cell long, tokens array<long>")
    out = encoding.encode(df, encoding.stand_in(3), batch=1).collect()
    assert sorted(r["cell"] for r in out) == [1, 2] and all(len(r["embedding"]) == 3 for r in out)


def test_encoding_is_dealt_over_tasks(spark):
    """Short sequences that a shuffle would leave in one task; no call has more than a batch."""
    made = spark.range(400).groupBy(F.col("id").alias("cell")).agg(F.collect_list("id").alias("tokens"))  # few bytes behind a shuffle
    out = encoding.encode(made, lambda part: [[float(len(part)), float(t[0])] for t in part], batch=7).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in out}) == 4
    assert sorted(r["embedding"][1] for r in out) == [float(i) for i in range(400)] and max(r["embedding"][0] for r in out) <= 7


def test_rank_tokens_reads_counts_once(spark):
    """A gene of two tokens counts once in its cell's total, and the counts are scanned once."""
    counts = spark.createDataFrame([(1, 5, 5, 2.0), (1, 6, 6, 1.0), (1, 7, 7, 1.0), (2, 7, 7, 3.0)], "cell long, gene long, ord long, value double")
    known = spark.createDataFrame([(5, 50, 1.0), (5, 51, 8.0), (6, 60, 1.0)], "gene long, token long, median double")
    out = pooling.rank_tokens(counts.where("gene > 0"), known, 10)
    assert [tuple(r) for r in out.collect()] == [(1, [50, 60, 51], [5, 6, 5])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # counts and dictionary


def test_geometry_correlation_of_all_pairs(spark):
    """Many entities, wide vectors and odd rows against the cosines of all pairs."""
    rng = np.random.default_rng(3)
    n, d = 5200, 12
    u = rng.normal(size=(n, d)) + 0.5
    v = u[:, :5] + rng.normal(size=(n, 5))
    v[7] = 0
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(u, v, strict=True))], "k long, f array<double>, s array<double>").repartition(4)
    ok = np.arange(n) != 7
    x, y = ((w[ok] / np.linalg.norm(w[ok], axis=1, keepdims=True)) for w in (u, v))
    above = np.triu_indices(n - 1, 1)
    want = np.corrcoef((x @ x.T)[above], (y @ y.T)[above])[0, 1]
    got = pooling.geometry_correlation(df, "k", "f", "s").first()
    assert got["pairs"] == n * (n - 1) // 2 and got["correlation"] == pytest.approx(want, abs=1e-9)
    same = df.withColumn("s", F.array(F.lit(1.0), F.lit(2.0)))
    assert pooling.geometry_correlation(same, "k", "f", "s").first()["correlation"] is None
    assert tuple(pooling.geometry_correlation(df.limit(0), "k", "f", "s").first()) == (0, None)


def test_heads_read_whole_vectors(spark):
    from rankforge.plans import vectors

    rows, names = vectors._features(spark, "/root/testdata/sf0.001")
    assert names == [f"f{i}" for i in range(64)]
    assert rows.where(F.col("f63") != F.col("embedding")[63].cast("double")).isEmpty()


def test_moments_of_many_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 512))
    df = spark.createDataFrame([(i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>")
    df, names = heads.unpack(df, "v", 512)
    assert np.allclose(heads.moments(df, [F.col(n) for n in names]), x.T @ x)
    half = heads.moments(df.withColumn("f0", F.when(F.col("k") < 2, F.col("f0"))), [F.col(n) for n in names[:20]])
    rest = x[np.arange(300) % 3 < 2, :20]
    assert np.allclose(half, rest.T @ rest)  # rows with a null take no part


def test_models_on_parts_of_the_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 3] + rng.normal(size=400) > 0.4).astype(int)
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in names) + ", y int")
    one, all_ = heads.fit_models(df, names, "y", [((0, 3), 0.5), (range(5), 2.0)])
    alone = heads.fit_logistic(df, ["f0", "f3"], "y", 0.5)
    assert np.allclose(one.coefficients, alone.coefficients) and np.isclose(one.intercept, alone.intercept)
    # the penalised gradient vanishes
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(400)])
    beta = np.append(all_.coefficients, all_.intercept)
    w = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    assert np.allclose(2.0 * z.T @ ((y - 1 / (1 + np.exp(-z @ beta))) * w), beta, atol=1e-6)


def test_spreads_are_the_scaler_of_all_rows(spark):
    """Mean and deviation of far, constant and partly null columns, the rows and the sums, in one pass."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 2))
    rows = [(None if k % 5 == 0 else 1e6 + float(a), 0.1, float(b), k % 2, None) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "far double, same double, plain double, y int, none double").repartition(5)
    names = ["far", "same", "plain", "y"]
    made, n, sums = heads.spreads(df, names)
    want = heads.fit_scaler(df, names)
    assert np.allclose(made.mean, want.mean, rtol=1e-14) and np.allclose(made.scale, want.scale, rtol=1e-9) and made.scale[1] == 1.0
    assert n == 700 and sums[3] == 350 and heads.spreads(df, ["none"])[0].mean.tolist() == heads.fit_scaler(df, ["none"]).mean.tolist()
    assert heads.spreads(df.where("false"), names)[1] == 0


def test_frozen_rows_lie_in_a_part_for_each_core(spark):
    from rankforge.plans import benchmark
    from rankforge.sources import readers

    frozen = benchmark.freeze(readers.simulate_until(spark, 300).coalesce(1), 3)
    assert frozen.rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert frozen.scores.groupBy("method").count().where("count = 300").count() == 14


def test_leaky_split_moves_only_its_columns(spark):
    """The other columns aren't even computed; ranks by all-time counts against plain Python."""
    from rankforge.plans import benchmark
    from rankforge.sources import readers

    frame = readers.simulate_until(spark, 400)
    got = benchmark.leaky_split(frame.withColumn("planted_group", F.raise_error(F.lit("not needed")).cast("string")))
    assert got == pytest.approx(benchmark.leaky_split(frame.coalesce(1))) and 0 < got["prevalence"] < 1 and got["c"] in benchmark.GRID
    y = {r["gene_id"]: max(r["label_pre_cutoff"], r["label_post_cutoff"]) for r in frame.collect()}
    split = sampling.stratified_split(spark.createDataFrame([(k, int(v)) for k, v in y.items()], "ord string, y int"), "ord", "y", 20260729)
    held = [r["y"] for r in split.where("NOT is_train").collect()]
    assert got["prevalence"] == pytest.approx(sum(held) / len(held))


def test_benchmark_of_all_methods(spark):
    """Fourteen methods; metrics against plain Python on the frozen scores; the holdout is read once."""
    from rankforge.plans import benchmark
    from rankforge.sources import readers

    frozen = benchmark.freeze(readers.simulate_until(spark, 900), 3)
    got = {r["method"]: r.asDict() for r in benchmark.evaluate(frozen, replicates=20).collect()}
    assert len(got) == 14 and {r["holdout_accesses"] for r in got.values()} == {1}
    truth = {r["ord"]: r["label_post_cutoff"] for r in frozen.rows.collect() if not r["label_pre_cutoff"] and (r["entry_year"] is None or r["label_post_cutoff"])}
    for method in ("popularity", "supervised_with_popularity", "random_mlp_large", "random_mlp_small_ood_transfer", "random_ranking"):
        rows = [(r["score"], truth[r["ord"]]) for r in frozen.scores.where(F.col("method") == method).collect() if r["ord"] in truth]
        assert len(rows) == len(truth) == got[method]["n"]
        ap, tp, seen, positives = 0.0, 0, 0, sum(y for _, y in rows)
        for score in sorted({s for s, _ in rows}, reverse=True):
            tied = [y for s, y in rows if s == score]
            tp, seen = tp + sum(tied), seen + len(tied)
            ap += sum(tied) / positives * tp / seen
        assert np.isclose(ap, got[method]["auprc"], atol=1e-8)
    assert all(r["lower"] <= r["upper"] for r in got.values()) and got["popularity"]["excess"] == 0
    assert got["supervised_unmatched_compute"]["configurations"] == 12 and frozen.parameters["random_mlp_large"] > frozen.parameters["random_mlp_small"]
    assert frozen.efforts["popularity"].wall_seconds > 0
    leaky = {"supervised": 0.5, "popularity": 0.4, "prevalence": 0.1, "c": 1.0}
    assert len({name for name, *_ in benchmark.ablations(got, leaky, frozen.parameters)}) == 7
    states = dict((n, s) for n, s, _ in benchmark.predictions(got, leaky))
    assert states["random_initialisation_recovers_pretrained_share"] == "NOT_TESTED" and states["temporal_scores_lower_than_random"] == "HELD"


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_running_sums_in_one_window_and_over_range_partitions(spark, most):
    rng = np.random.default_rng(6)
    values = [0.0, 1e-320, -1e-320, 1e308, float("inf"), -float("inf"), float("nan"), None, *map(float, rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300)), *map(float, rng.random(200))]
    rows = [("a" if i % 3 else None, v, float(i)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "g string, v double, n double").groupBy("g", "v").agg(F.sum("n").alias("n"))
    for down in (False, True):
        got = ranking.running(frame, ["g"], "v", {"n": "before"}, down, most).collect()
        order = lambda r: (r["v"] is not None, np.isnan(r["v"]) if r["v"] is not None else False, 0.0 if r["v"] is None or np.isnan(r["v"]) else r["v"])
        assert len(got) == frame.count()
        for g in ("a", None):
            total = 0.0
            for r in sorted((r for r in got if r["g"] == g), key=order, reverse=down):
                assert r["before"] == total
                total += r["n"]


def test_transfer_proxy_against_plain_python(spark):
    """Observed contrasts, bootstraps, Spearman and overlap from the predictions, by hand; a planted signal transfers."""
    from rankforge.plans import transfer

    rng = np.random.default_rng(4)
    n, signal = 240, rng.normal(size=(240, 3))
    rows = [(f"g{i:03d}", float(signal[i, 0] + 0.1 * rng.normal()), float(rng.normal()) if i else None, [float(v) for v in signal[i]], [float(v) for v in rng.normal(size=4)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "ord string, target double, noise double, a array<double>, b array<double>")
    lesions = [(k, f"p{k % 4}", k % 2 == 0 if k < 7 else k == 7) for k in range(9)]
    cells = {(f"g{i:03d}", k): float((signal[i, 0] if lesions[k][2] else 0) + rng.normal() + 3) for i in range(n) for k in range(9) if rng.random() < 0.8}
    values = spark.createDataFrame([(g, k, v) for (g, k), v in cells.items()], "ord string, lesion long, value double")
    cohort = spark.createDataFrame(lesions, "lesion long, patient string, responder boolean")
    fitted = transfer.fit(frame, ["noise"], components=2, folds=3)
    assert set(fitted.methods) == {"direct", "manual", "a_static", "b_static", "a_random", "b_random", "manual_plus_a", "manual_plus_b"}
    names, weights = transfer.contrast_weights(cohort, 40, 5)
    assert names[:2] == ["all", "unmixed"] and {x for x in names if x.startswith("without")} == {f"without p{k}" for k in range(4)}
    truth = transfer.contrasts(values, weights, frame.select("ord"), names)
    got = {(r["ord"], r["contrast"]): r["delta"] for r in truth.collect()}
    mean = lambda g, ks: sum(cells.get((g, k), 0.0) for k in ks) / len(ks)
    for j, keep in ((0, range(9)), (names.index("without p1"), [k for k in range(9) if k % 4 != 1])):
        yes, no = [k for k in keep if lesions[k][2]], [k for k in keep if not lesions[k][2]]
        for g in ("g000", "g017", "g200"):
            assert np.isclose(got[g, j], mean(g, yes) - mean(g, no))
    rank = lambda x: np.array([(x < v).sum() + (x == v).sum() / 2 for v in x])
    found = {(r["method"], r["contrast"]): r["spearman"] for r in transfer.correlations(fitted, truth).collect()}
    for method in ("direct", "a_static", "manual_plus_b"):
        p = {r["ord"]: r["prediction"] for r in fitted.predictions.where(F.col("method") == method).collect()}
        order = sorted(p)
        want = np.corrcoef(rank(np.array([p[g] for g in order])), rank(np.array([got[g, 2] for g in order])))[0, 1]
        assert np.isclose(found[method, 2], want)
    proxy = transfer.transfer_proxy(frame, ["noise"], values, cohort, 2, 3, 40, 5, 50)
    metrics = {r["method"]: r for r in proxy.metrics.collect()}
    assert len(metrics) == 8 and metrics["a_static"]["transfer_spearman"] > 0.3 > metrics["a_random"]["transfer_spearman"]
    assert all(r["low"] <= r["median"] <= r["high"] for r in metrics.values()) and metrics["a_static"]["valid"] > 20
    assert proxy.comparisons.count() == 6
    assert {r["analysis"] for r in proxy.sensitivity.collect()} == {"all", "unmixed", "leave_one_patient_out"}
