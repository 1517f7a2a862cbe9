"""Pooling, tokenisers, geometry, cluster bootstrap and model heads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import scalar
from rankforge.operators import bootstrap, candidates, crossfit, heads, matrix, pooling, ranking
from rankforge.operators.replicates import draws_sql
from rankforge.plans.base import CELLS, CONTEXTS, SCORED, cells, contexts, query, scored
from rankforge.plans.metrics import _INTERVAL
from rankforge.plans.tables import view_sql
from rankforge.session import rounded, settle, table

_ROUND = "list_transform({0}, lambda x: round(x, 6))"


def _vector(name: str = "vector"):
    return F.transform(name, lambda x: rounded(x, 6)).alias("vector")


_VIEWS = ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in view_sql().items())


@query(
    "a19_view_means",
    f"""WITH {CONTEXTS}, hit AS (SELECT gene_id, unnest([{_VIEWS}]) AS view, embedding FROM contexts),
e AS (SELECT gene_id, view, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM hit WHERE view IS NOT NULL),
m AS (SELECT gene_id, view, list(x ORDER BY i) AS v FROM (SELECT gene_id, view, i, avg(x) AS x FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
grid AS (SELECT gene_id, unnest([{', '.join(f"'{n}'" for n in view_sql())}]) AS view FROM (SELECT DISTINCT gene_id FROM contexts))
SELECT gene_id, view, {_ROUND.format("coalesce(v, list_transform(range((SELECT max(len(embedding)) FROM contexts)), lambda x: 0.0::DOUBLE))")} AS vector, (v IS NOT NULL)::INTEGER AS available FROM grid LEFT JOIN m USING (gene_id, view)""",
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    rows = contexts(spark, sf)
    return pooling.pool_by_view(rows, "gene_id", scalar.views(), "embedding", _width(rows)).select("gene_id", "view", _vector(), "available")


@query(
    "a20_balanced_pooling",
    f"""WITH {CONTEXTS}, e AS (SELECT gene_id, disease, sample, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM contexts WHERE disease IS NOT NULL),
one AS (SELECT gene_id, disease, sample, i, avg(x) AS x FROM e GROUP BY ALL), two AS (SELECT gene_id, disease, i, avg(x) AS x FROM one GROUP BY ALL),
c AS (SELECT gene_id, disease, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_samples FROM (SELECT gene_id, disease, sample, count(DISTINCT vec_id) AS n FROM e GROUP BY ALL) GROUP BY ALL)
SELECT gene_id, disease, {_ROUND.format("list(x ORDER BY i)")} AS vector, any_value(n_cells) AS n_cells, any_value(n_samples) AS n_samples FROM two JOIN c USING (gene_id, disease) GROUP BY 1, 2""",
)
def a20(spark: SparkSession, sf: str) -> DataFrame:
    tokens = contexts(spark, sf).where("disease IS NOT NULL")
    return pooling.balanced_pool(tokens, "gene_id", "sample", ["disease"], "vec_id").select("gene_id", "disease", _vector(), "n_cells", "n_samples")


@query("a18_distinct_contexts", f"WITH {CONTEXTS} SELECT count(*) AS n FROM (SELECT DISTINCT disease, cell_compartment, treatment_state, response_state FROM contexts)")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(spark, sf).select("disease", "cell_compartment", "treatment_state", "response_state").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("a21_distinct_cells", f"WITH {CELLS} SELECT gene, sample, count(DISTINCT cell) AS n_cells FROM cells GROUP BY 1, 2")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).groupBy("gene", "sample").agg(F.count_distinct("cell").alias("n_cells"))


@query(
    "a23_vector_health",
    "SELECT (SELECT count(*) FROM embeddings) AS n, 0::BIGINT AS bad, (SELECT count(DISTINCT len(embedding)) FROM embeddings) AS widths, (SELECT round(var_pop(x::DOUBLE), 9) FROM (SELECT unnest(embedding) AS x FROM embeddings)) AS variance",
)
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.vector_health(table(spark, sf, "embeddings")).withColumn("variance", rounded("variance"))


@query(
    "a24_gram_matrix",
    f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 6) AS g FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""",
)
def a24(spark: SparkSession, sf: str) -> DataFrame:
    """All components against all; the tasks add up matrices, and one row for each pair of components is left."""
    rows, names = _features(spark, sf)
    gram = heads.moments(rows, [F.col(n) for n in names])
    return spark.createDataFrame([(i, j, float(g)) for (i, j), g in np.ndenumerate(gram)], "i long, j long, g double").withColumn("g", rounded("g", 6))


# tokenisers: a cell is an order, a gene a part

#: Tokens of a sequence at most: far above the genes of an ordinary cell.
LENGTH = 2048

_COUNTS = f"""{CELLS}, counts AS (SELECT cell, gene, gene AS ord, sum(value) AS value FROM cells GROUP BY 1, 2)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))
    return lines.groupBy("cell", "gene").agg(F.sum("value").alias("value")).withColumn("ord", F.col("gene"))


@query(
    "m19_rank_tokens",
    f"""WITH {_COUNTS}, t AS (SELECT cell, sum(value) AS total FROM counts GROUP BY 1), d AS (SELECT p_partkey AS gene, p_partkey + 1000 AS token, p_size::DOUBLE AS median FROM part WHERE p_partkey % 4 > 0),
r AS (SELECT cell, token, ord, row_number() OVER (PARTITION BY cell ORDER BY value / total * 10000.0::DOUBLE / greatest(median, 1e-12) DESC, ord) AS rn FROM counts JOIN d USING (gene) JOIN t USING (cell) WHERE value > 0 AND total > 0)
SELECT cell, list(token ORDER BY rn) AS tokens, list(ord ORDER BY rn) AS genes FROM r WHERE rn <= {LENGTH} GROUP BY 1""",
)
def m19(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = table(spark, sf, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") + 1000).alias("token"), F.col("p_size").cast("double").alias("median"))
    return pooling.rank_tokens(_counts(spark, sf), dictionary, LENGTH)


@query(
    "m20_binned_tokens",
    f"""WITH {_COUNTS}, d AS (SELECT p_partkey AS gene, p_partkey + 1000 AS token FROM part WHERE p_partkey % 4 > 0), m AS (SELECT * FROM counts JOIN d USING (gene)),
t AS (SELECT cell, sum(value) AS total FROM m GROUP BY 1), s AS (SELECT cell, token, ord, ln(1 + value / total * 10000.0::DOUBLE) AS x FROM m JOIN t USING (cell) WHERE value > 0),
e AS (SELECT cell, quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM s GROUP BY 1),
r AS (SELECT cell, token, row_number() OVER (PARTITION BY cell ORDER BY x DESC, ord) AS rn, (len(list_filter(edges, lambda q: q < x)) + 1)::DOUBLE AS bin FROM s JOIN e USING (cell)),
p AS (SELECT cell, list(token ORDER BY rn) AS tk, list(bin ORDER BY rn) AS vl FROM r WHERE rn < {LENGTH} GROUP BY 1)
SELECT cell, list_concat([7::BIGINT], coalesce(tk, [])) AS tokens, list_concat([0.0::DOUBLE], coalesce(vl, [])) AS values FROM (SELECT DISTINCT cell FROM counts) LEFT JOIN p USING (cell)""",
)
def m20(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = table(spark, sf, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") + 1000).alias("token"))
    return pooling.binned_tokens(_counts(spark, sf), vocabulary, LENGTH, 6, 7)


_CONTROL_SEED = 1729
_CONTROL = "CAST('0x' || substr(sha256('{0}|' || p_partkey || '|' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(
    "m22_static_embedding_lookup",
    f"""WITH w AS (SELECT max(len(embedding)) AS w FROM embeddings)
SELECT p_partkey, embedding IS NOT NULL AS covered, list_transform(coalesce(embedding, list_transform(range(w), lambda i: 0)), lambda x: round(x::DOUBLE, 6)) AS vector,
       list_transform(range(w), lambda i: round(sqrt(-2.0 * ln(1.0 - {_CONTROL.format(_CONTROL_SEED)})) * cos(2 * 3.141592653589793::DOUBLE * {_CONTROL.format(_CONTROL_SEED + 7919)}), 6)) AS control
FROM part LEFT JOIN embeddings ON vec_id = p_partkey, w""",
)
def m22(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's vector, zeros where it isn't covered, beside a random control of the same shape."""
    from rankforge.plans.transfer import random_control

    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    joined = table(spark, sf, "part").select("p_partkey").join(vectors, "p_partkey", "left")
    six = lambda v: F.transform(v, lambda x: rounded(x.cast("double"), 6))
    control = random_control(F.col("p_partkey").cast("string"), width, _CONTROL_SEED)
    return joined.select("p_partkey", F.col("embedding").isNotNull().alias("covered"), six(F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), width))).alias("vector"), six(control).alias("control"))


@query(
    "r16_geometry_correlation",
    """WITH v AS (SELECT vec_id, embedding[1:len(embedding) // 2]::DOUBLE[] AS f, embedding[len(embedding) // 2 + 1:len(embedding)]::DOUBLE[] AS s FROM embeddings),
p AS (SELECT list_cosine_similarity(a.f, b.f) AS x, list_cosine_similarity(a.s, b.s) AS y FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT count(*) AS pairs, round(corr(x, y), 6) AS correlation FROM p""",
)
def r16(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings at their full width, first half against second."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), half).alias("f"), F.slice("embedding", half + 1, F.size("embedding") - half).alias("s"))
    return pooling.geometry_correlation(rows, "vec_id", "f", "s").withColumn("correlation", rounded("correlation", 6))


_CLUSTERS, _SEED = 300, 12
_CLUSTER_VALUES = "v AS (SELECT user_id % 20 AS cluster, event_type AS entity, user_id % 3 = 0 AS responder, value FROM events)"
_CLUSTER_SQL = f"""WITH {_CLUSTER_VALUES}, known AS (SELECT cluster AS ord, max(responder) AS yes, max(NOT responder) AS no FROM v GROUP BY 1),
{draws_sql("known", _CLUSTERS * sum(bootstrap.ATTEMPTS), _SEED)},
attempts AS (SELECT replicate % {_CLUSTERS} AS of, replicate // {_CLUSTERS} AS attempt, ord AS cluster, yes, no, times FROM drawn),
first AS (SELECT of, min(attempt) AS attempt FROM (SELECT of, attempt FROM attempts GROUP BY 1, 2 HAVING max(yes) AND max(no)) GROUP BY 1),
t AS (SELECT of AS replicate, cluster, times FROM attempts JOIN first USING (of, attempt)),
d AS (SELECT replicate, entity, sum(value * times) FILTER (responder) / sum(times) FILTER (responder) - sum(value * times) FILTER (NOT responder) / sum(times) FILTER (NOT responder) AS delta FROM v JOIN t USING (cluster) GROUP BY 1, 2)
SELECT entity, {_INTERVAL.format('delta')} FROM d WHERE delta IS NOT NULL GROUP BY 1"""


@query("r15_cluster_bootstrap", _CLUSTER_SQL)
def r15(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select((F.col("user_id") % 20).alias("cluster"), F.col("event_type").alias("entity"), (F.col("user_id") % 3 == 0).alias("responder"), "value")
    clusters = values.groupBy("cluster").agg(F.max("responder").alias("yes"), F.max(~F.col("responder")).alias("no"))
    draws = bootstrap.cluster_draws(clusters, _CLUSTERS, _SEED)
    out = bootstrap.interval(bootstrap.cluster_contrast(values, draws), ["entity"], "delta")
    return out.select("entity", rounded("lower").alias("lower"), rounded("upper").alias("upper"), "valid")


# heads; fitted on the driver from aggregated sums, so rows only are compared


@query(
    "m10_random_ranking",
    f"""WITH {SCORED}, u AS (SELECT s, y, CAST('0x' || substr(sha256(s || '|' || ord), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS score FROM scored, (VALUES (1), (2), (3)) v(s)),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC) AS n, sum(y) OVER (PARTITION BY s ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM u)
SELECT s AS seed, round(sum(CASE WHEN y = 1 THEN tp / n::DOUBLE END) / sum(y), 9) AS auprc FROM r GROUP BY 1""",
)
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return heads.random_ranking(scored(spark, sf), "ord", "y", (1, 2, 3)).select("seed", rounded("auprc").alias("auprc"))


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("embedding"))).first()[0] or 0


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("vec_id").alias("ord"), "embedding")
    return heads.unpack(rows, "embedding", _width(rows))


def _train() -> Column:
    return scalar.prefix_fold(F.col("vec_id").cast("string"), 10) < 7


@query(
    "m06_scalar_baseline",
    f"""WITH {SCORED}, f AS (SELECT ord, y, alt, CAST('0x' || substr(sha256(CAST(ord AS VARCHAR)), 1, 16) AS UBIGINT) % 10 < 7 AS is_train FROM scored),
q AS (SELECT quantile_cont(alt, [0.25, 0.5, 0.75]) AS q FROM f WHERE is_train),
c AS (SELECT ord, y, is_train, alt AS identity, (row_number() OVER (ORDER BY alt, ord) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS percentile_rank, (alt - q[2]) / CASE WHEN q[3] = q[1] THEN 1 ELSE q[3] - q[1] END AS robust_z FROM f, q),
long AS (SELECT ord, y, is_train, unnest(['identity', 'percentile_rank', 'robust_z']) AS configuration, unnest([1, 2, 3]) AS i, unnest([identity, percentile_rank, robust_z]) AS score FROM c),
steps AS (SELECT configuration, i, score, sum(y) AS tp, count(*) AS n FROM long WHERE NOT is_train GROUP BY ALL),
run AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM steps WINDOW w AS (PARTITION BY configuration ORDER BY score DESC)),
best AS (SELECT configuration FROM run GROUP BY configuration, i ORDER BY round(sum(tp * ctp / cn::DOUBLE) / sum(tp), 12) DESC, i LIMIT 1)
SELECT ord, configuration, round(score, 9) AS score FROM long JOIN best USING (configuration)""",
)
def m06(spark: SparkSession, sf: str) -> DataFrame:
    """ord, configuration, score of the tuned popularity-like scalar."""
    rows = scored(spark, sf).withColumn("fold", scalar.prefix_fold(F.col("ord").cast("string"), 10))
    train = F.col("fold") < 7
    best = heads.tune_scalar(rows, "alt", "y", train)
    return heads.scalar_candidates(rows, "alt", train).select("ord", F.lit(best).alias("configuration"), rounded(best).alias("score"))


def _binary(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows, names = _features(spark, sf)
    return rows.withColumn("y", (F.col("label") < 5).cast("int")), names


def _supervised(spark: SparkSession, sf: str, grid: tuple[float, ...]) -> DataFrame:
    rows, names = _binary(spark, sf)
    c, model = heads.supervised(rows, names, "y", _train(), grid)
    return rows.select("vec_id", F.lit(c).alias("c"), rounded(model.predict(names), 6).alias("probability"))


@query("m07_supervised_head")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    return _supervised(spark, sf, (0.1, 1.0, 10.0))


@query("m08_unmatched_head")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    return _supervised(spark, sf, tuple(10.0 ** (k / 2) for k in range(-6, 6)))


@query("m09_random_mlp_head")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _binary(spark, sf)
    net = heads.random_mlp(len(names), "small", 0)
    scaler = heads.fit_scaler(rows, names)
    hidden = [f"h{i}" for i in range(net.second.shape[1])]
    mapped = settle(rows.select("vec_id", "y", *[c.alias(n) for c, n in zip(net.columns(scaler.columns(names)), hidden, strict=True)]))
    c, model = heads.supervised(mapped, hidden, "y", _train())
    return mapped.select("vec_id", F.lit(net.parameters).alias("parameters"), F.lit(c).alias("c"), rounded(model.predict(hidden), 6).alias("probability"))


@query("m11_frozen_transfer")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    """A head fitted on the first half of the columns, applied to the second under the same names."""
    rows, names = _binary(spark, sf)
    half = len(names) // 2
    names = names[:half]
    _, model = heads.supervised(rows, names, "y", _train())
    shifted, _ = heads.unpack(rows.select("vec_id", F.slice("embedding", half + 1, half).alias("other")), "other", half)
    return shifted.select("vec_id", rounded(model.predict(names), 6).alias("probability"))


@query("m12_embedding_head_by_first_positive")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    """C chosen by the rank of the first positive outside the training rows, not by average precision."""
    rows, names = _binary(spark, sf)
    grid = (0.1, 1.0, 10.0)
    models = heads.fit_logistics(rows.where(_train()), names, "y", grid)
    held = heads.scored_by(models, rows.where(~_train()).withColumn("ord", F.col("vec_id")), names)
    got = {r["m"]: r["rr"] for r in ranking.reciprocal_rank(held, ["m"]).collect()}
    c = grid[max(range(len(grid)), key=lambda m: (got.get(m, -1.0), -m))]
    model = heads.fit_logistic(rows, names, "y", c)
    return rows.select("vec_id", F.lit(c).alias("c"), rounded(model.predict(names), 6).alias("probability"))


@query("m13_ridge_by_folds")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _features(spark, sf)
    alpha, out = heads.ridge_by_folds(rows.withColumn("key", F.col("vec_id").cast("string")), names, "label", "key", (0.1, 1.0, 10.0, 100.0), 5)
    return out.select("ord", F.lit(alpha).alias("alpha"), rounded("prediction", 6).alias("prediction"))


@query("m14_scaled_pca")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _features(spark, sf)
    pca = heads.fit_pca(rows, names, 3)
    parts = [rounded(c, 6).alias(f"pc{i}") for i, c in enumerate(pca.columns(names))]
    return rows.select("vec_id", *parts, rounded(F.lit(float(pca.explained.sum()))).alias("explained"))


@query("m15_development_pca")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    """Axes from the development rows alone; rows without a usable vector become zeros."""
    rows, names = _features(spark, sf)
    usable = F.forall("embedding", lambda x: ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0) & (F.col("vec_id") % 11 != 0)
    pca = heads.fit_pca(rows.where(usable & _train()), names, 3)
    parts = [F.when(usable, rounded(c, 6)).otherwise(0.0).alias(f"pc{i}") for i, c in enumerate(pca.columns(names))]
    return rows.select("vec_id", *parts)


@query("m21_encoder_interface")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    """Token sequences through an encoder plugged into mapInPandas; here a fixed stand-in, no checkpoint is shipped."""
    from rankforge.operators.encoding import encode, stand_in

    return encode(m19(spark, sf), stand_in(4), 4)


@query("m17_leaky_split_ablation")
def m17(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision of one head on the honest and on the leaky split."""
    rows, names = _binary(spark, sf)
    out = []
    for name, train in (("temporal", _train()), ("random", scalar.uniform(F.col("vec_id").cast("string"), 17) < 0.7)):
        model = heads.fit_logistic(rows.where(train), names, "y", 1.0)
        held = rows.where(~train).select("y", model.predict(names).alias("score"))
        out.append(ranking.average_precision(held, []).select(F.lit(name).alias("split"), rounded("auprc", 6).alias("auprc")))
    return out[0].unionByName(out[1])


@query("m18_benchmark")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    """Seven raw scores on the documents' labels, 400 replicates; `m18_benchmark_methods` has the fitted methods."""
    from rankforge.plans.benchmark import run_benchmark

    return run_benchmark(scored(spark, sf))


_CUTOFF_YEAR, _END_YEAR = 1997, 1999
_SEEN = f"r.y <= {_CUTOFF_YEAR}"


def _domain_sql(d: str, odd: int) -> str:
    rows = f"{_SEEN} AND l_suppkey % 2 = {odd}"
    return f"""round(coalesce(avg(l_quantity) FILTER ({rows}), 0)::DOUBLE, 6) AS mean_expression_{d},
  round(coalesce(avg(l_discount) FILTER ({rows} AND l_returnflag = 'R') - avg(l_discount) FILTER ({rows} AND l_returnflag <> 'R'), 0)::DOUBLE, 6) AS differential_expression_{d}"""


@query(
    "m18_candidate_table",
    f"""WITH r AS (SELECT l.*, CAST(year(o_orderdate) AS INTEGER) AS y FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT l_partkey, min(r.y) FILTER (l_quantity >= 49) AS entry_year, count(*) FILTER ({_SEEN}) AS before, count(*) AS every, count(DISTINCT l_suppkey) FILTER ({_SEEN}) AS places,
  {_domain_sql("id", 0)}, {_domain_sql("ood", 1)} FROM r GROUP BY 1),
g AS (SELECT l_partkey, l_shipmode, sum(l_quantity) FILTER (l_suppkey % 2 = 0) AS a, sum(l_quantity) FILTER (l_suppkey % 2 = 1) AS b FROM (SELECT *, l_suppkey % 7 AS l_shipmode FROM r WHERE {_SEEN}) GROUP BY 1, 2),
s AS (SELECT l_partkey, max(a) / sum(a) AS a, max(b) / sum(b) AS b FROM g GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS gene_id, 'noise' AS planted_group, entry_year, coalesce((entry_year <= {_CUTOFF_YEAR})::INTEGER, 0) AS label_pre_cutoff,
  coalesce((entry_year > {_CUTOFF_YEAR} AND entry_year <= {_END_YEAR})::INTEGER, 0) AS label_post_cutoff, coalesce(before, 0) AS publication_count_pre_cutoff, coalesce(every, 0) AS publication_count_all_time,
  coalesce(mean_expression_id, 0) AS mean_expression_id, coalesce(mean_expression_ood, 0) AS mean_expression_ood, coalesce(differential_expression_id, 0) AS differential_expression_id,
  coalesce(differential_expression_ood, 0) AS differential_expression_ood, round(coalesce(s.a, 0)::DOUBLE, 6) AS cell_type_specificity_id, round(coalesce(s.b, 0)::DOUBLE, 6) AS cell_type_specificity_ood,
  round(coalesce(places / (SELECT count(DISTINCT l_suppkey) FROM lineitem)::DOUBLE, 0), 6) AS network_centrality, (p_size < 10)::INTEGER AS druggable_class, {_CUTOFF_YEAR} AS cutoff_year, {_END_YEAR} AS evaluation_end_year
FROM part LEFT JOIN e ON e.l_partkey = p_partkey LEFT JOIN s ON s.l_partkey = p_partkey""",
)
def m18_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates: an entry is the first order of 49 or more; suppliers are the places, their parity the domain."""
    made = _candidates(spark, sf)
    return made.select([rounded(c, 6).alias(c) if t == "double" else c for c, t in made.dtypes])


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "lineitem")
    lines = every.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = lines.select(
        F.col("l_partkey").cast("string").alias("gene_id"), F.year("o_orderdate").alias("year"), (F.col("l_suppkey") % 2 == 1).alias("ood"), (F.col("l_suppkey") % 7).alias("grp"), F.col("l_suppkey").alias("place"),
        (F.col("l_returnflag") == "R").alias("is_case"), (F.col("l_quantity") >= 49).alias("is_entry"), F.col("l_quantity").cast("double").alias("value"), F.col("l_discount").cast("double").alias("level"),
    )
    entities = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), (F.col("p_size") < 10).cast("int").alias("druggable_class"))
    return candidates.candidate_table(entities, records, _CUTOFF_YEAR, _END_YEAR, every.select(F.col("l_suppkey").alias("place")))


@query("m18_benchmark_methods")
def m18_methods(spark: SparkSession, sf: str) -> DataFrame:
    """All 14 methods on the parts: tuned scalars, heads, random nets of both sizes, transfers; 400 paired replicates."""
    from rankforge.plans import benchmark

    return benchmark.evaluate(benchmark.freeze(settle(_candidates(spark, sf))))


@query("m18_benchmark_conclusions")
def m18_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Seven ablations and four registered predictions of the benchmark on the parts, in which nothing is planted to diagnose."""
    from rankforge.plans import benchmark

    frame = settle(_candidates(spark, sf))
    frozen = benchmark.freeze(frame)
    results = {r["method"]: r.asDict() for r in benchmark.evaluate(frozen).collect()}  # a row for each method
    leaky = benchmark.leaky_split(frame)
    rows = [("ablation", *r) for r in benchmark.ablations(results, leaky, frozen.parameters)]
    rows += [("prediction", name, status, "observed", value) for name, status, value in benchmark.predictions(results, leaky)]
    return spark.createDataFrame(rows, "kind string, name string, status string, figure string, value double").withColumn("value", rounded("value"))


@query("m24_calibrated_head")
def m24(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic fit on the head's own score (Platt), from the rows that the head did not see."""
    rows, names = _binary(spark, sf)
    head = heads.fit_logistic(rows.where(_train()), names, "y", 1.0)
    scored_rows = settle(rows.select("vec_id", "y", head.predict(names).alias("raw")))
    platt = heads.fit_logistic(scored_rows.where(~_train()), ["raw"], "y", 10.0)
    return scored_rows.select("vec_id", rounded("raw", 6).alias("raw"), rounded(platt.predict(["raw"]), 6).alias("calibrated"))


@query("m24_cross_fitted_head")
def m24_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and calibrations by models that saw neither the row nor its fold."""
    rows, names = _binary(spark, sf)
    made = crossfit.cross_fit(rows, names, "y", "vec_id").rows
    return made.select(F.col("key").alias("vec_id"), "fold", rounded("raw", 6).alias("raw"), rounded("calibrated", 6).alias("calibrated"))


@query("m14_wide_pca")
def m14_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Axes by a randomised range, whose share of the variance is the exact one at this width."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pca = heads.fit_wide_pca(rows, "embedding", 3)
    out = pca.project(rows, "vec_id", "embedding", "axes")
    return out.select("vec_id", *[rounded(F.get("axes", F.lit(i)), 6).alias(f"pc{i}") for i in range(3)], rounded(F.lit(float(pca.explained.sum()))).alias("explained"))


# the response-transfer proxy: entities are parts with a vector, lesions suppliers, patients their nations

_MANUAL = ("size", "price", "lines", "quantity", "tax", "share_a")


def _transfer(spark: SparkSession, sf: str):
    from rankforge.plans.transfer import transfer_proxy

    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    seen = lines.groupBy(F.col("l_partkey").alias("ord")).agg(
        (F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))) - F.avg(F.when(F.col("l_returnflag") != "R", F.col("l_discount")))).alias("target"),
        F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.avg((F.col("l_returnflag") == "A").cast("double")).alias("share_a"),
    )
    half = F.floor(F.size("embedding") / 2).cast("int")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.slice("embedding", F.lit(1), half).alias("a"), F.slice("embedding", half + 1, half).alias("b"))
    rows = part.select(F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).join(seen, "ord").join(vectors, "ord")
    values = matrix.cpm(matrix.group_sums(cells(spark, sf), ["sample"]), log="log2").select(F.col("gene").alias("ord"), F.col("sample").alias("lesion"), F.col("log_cpm").alias("value"))
    lesions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lesion"), F.col("s_nationkey").alias("patient"), (F.col("s_suppkey") % 3 == 0).alias("responder"))
    return transfer_proxy(rows, _MANUAL, values, lesions)


@query("m13_transfer_metrics")
def m13_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Eight methods: out-of-fold and transferred Spearman, 300 cluster bootstraps, overlap of the extremes."""
    return _transfer(spark, sf).metrics


@query("j10_transfer_comparisons")
def j10_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """The six paired comparisons of the transfer on the same bootstraps."""
    return _transfer(spark, sf).comparisons


@query("j12_transfer_sensitivity")
def j12_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """The transfer on all lesions, without mixed patients, and without each patient."""
    return _transfer(spark, sf).sensitivity
