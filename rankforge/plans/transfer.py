"""Response transfer: does what predicts a contrast in one cohort rank the contrast of another?

Every method is a set of columns of one frame of entities.  One pass adds up all
columns' moments by hash fold, from which all ridges of all methods, penalties and
folds are solved; another judges them.  The other cohort's contrasts, as observed,
without mixed clusters, without each cluster and in every cluster bootstrap, are
one matrix product.  A lesion's weight depends on its patient and response alone,
so its factors are sums by patient and response, made by a join, and a matrix with
a row for each of those; neither holds a lesion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalar import prefix_fold
from rankforge.operators import bootstrap, heads, ranking
from rankforge.session import rounded, settle
from rankforge.sources.readers import hash_normal

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
DIRECT = "direct"
COMPARISONS = (
    ("a_static", DIRECT), ("a_static", "a_random"), ("a_static", "manual"), ("manual_plus_a", "manual"), ("b_static", "b_random"), ("b_static", DIRECT),
)


def random_control(key: Column, width: int, seed: int) -> Column:
    """A vector of standard normals from the hash of an entity's key: an embedding that knows nothing."""
    return F.array(*[hash_normal(F.concat_ws("|", key, F.lit(i)), seed) for i in range(width)])


@dataclass
class Fitted:
    """entity, target and method columns; predictions (ord, method, prediction); one record for each method."""

    predictions: DataFrame
    methods: dict[str, dict]


def method_columns(rows: DataFrame, manual: Sequence[str], components: int, seed: int) -> tuple[DataFrame, dict[str, list[str]], dict[str, float]]:
    """The frame with the axes of both embeddings and of their random controls, the columns of each method, and the share of variance that the axes explain."""
    width = {e: rows.agg(F.max(F.size(e))).first()[0] or 1 for e in ("a", "b")}
    vectors = {f"{e}_static": F.col(e) for e in width} | {f"{e}_random": random_control(F.col("ord").cast("string"), w, seed + k) for k, (e, w) in enumerate(width.items())}
    wide, axes, explained = rows, {}, {}
    for name, vector in vectors.items():
        opened, inputs = heads.unpack(settle(rows.select("ord", vector.alias("v"))), "v", width[name[0]], "v")
        pca = heads.fit_pca(opened, inputs, components)
        projected, axes[name] = heads.unpack(pca.project(opened, "ord", "v", "axes"), "axes", len(pca.components), f"{name}_")
        explained[name] = float(pca.explained.sum())
        wide = wide.join(projected.drop("axes"), "ord")
    methods = {"manual": list(manual), **axes, "manual_plus_a": [*manual, *axes["a_static"]], "manual_plus_b": [*manual, *axes["b_static"]]}
    return settle(wide), methods, explained


def fit(rows: DataFrame, manual: Sequence[str], components: int = 32, folds: int = 5, seed: int = 1729, alphas: Sequence[float] = ALPHAS) -> Fitted:
    """`rows` has ord, target, the manual columns (null or not finite: 0) and the vectors a and b."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).otherwise(0.0)
    rows = settle(rows.withColumns({c: finite(c) for c in manual}).where(F.col("target").isNotNull() & ~F.isnan("target")))
    wide, methods, explained = method_columns(rows, manual, components, seed)
    names = [*manual, *[c for m in ("a_static", "b_static", "a_random", "b_random") for c in methods[m]]]
    d = len(names)
    center = np.array([v or 0.0 for v in wide.agg(*[F.avg(n) for n in names]).first()])
    inputs = settle(wide.select("ord", prefix_fold(F.col("ord").cast("string"), folds).alias("fold"), heads.vectors([*[F.col(n) - F.lit(float(m)) for n, m in zip(names, center, strict=True)], F.lit(1.0), F.col("target")]).alias("x")))

    def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        fold, x = batch.column(1).to_numpy(), heads.dense(batch.column(2), d + 2)
        for k in np.unique(fold):
            yield int(k), (x[fold == k].T @ x[fold == k]).ravel()

    sums = {k: v.reshape(d + 2, d + 2) for k, v in heads.array_sums(inputs, products).items()}
    every = sum(sums.values(), np.zeros((d + 2, d + 2)))
    places = {m: np.array([names.index(c) for c in cols]) for m, cols in methods.items()}

    def solved(method: str, alpha: float, full: np.ndarray) -> np.ndarray:
        at = np.append(places[method], [d, d + 1])
        out = np.zeros(d + 1)  # on centred columns, so that 0 is their centre
        out[at[:-1]] = heads.ridge_from_sums(full[np.ix_(at, at)], np.zeros(len(at) - 2), alpha)
        return out

    tries = [(m, a) for m in methods for a in sorted(alphas)]
    held_out = np.array([[solved(m, a, every - sums.get(f, 0.0)) for f in range(folds)] for m, a in tries])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column(1).to_numpy(), heads.dense(batch.column(2), d + 2)
            made = np.empty((len(tries), len(x)))
            for k in np.unique(fold):
                made[:, fold == k] = held_out[:, k] @ x[fold == k, : d + 1].T
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(tries)), len(x)), pa.int32()), pa.array(made.ravel()), pa.array(np.tile(x[:, d + 1], len(tries)))], names=["i", "prediction", "target"])

    judged = ranking.spearman(inputs.mapInArrow(out_of_fold, "i int, prediction double, target double"), ["i"], "prediction", "target")
    score = {r["i"]: r["spearman"] for r in judged.collect()}  # a row for each method and penalty
    best = {m: max((i for i, t in enumerate(tries) if t[0] == m), key=lambda i: (-2.0 if score.get(i) is None else score[i], -tries[i][1])) for m in methods}
    final = np.array([solved(m, tries[i][1], every) for m, i in best.items()])
    order = [*best, DIRECT]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = heads.dense(batch.column(2), d + 2)
            made = np.vstack([final @ x[:, : d + 1].T, x[:, d + 1]])
            ids = batch.column(0).take(pa.array(np.tile(np.arange(len(x)), len(order))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(order, len(x)).tolist(), pa.string()), pa.array(made.ravel())], names=["ord", "method", "prediction"])

    kind = inputs.schema["ord"].dataType.simpleString()
    records = {m: {"features": len(methods[m]), "alpha": tries[i][1], "own": score.get(i), "explained": explained.get(m)} for m, i in best.items()}
    records[DIRECT] = {"features": 1, "alpha": None, "own": 1.0, "explained": None}
    return Fitted(settle(inputs.mapInArrow(predict, f"ord {kind}, method string, prediction double")), records)


@dataclass
class Weights:
    """group (a number for each patient and response), lesion; and of each group its weight in all contrasts."""

    groups: DataFrame
    table: np.ndarray


def contrast_weights(lesions: DataFrame, iterations: int, seed: int) -> tuple[list[str], Weights]:
    """Names of the contrasts, and the weights of the lesions in them.

    `lesions` has lesion, patient and responder, a row for each lesion of the
    cohort.  `all`, `unmixed` (without patients of both responses), `without X`
    for each patient X, and `draw K` for bootstraps of whole patients.  A contrast
    that lacks one response is left out.  The driver sees a row for each patient
    and draw, no lesions.
    """
    known = settle(lesions.where("responder IS NOT NULL").select("lesion", "patient", F.col("responder").cast("boolean").alias("yes")))
    sizes = known.groupBy("patient").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))
    sizes = sorted((tuple(r) for r in sizes.collect()), key=lambda r: r[0])  # a row for each patient
    people = {p: k for k, (p, *_) in enumerate(sizes)}
    yes, no = (np.array([r[k] for r in sizes], dtype=float) for k in (1, 2))
    times = {"all": np.ones(len(people))}
    times["unmixed"] = ((yes == 0) | (no == 0)).astype(float)
    times |= {f"without {p}": (np.arange(len(people)) != k).astype(float) for p, k in people.items()}
    draws = bootstrap.cluster_draws(known.groupBy(F.col("patient").alias("cluster")).agg(F.max("yes").alias("yes"), F.max(~F.col("yes")).alias("no")), iterations, seed)
    for r in sorted(draws.collect()):  # a row for each patient and draw
        times.setdefault(f"draw {r['replicate']}", np.zeros(len(people)))[people[r["cluster"]]] = r["times"]
    names, columns = [], []
    for name, t in times.items():
        if t @ yes > 0 and t @ no > 0:
            names.append(name)
            columns.append(np.column_stack([-t / (t @ no), t / (t @ yes)]).ravel())  # a patient's groups: no, yes
    numbered = known.sparkSession.createDataFrame([(p, 2 * k) for p, k in people.items()], known.select("patient", F.lit(0).alias("group")).schema)
    groups = known.join(F.broadcast(numbered), "patient").select((F.col("group") + F.col("yes").cast("int")).alias("group"), "lesion")
    return names, Weights(groups, np.array(columns).T.reshape(2 * len(people), len(names)))


#: Numbers that are multiplied at once.
TOGETHER = 1 << 20


def contrasts(values: DataFrame, weights: Weights, entities: DataFrame, names: Sequence[str]) -> DataFrame:
    """ord, contrast (its place in `names`), delta for all entities; what `values` (ord, lesion, value) doesn't have is 0."""
    table = weights.table

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, TOGETHER // max(1, *table.shape))
        for batch in batches:
            for at in range(0, len(batch), some):
                part = batch.slice(at, some)
                cells, sizes = part.column(1).flatten(), pa.compute.fill_null(pa.compute.list_value_length(part.column(1)), 0).to_numpy()
                sums = np.zeros((len(part), len(table)))
                sums[np.repeat(np.arange(len(part)), sizes), cells.field("group").to_numpy()] = cells.field("total").to_numpy()
                made = sums @ table
                ends = pa.array(np.arange(len(part) + 1) * len(names), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=["ord", "deltas"])

    own = values.join(weights.groups, "lesion").groupBy("ord", "group").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    held = own.groupBy("ord").agg(F.collect_list(F.struct("group", "total")).alias("cells"))
    kind = entities.schema["ord"].dataType.simpleString()
    made = entities.select("ord").join(held, "ord", "left").mapInArrow(weigh, f"ord {kind}, deltas array<double>")
    return made.select("ord", F.posexplode("deltas").alias("contrast", "delta"))


def correlations(fitted: Fitted, truth: DataFrame) -> DataFrame:
    """method, contrast, spearman: ranks are made once for each method and each contrast."""
    own = ranking.tied_rank(fitted.predictions, ["method"], "prediction", "own").select("ord", "method", "own")
    other = ranking.tied_rank(truth, ["contrast"], "delta", "other").select("ord", "contrast", "other")
    pairs = other.join(own, "ord").groupBy("method", "contrast").agg(F.covar_pop("own", "other").alias("c"), (F.stddev_pop("own") * F.stddev_pop("other")).alias("s"), F.count(F.lit(1)).alias("n"))
    return pairs.select("method", "contrast", F.when(F.col("n") >= 3, F.try_divide("c", "s")).alias("spearman"))


@dataclass
class Proxy:
    metrics: DataFrame
    comparisons: DataFrame
    sensitivity: DataFrame


def transfer_proxy(rows: DataFrame, manual: Sequence[str], values: DataFrame, lesions: DataFrame, components: int = 32, folds: int = 5, iterations: int = 300, seed: int = 1729, most: int = 500) -> Proxy:
    """Eight methods: their metrics with cluster bootstrap intervals, six paired comparisons, and sensitivity to patients."""
    fitted = fit(rows, manual, components, folds, seed)
    names, weights = contrast_weights(lesions, iterations, seed)
    spark = rows.sparkSession
    entities = fitted.predictions.where(F.col("method") == DIRECT)
    truth = settle(contrasts(values, weights, entities, names))
    labelled = F.broadcast(spark.createDataFrame(list(enumerate(names)), "contrast int, name string"))  # a row for each contrast
    found = settle(correlations(fitted, truth).join(labelled, "contrast"))
    drawn = found.where("startswith(name, 'draw ')")

    q = F.percentile("spearman", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    spread = drawn.groupBy("method").agg(q.alias("q"), F.count("spearman").alias("valid"))
    records = spark.createDataFrame([(m, r["features"], r["alpha"], r["own"], r["explained"]) for m, r in fitted.methods.items()], "method string, features int, alpha double, own_spearman double, explained double")
    plain = found.where("name = 'all'").select("method", F.col("spearman").alias("transfer_spearman"))
    both = fitted.predictions.join(truth.where("contrast = 0").select("ord", F.col("delta").alias("truth")), "ord")
    first = lambda column, name: ranking.top(both.withColumn("size", F.abs(column)), ["method"], most, "size").select("ord", "method", F.lit(True).alias(name))
    shared = first("prediction", "p").join(first("truth", "t"), ["ord", "method"]).join(both, ["ord", "method"])
    n = F.count(F.lit(1))
    overlap = shared.groupBy("method").agg(n.alias("shared"), F.avg((F.signum("prediction") == F.signum("truth")).cast("double")).alias("direction"))
    sizes = both.groupBy("method").agg(F.least(n, F.lit(most)).alias("k"))
    metrics = records.join(plain, "method").join(spread, "method").join(sizes, "method").join(overlap, "method", "left")
    numbers = {
        "own_spearman": F.col("own_spearman"), "transfer_spearman": F.col("transfer_spearman"), "low": F.col("q")[0], "median": F.col("q")[1], "high": F.col("q")[2],
        "explained": F.col("explained"), "overlap": F.coalesce("shared", F.lit(0)) / F.col("k"), "direction": F.coalesce("direction", F.lit(0.0)),
    }
    metrics = metrics.select("method", "features", "alpha", "valid", *[rounded(c, 6).alias(name) for name, c in numbers.items()])

    asked = F.broadcast(spark.createDataFrame(list(COMPARISONS), "method_a string, method_b string"))
    side = lambda s: drawn.select(F.col("method").alias(f"method_{s}"), "contrast", F.col("spearman").alias(s))
    paired = side("a").join(asked, "method_a").join(side("b"), ["method_b", "contrast"]).withColumn("difference", F.col("a") - F.col("b"))
    d = F.percentile("difference", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    paired = paired.groupBy("method_a", "method_b").agg(d.alias("q"), F.avg((F.col("difference") > 0).cast("double")).alias("above"))
    paired = paired.select("method_a", "method_b", *[rounded(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "median", "high"))], rounded("above", 6).alias("share_above_zero"))

    kept = found.where("NOT startswith(name, 'draw ')")
    analysis = F.when(F.startswith("name", F.lit("without ")), "leave_one_patient_out").otherwise(F.col("name"))
    spread = kept.groupBy("method", analysis.alias("analysis")).agg(F.count("spearman").alias("n"), F.percentile("spearman", F.lit(0.5)).alias("median"), F.min("spearman").alias("lowest"), F.max("spearman").alias("highest"))
    sensitivity = spread.select("method", "analysis", "n", *[rounded(c, 6).alias(c) for c in ("median", "lowest", "highest")])
    return Proxy(metrics, paired, sensitivity)
