"""The audit in one job graph: methods, metrics, paired intervals, states, claims."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalar import robust_z, uniform
from rankforge.operators import bootstrap, heads, ranking, sampling
from rankforge.operators import replicates as exact
from rankforge.session import rounded, settle

REFERENCE = "popularity"


@dataclass
class Effort:
    """Wall and CPU seconds of the driver, and the configurations that were tried."""

    configurations: int = 0
    wall_seconds: float = 0.0
    cpu_seconds: float = 0.0

    def __enter__(self) -> Effort:
        self._wall, self._cpu = time.perf_counter(), time.process_time()
        return self

    def __exit__(self, *_: object) -> None:
        self.wall_seconds += time.perf_counter() - self._wall
        self.cpu_seconds += time.process_time() - self._cpu


class Holdout:
    """Counts how often the holdout's labels are read, so that a second look shows."""

    def __init__(self, rows: DataFrame) -> None:
        self._rows, self.accesses = rows, 0

    def read(self) -> DataFrame:
        self.accesses += 1
        return self._rows


def default_methods() -> dict[str, Column]:
    """Score columns over a frame with score, alt, p and ord."""
    key = F.col("ord").cast("string")
    return {REFERENCE: F.col("score"), "length": F.col("alt"), "inverse_length": -F.col("alt"), "probability": F.col("p")} | {f"random_{s}": uniform(key, s) for s in (1, 2, 3)}


def paired_spread(wide: DataFrame, scores: Mapping[str, str], replicates: int, seed: int) -> DataFrame:
    """method, lower, upper, valid of the difference to the reference's average precision, all methods on the same draws."""
    per = settle(exact.replicate_metrics(wide, scores, [exact.AVERAGE_PRECISION], replicates, seed))
    base = per.where(F.col("method") == REFERENCE).select("replicate", F.col("value").alias("base"))
    return bootstrap.interval(per.join(base, "replicate").withColumn("difference", F.col("value") - F.col("base")), ["method"], "difference")


def run_benchmark(rows: DataFrame, methods: Mapping[str, Column] | None = None, k: int = 20, replicates: int = 400, seed: int = 5) -> DataFrame:
    """method, precision, recall, rr, auprc, lower and upper of the paired difference to popularity, state.

    One long frame (method, row) carries all methods through each metric, and
    all replicates of all methods are one job; the holdout is read once.
    """
    methods = dict(methods or default_methods())
    holdout = Holdout(rows)
    held = settle(holdout.read())
    pairs = F.array(*[F.struct(F.lit(n).alias("method"), c.cast("double").alias("value")) for n, c in methods.items()])
    long = settle(held.select("ord", "y", F.explode(pairs).alias("m")).select("ord", "y", "m.*"))
    bundle = ranking.metric_bundle(long, ["method"], k, "value")
    spread = paired_spread(held.select("ord", "y", *[c.cast("double").alias(f"m{k}") for k, c in enumerate(methods.values())]), {m: f"m{k}" for k, m in enumerate(methods)}, replicates, seed)
    out = bundle.join(spread, "method").withColumn("state", ranking.interval_state(F.col("lower"), F.col("upper")))
    numbers = [rounded(c).alias(c) for c in ("precision", "recall", "rr", "auprc", "lower", "upper")]
    return out.select("method", *numbers, "valid", "state", F.lit(holdout.accesses).alias("holdout_accesses"))


#: The scalar methods' columns, by the context whose values they take.
SCALARS = {
    REFERENCE: "publication_count_pre_cutoff", "mean_expression": "mean_expression_{}", "differential_expression": "differential_expression_{}",
    "cell_type_specificity": "cell_type_specificity_{}", "network_centrality": "network_centrality", "druggable_class": "druggable_class",
}
GRID = (0.1, 1.0, 10.0)
WIDE_GRID = tuple(float(c) for c in np.logspace(-4, 3, 12))
TRANSFERS = ("supervised_ood_transfer", "random_mlp_small_ood_transfer")


def feature_columns(context: str, popularity: bool = True) -> list[str]:
    names = [c.format(context) for m, c in SCALARS.items() if m != REFERENCE]
    return [*names, SCALARS[REFERENCE]] if popularity else names


@dataclass
class Frozen:
    """Scores of all methods before the holdout's labels are read: (ord, method, score, p), and how they came about."""

    rows: DataFrame
    scores: DataFrame
    chosen: dict[str, str]
    efforts: dict[str, Effort]
    parameters: dict[str, int]


def _tuned_scalars(rows: DataFrame, context: str) -> tuple[DataFrame, dict[str, str]]:
    """ord, method, score under each scalar's best transformation, and its name; the first wins on ties."""
    named = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c.format(context)).cast("double").alias("identity")) for m, c in SCALARS.items()])
    long = settle(rows.select("ord", "is_train", F.col("label_pre_cutoff").alias("y"), F.explode(named).alias("m")).select("ord", "is_train", "y", "m.*"))
    q = long.where("is_train").groupBy("method").agg(F.percentile("identity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    long = ranking.percentile_rank(long, ["method"], "identity").join(F.broadcast(q), "method")
    long = long.withColumn("robust_z", robust_z(F.col("identity"), *[F.col("q")[i] for i in range(3)])).drop("q")
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("configuration"), F.col(k).alias("score")) for i, k in enumerate(("identity", "percentile_rank", "robust_z"))])
    tried = settle(long.select("ord", "method", "is_train", "y", F.explode(kinds).alias("k")).select("ord", "method", "is_train", "y", "k.*"))
    got = ranking.average_precision(tried.where("NOT is_train"), ["method", "i", "configuration"])
    best = got.groupBy("method").agg(F.max_by("configuration", F.struct("auprc", -F.col("i"))).alias("configuration"))
    chosen = {r["method"]: r["configuration"] for r in best.collect()}  # a row for each scalar
    return tried.join(F.broadcast(best), ["method", "configuration"]).select("ord", "method", "score"), chosen


def freeze(frame: DataFrame, seed: int = 20260729) -> Frozen:
    """Tune on historical labels, refit on all of them, score everything; labels after the cutoff aren't looked at."""
    id_columns, ood_columns = feature_columns("id"), feature_columns("ood")
    rows = sampling.stratified_split(frame.withColumn("ord", F.col("gene_id")), "ord", "label_pre_cutoff", seed)
    efforts: dict[str, Effort] = {}
    with Effort(3) as effort:
        rows = settle(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "ord"))  # all that follows works in its parts, wide rows and models
        scalars, chosen = _tuned_scalars(rows, "id")
    efforts |= {m: effort for m in SCALARS}

    nets = [(size, heads.random_mlp(len(id_columns), size, seed + k), seed + k) for size in heads.MLP_SIZES for k in range(3)]
    scaler = heads.fit_scaler(rows.where("is_train"), id_columns)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(heads.dense(x, len(id_columns)) - scaler.mean) / scaler.scale for x in batch.columns[-2:]]
            hidden = [heads.lists(np.concatenate([net.applied(x) for _, net, _ in nets], axis=1)) for x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *hidden], names=[*batch.schema.names[:-2], "hidden", "shifted"])

    with Effort() as effort:
        kept = rows.select("ord", "is_train", "label_pre_cutoff", *dict.fromkeys([*id_columns, *ood_columns]))
        shape = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "hidden array<double>, shifted array<double>"])
        embedded = kept.select("*", heads.vectors(id_columns).alias("a"), heads.vectors(ood_columns).alias("b")).mapInArrow(embed, shape)
        width = sum(net.second.shape[1] for _, net, _ in nets)
        wide, hidden = heads.unpack(embedded, "hidden", width, "h")
        wide = settle(wide.drop("hidden"))
        names = [*id_columns, *hidden]
        first, at = {}, len(id_columns)
        for size, net, own in nets:
            first[size, own] = tuple(range(at, at + net.second.shape[1]))
            at += net.second.shape[1]
        full, bare = tuple(range(len(id_columns))), tuple(range(len(id_columns) - 1))
        tries = [("supervised_with_popularity", full, c, f"C={c:g}") for c in GRID] + [("supervised_without_popularity", bare, c, f"C={c:g}") for c in GRID]
        tries += [("supervised_unmatched_compute", full, c, f"C={c:g}") for c in WIDE_GRID] + [(f"random_mlp_{size}", cols, 1.0, f"seed={own}") for (size, own), cols in first.items()]
        models = heads.fit_models(wide.where("is_train"), names, "label_pre_cutoff", [(cols, c) for _, cols, c, _ in tries])
        judged = F.array(*[F.struct(F.lit(i).alias("i"), model.predict([names[k] for k in tries[i][1]]).alias("score")) for i, model in enumerate(models)])
        held = wide.where("NOT is_train").select(F.col("label_pre_cutoff").alias("y"), F.explode(judged).alias("m")).select("y", "m.*")
        got = {r["i"]: r["auprc"] for r in ranking.average_precision(held, ["i"]).collect()}  # a row for each configuration
        best: dict[str, int] = {}
        for i, (method, *_) in enumerate(tries):
            if method not in best or got.get(i, -1.0) > got.get(best[method], -1.0):
                best[method] = i
        chosen |= {m: tries[i][3] for m, i in best.items()}
        final = dict(zip(best, heads.fit_models(wide, names, "label_pre_cutoff", [tries[i][1:3] for i in best.values()]), strict=True))
    for method in best:
        efforts[method] = Effort(sum(t[0] == method for t in tries), effort.wall_seconds, effort.cpu_seconds)

    with Effort(3) as effort:
        seeds = [seed, seed + 1, seed + 2]
        got = {r["seed"]: r["auprc"] for r in heads.random_ranking(rows.where("NOT is_train"), "ord", "label_pre_cutoff", seeds).collect()}
        luck = max(seeds, key=lambda x: (got.get(x, -1.0), -x))
    efforts["random_ranking"], chosen["random_ranking"] = effort, f"seed={luck}"

    columns = {m: model.predict([names[k] for k in tries[best[m]][1]]) for m, model in final.items()}
    columns["supervised_ood_transfer"] = final["supervised_with_popularity"].predict(ood_columns)
    small = tries[best["random_mlp_small"]][1]
    columns["random_mlp_small_ood_transfer"] = final["random_mlp_small"].predict([f"shifted[{k - len(id_columns)}]" for k in small], quote=False)
    for transfer, origin in zip(TRANSFERS, ("supervised_with_popularity", "random_mlp_small"), strict=True):
        efforts[transfer], chosen[transfer] = efforts[origin], chosen[origin]
    fitted = F.array(*[F.struct(F.lit(m).alias("method"), c.alias("score")) for m, c in columns.items()])
    probable = wide.select("ord", F.explode(fitted).alias("m")).select("ord", "m.*").withColumn("p", F.col("score"))
    chance = rows.select("ord", F.lit("random_ranking").alias("method"), uniform(F.col("ord"), luck).alias("score"))
    scores = scalars.unionByName(chance).withColumn("p", F.lit(None).cast("double")).unionByName(probable)
    sizes = {f"random_mlp_{size}": net.parameters for size, net, _ in nets}
    return Frozen(rows, settle(scores), chosen, efforts, sizes)


def evaluate(frozen: Frozen, k: int = 20, replicates: int = 400, seed: int = 20260729) -> DataFrame:
    """One row for each frozen method on the at-risk rows, whose later labels are read once.

    method, precision, recall, rr, auprc, ece (where there are probabilities),
    excess with the interval of paired replicates and its state, configurations
    tried and chosen, excess per configuration, size of the evaluation.
    """
    at_risk = sampling.at_risk(F.col("label_pre_cutoff"), F.col("entry_year"), F.col("label_post_cutoff"))
    holdout = Holdout(frozen.rows.where(at_risk).select("ord", F.col("label_post_cutoff").alias("y")))
    held = settle(holdout.read())
    n, positives = held.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not positives:
        raise ValueError("no positive among the rows at risk")
    long = settle(frozen.scores.join(held, "ord"))
    bundle = ranking.metric_bundle(long, ["method"], k).join(ranking.calibration_error(long.where("p IS NOT NULL"), ["method"]), "method", "left")
    wide = long.groupBy("ord", "y").agg(*[F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"m{k}") for k, m in enumerate(frozen.efforts)])
    spread = paired_spread(wide, {m: f"m{k}" for k, m in enumerate(frozen.efforts)}, replicates, seed)
    tried = frozen.rows.sparkSession.createDataFrame([(m, e.configurations, frozen.chosen[m]) for m, e in frozen.efforts.items()], "method string, configurations int, chosen string")
    popular = bundle.where(F.col("method") == REFERENCE).select(F.col("auprc").alias("base"))
    out = bundle.join(spread, "method").join(F.broadcast(tried), "method").crossJoin(F.broadcast(popular)).withColumn("excess", F.col("auprc") - F.col("base"))
    out = out.withColumns({"state": ranking.interval_state(F.col("lower"), F.col("upper")), "excess_per_configuration": ranking.per_effort(F.col("excess"), F.col("configurations"))})
    numbers = [rounded(c).alias(c) for c in ("precision", "recall", "rr", "auprc", "ece", "excess", "lower", "upper", "excess_per_configuration")]
    return out.select("method", *numbers, "valid", "state", "configurations", "chosen", F.lit(n).alias("n"), F.lit(positives).alias("positives"), F.lit(holdout.accesses).alias("holdout_accesses"))


def leaky_split(frame: DataFrame, seed: int = 20260729) -> dict[str, float]:
    """The intentionally leaky ablation: a random split of final labels, with all-time publication counts."""
    label = F.greatest("label_pre_cutoff", "label_post_cutoff")
    names = [*feature_columns("id", popularity=False), "publication_count_all_time"]
    cores = frame.sparkSession.sparkContext.defaultParallelism
    rows = sampling.stratified_split(frame.select(F.col("gene_id").alias("ord"), label.alias("y"), *names), "ord", "y", seed)
    rows = settle(rows.repartition(cores, "ord"))
    inner = sampling.stratified_split(rows.where("is_train").drop("is_train"), "ord", "y", seed + 1)
    c, model = heads.supervised(settle(inner.repartition(cores, "ord")), names, "y", F.col("is_train"), GRID)
    tested = rows.where("NOT is_train").withColumn("score", model.predict(names))
    value = lambda column: ranking.average_precision(tested, [], column).first()["auprc"]
    return {"supervised": value("score"), "popularity": value("publication_count_all_time"), "prevalence": tested.agg(F.avg("y")).first()[0], "c": c}


def ablations(results: dict[str, dict], leaky: dict[str, float], parameters: dict[str, int]) -> list[tuple[str, str, str, float | None]]:
    """(ablation, status, figure, value): seven comparisons; what would need a checkpoint stays NOT_COMPUTED."""
    ap = {m: r["auprc"] for m, r in results.items()}
    tried = {m: float(r["configurations"]) for m, r in results.items()}
    with_, mlp = "supervised_with_popularity", "random_mlp_small"
    figures = {
        ("temporal_vs_random", "EXECUTED_INTENTIONALLY_LEAKY"): {"temporal_auprc": ap[with_], "random_split_auprc": leaky["supervised"], "random_split_popularity_auprc": leaky["popularity"]},
        ("with_vs_without_popularity", "EXECUTED"): {"with_auprc": ap[with_], "without_auprc": ap["supervised_without_popularity"]},
        ("pretrained_vs_random_initialisation", "NOT_COMPUTED"): {"random_control_auprc": ap[mlp]},
        ("frozen_vs_finetuned", "NOT_COMPUTED"): {"auprc": None},
        ("id_vs_ood", "EXECUTED_SYNTHETIC"): {"supervised_delta": ap[TRANSFERS[0]] - ap[with_], "random_mlp_delta": ap[TRANSFERS[1]] - ap[mlp]},
        ("matched_vs_unmatched_compute", "EXECUTED"): {"matched_auprc": ap[with_], "unmatched_auprc": ap["supervised_unmatched_compute"], "matched_configurations": tried[with_], "unmatched_configurations": tried["supervised_unmatched_compute"]},
        ("model_scale", "EXECUTED_RANDOM_CONTROL_ONLY"): {"small_auprc": ap[mlp], "large_auprc": ap["random_mlp_large"], "small_parameters": float(parameters[mlp]), "large_parameters": float(parameters["random_mlp_large"])},
    }
    return [(name, status, figure, value) for (name, status), held in figures.items() for figure, value in held.items()]


def predictions(results: dict[str, dict], leaky: dict[str, float]) -> list[tuple[str, str, float | None]]:
    """(prediction, HELD / FAILED / NOT_TESTED, observed value) of what was registered beforehand."""
    own = {m: r for m, r in results.items() if m != REFERENCE and m not in TRANSFERS}
    popular = results[REFERENCE]
    prevalence = popular["positives"] / popular["n"]
    no_gain = sum(r["state"] != "DETECTABLE_GAIN" for r in own.values())
    largest = max(abs(r["excess"]) for r in own.values())
    gap = leaky["supervised"] - results["supervised_with_popularity"]["auprc"]
    told = lambda yes: "HELD" if yes else "FAILED"
    return [
        ("popularity_will_be_strong", told(popular["auprc"] >= 1.1 * prevalence and no_gain >= 3), popular["auprc"]),
        ("excess_over_popularity_will_be_small", told(largest < 0.2), largest),
        ("random_initialisation_recovers_pretrained_share", "NOT_TESTED", None),
        ("temporal_scores_lower_than_random", told(gap >= 0.05), gap),
    ]


def diagnostics(frozen: Frozen, results: dict[str, dict]) -> list[tuple[str, bool]]:
    """(check, passed) on a table with planted groups: does the harness see what was planted?"""
    at_risk = sampling.at_risk(F.col("label_pre_cutoff"), F.col("entry_year"), F.col("label_post_cutoff"))
    popular = frozen.scores.where(F.col("method") == REFERENCE).select("ord", "score")
    rows = frozen.rows.where(at_risk).join(popular, "ord")
    first = ranking.top(rows, [], max(20, round(0.05 * results[REFERENCE]["n"])))
    share = lambda df: df.agg(F.avg((F.col("planted_group") == "popularity_only").cast("double"))).first()[0]
    checks = [
        ("biology_method_beats_random", results["differential_expression"]["auprc"] > results["random_ranking"]["auprc"]),
        ("popularity_only_overrepresented", share(first) > share(frozen.rows)),
        ("supervised_excess_over_popularity_positive", results["supervised_with_popularity"]["excess"] > 0),
    ]
    return [*checks, ("harness_validation_passed", all(ok for _, ok in checks))]


def claims(results: DataFrame) -> dict[str, list[str]]:
    """What the results permit to be said; one row per method reaches the driver."""
    out: dict[str, list[str]] = {"permitted": [], "conditional": [], "unsupported": []}
    for row in results.orderBy("method").collect():
        if row["method"] == REFERENCE:
            continue
        if row["state"] == "DETECTABLE_GAIN":
            out["permitted"].append(f"{row['method']} ranks better than {REFERENCE} on this holdout")
        elif row["state"] == "NO_DETECTABLE_DIFFERENCE":
            out["conditional"].append(f"{row['method']} is not told apart from {REFERENCE} on this holdout")
        else:
            out["unsupported"].append(f"{row['method']} adds ranking value over {REFERENCE}")
    out["unsupported"].append("any statement about causes, treatment or other holdouts")
    return out
