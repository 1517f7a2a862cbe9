"""Model heads from aggregated moments.

Ridge, logistic regression and PCA only need d x d sums of the rows.  Tasks add
them up over Arrow batches, a few tasks add the tasks' sums, and what reaches the
driver has a size set by the number of features, not of rows.  The small systems
are solved there, and predictions are column expressions again.  Rows with a null
feature, label or target are not fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalar import prefix_fold, robust_z, uniform
from rankforge.operators.ranking import average_precision, percentile_rank, spearman


class Scaler(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray

    def columns(self, features: Sequence[str]) -> list[Column]:
        return [(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, self.mean, self.scale, strict=True)]


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """Population mean and deviation; a constant column is only centred."""
    row = df.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    values = np.array([0.0 if v is None else v for v in row], dtype=float)
    scale = values[len(features) :]
    return Scaler(values[: len(features)], np.where(scale > 0, scale, 1.0))


#: Tasks that add up the sums of all others.
ADDERS = 8


def array_sums(df: DataFrame, parts: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """key -> sum of the arrays that `parts` makes of every batch."""

    def added(pairs: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for key, part in pairs:
            total[key] = total[key] + part if key in total else part
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["key", "sums"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(pair for batch in batches for pair in parts(batch))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added((k.as_py(), v.values.to_numpy()) for batch in batches for k, v in zip(*batch.columns, strict=True))

    shape = "key int, sums array<double>"
    out: dict[int, np.ndarray] = {}
    for row in df.mapInArrow(rows, shape).repartition(ADDERS).mapInArrow(sums, shape).collect():  # ADDERS rows for each key at most
        out[row["key"]] = out.get(row["key"], 0.0) + np.array(row["sums"])
    return out


def dense(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), rows.ravel())


def vectors(columns: Sequence[Column | str]) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def _whole(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull())


def spreads(df: DataFrame, columns: Sequence[str]) -> tuple[Scaler, int, np.ndarray]:
    """What `fit_scaler` gives, the number of rows and the columns' sums, in one pass of tasks' sums; nulls don't count.

    Values are taken less those of one whole row: a constant column's are exactly 0,
    and as the row is one of those summed, a square of its distance from the mean is
    never above n variances.
    """
    d = len(columns)
    rows = df.select(vectors(columns).alias("x"))
    first = rows.where(_whole("x")).first()
    origin = np.zeros(d) if first is None else np.array(first["x"])

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        flat = batch.column(0).flatten()
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, d) - origin
        n = np.full(d, float(len(x)))
        if flat.null_count:
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d)
            x, n = np.where(null, 0.0, x), n - null.sum(0)
        yield 0, np.concatenate([[len(x)], n, x.sum(0), np.einsum("nd,nd->d", x, x)])

    count, *sums = array_sums(rows, parts).get(0, np.zeros(3 * d + 1))
    n, total, squares = np.array(sums).reshape(3, d)
    mean = np.divide(total, n, out=np.zeros(d), where=n > 0)
    scale = np.sqrt(np.maximum(np.divide(squares, n, out=np.zeros(d), where=n > 0) - mean**2, 0.0))
    return Scaler(np.where(n > 0, origin + mean, 0.0), np.where(scale > 0, scale, 1.0)), int(count), total + n * origin


def moments(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Symmetric matrix of weighted sums of products of the columns."""
    d = len(columns)
    rows = df.select(vectors([*columns, F.lit(1.0) if weight is None else weight]).alias("x")).where(_whole("x"))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = dense(batch.column(0), d + 1)
        yield 0, (x[:, :d].T @ (x[:, :d] * x[:, d:])).ravel()

    return array_sums(rows, parts).get(0, np.zeros(d * d)).reshape(d, d)


def linear(columns: Sequence[Column], coefficients: np.ndarray, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(columns, coefficients, strict=True):
        out = out + c * F.lit(float(b))
    return out


class Ridge(NamedTuple):
    scaler: Scaler
    coefficients: np.ndarray
    intercept: float

    def predict(self, features: Sequence[str]) -> Column:
        return linear(self.scaler.columns(features), self.coefficients, self.intercept)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float) -> Ridge:
    """min |y - Xb - a|^2 + alpha |b|^2 on standardised features, the intercept free."""
    scaler = fit_scaler(df, features)
    full = moments(df, [*scaler.columns(features), F.lit(1.0), F.col(target).cast("double")])
    d = len(features)
    penalty = np.diag([alpha] * d + [1e-12])
    solved = np.linalg.solve(full[: d + 1, : d + 1] + penalty, full[: d + 1, d + 1])
    return Ridge(scaler, solved[:d], float(solved[d]))


def _number(v: float) -> str:
    return f"{float(v)!r}D" if np.isfinite(v) else f"double('{float(v)!r}')"


def numbers(values: Sequence[float]) -> str:
    """An array literal in SQL: generated code refers to it, so new numbers need no new code."""
    return "array(" + ", ".join(map(_number, values)) + ")"


def dot(columns: Sequence[str], beta: str) -> str:
    """SQL of the weighted sum of the columns plus the last element of `beta`.

    As text, because a plan of hundreds of column objects takes longer to build
    than to run.
    """
    return " + ".join([f"get({beta}, {len(columns)})"] + [f"cast({c} as double) * get({beta}, {i})" for i, c in enumerate(columns)])


def quoted(features: Sequence[str]) -> list[str]:
    return ["`" + f.replace("`", "``") + "`" for f in features]


def ridge_from_sums(full: np.ndarray, center: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and intercept on raw features of the ridge that `fit_ridge` makes.

    `full` holds the sums of products of the features, 1 and the target, the
    features less `center`.
    """
    d = len(center)
    n = full[d, d]
    if n == 0:
        return np.zeros(d + 1)
    mean, target = full[:d, d] / n, full[d, d + 1] / n
    covariance = full[:d, :d] / n - np.outer(mean, mean)
    spread = np.diag(covariance)
    scale = np.where(spread > 1e-12 * np.diag(full)[:d] / n, np.sqrt(np.maximum(spread, 0.0)), 1.0)
    scale = np.where(scale > 0, scale, 1.0)
    beta = np.linalg.solve(covariance / np.outer(scale, scale) * n + alpha * np.eye(d), (full[:d, d + 1] / n - mean * target) / scale * n) / scale
    return np.append(beta, target - beta @ (center + mean))


def ridge_by_folds(df: DataFrame, features: Sequence[str], target: str, key: str, alphas: Sequence[float], folds: int) -> tuple[float, DataFrame]:
    """(best alpha, ord, prediction, target): out-of-fold Spearman picks alpha, ties the smaller one.

    The sums of every fold come from one pass; a fit is the total less its own
    fold.  All alphas are judged in one job.  Rows with a null feature or target
    are not fitted; without a feature a row's prediction is null.
    """
    alphas, d = sorted(alphas), len(features)
    inputs = [F.col(c) for c in quoted([*features, target])]
    rows = df.select("ord", prefix_fold(F.col(key), folds).alias("fold"), vectors(inputs).alias("x")).cache()
    try:
        whole = rows.where(_whole("x"))

        def total(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            x = dense(batch.column(2), d + 1)
            yield 0, np.append(x[:, :d].sum(0), len(x))

        of_all = array_sums(whole, total).get(0, np.zeros(d + 1))
        center = of_all[:d] / max(of_all[d], 1.0)

        def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            fold, x = batch.column(1).to_numpy(), dense(batch.column(2), d + 1)
            full = np.column_stack([x[:, :d] - center, np.ones(len(x)), x[:, d]])
            for k in np.unique(fold):
                yield int(k), (full[fold == k].T @ full[fold == k]).ravel()

        sums = {k: v.reshape(d + 2, d + 2) for k, v in array_sums(whole, products).items()}
        every = sum(sums.values(), np.zeros((d + 2, d + 2)))
        made = np.array([[ridge_from_sums(every - sums.get(fold, 0.0), center, alpha) for fold in range(folds)] for alpha in alphas])

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, beta = dense(batch.column(2), d + 1), made[:, batch.column(1).to_numpy()]
                out = np.einsum("and,nd->an", beta[:, :, :d], x[:, :d]) + beta[:, :, d]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(alphas)), len(x)), pa.int32()), pa.array(out.ravel()), pa.array(np.tile(x[:, d], len(alphas)))], names=["i", "prediction", "target"])

        score = {r["i"]: r["spearman"] for r in spearman(whole.mapInArrow(judged, "i int, prediction double, target double"), ["i"], "prediction", "target").collect() if r["spearman"] is not None}
        best = max(range(len(alphas)), key=lambda i: (score.get(i, -np.inf), -alphas[i]))

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, beta = dense(batch.column(2), d + 1), made[best][batch.column(1).to_numpy()]  # a null is NaN here
                out = (x[:, :d] * beta[:, :d]).sum(1) + beta[:, d]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, from_pandas=True), pa.array(x[:, d], from_pandas=True)], names=["ord", "prediction", "target"])

        kind = rows.schema["ord"].dataType.simpleString()
        return alphas[best], rows.mapInArrow(predicted, f"ord {kind}, prediction double, target double")
    finally:
        rows.unpersist()


class Logistic(NamedTuple):
    scaler: Scaler
    coefficients: np.ndarray
    intercept: float

    def predict(self, features: Sequence[str], quote: bool = True) -> Column:
        """The probability from columns, or from SQL expressions without `quote`."""
        raw = self.coefficients / self.scaler.scale
        return F.expr(f"1.0D / (1.0D + exp(-({dot(quoted(features) if quote else features, numbers([*raw, self.intercept - raw @ self.scaler.mean]))})))")


def fit_models(df: DataFrame, features: Sequence[str], label: str, specs: Sequence[tuple[Sequence[int], float]], rounds: int = 25) -> list[Logistic]:
    """Class-balanced L2 logistic regressions, one for each (places of its features, C).

    Newton steps on sums over the rows, those of all models in one job a step;
    the intercept is penalised like the rest.
    """
    d = len(features)
    of_all, n, sums = spreads(df, [*features, label])
    scaler, positives = Scaler(of_all.mean[:d], of_all.scale[:d]), sums[d]
    if not positives or positives == n:
        raise ValueError("both classes are needed")
    balance = np.array([n / (2.0 * (n - positives)), n / (2.0 * positives)])
    places = [np.append(np.asarray(at, dtype=int), d) for at, _ in specs]  # the intercept comes last
    betas, todo = [np.zeros(len(at)) for at in places], list(range(len(specs)))
    rows = df.select(vectors([*features, label]).alias("x")).where(_whole("x"))

    for _ in range(rounds):

        def parts(batch: pa.RecordBatch, now: list = betas, live: list = todo) -> Iterator[tuple[int, np.ndarray]]:
            x = dense(batch.column(0), d + 1)
            y = x[:, d]
            full = np.column_stack([(x[:, :d] - scaler.mean) / scaler.scale, np.ones(len(x))])
            w = balance[(y == 1).astype(int)]
            for m in live:
                own = full[:, places[m]]
                p = 1.0 / (1.0 + np.exp(-np.clip(own @ now[m], -700, 700)))
                hessian = own.T @ (own * (np.maximum(p * (1 - p), 1e-12) * w)[:, None])
                yield m, np.concatenate([hessian.ravel(), own.T @ ((y - p) * w)])

        sums, left = array_sums(rows, parts), []
        for m in todo:
            k, c = len(places[m]), specs[m][1]
            step = np.linalg.solve(c * sums[m][: k * k].reshape(k, k) + np.eye(k), c * sums[m][k * k :] - betas[m])
            betas[m] = betas[m] + step
            if np.abs(step).max() >= 1e-9:
                left.append(m)
        todo = left
        if not todo:
            break
    return [Logistic(Scaler(scaler.mean[at[:-1]], scaler.scale[at[:-1]]), b[:-1], float(b[-1])) for at, b in zip(places, betas, strict=True)]


def fit_logistics(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[float], rounds: int = 25) -> list[Logistic]:
    """`fit_models` for all features and each C of the grid."""
    return fit_models(df, features, label, [(range(len(features)), c) for c in grid], rounds)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, c: float, rounds: int = 25) -> Logistic:
    return fit_logistics(df, features, label, [c], rounds)[0]


def scored_by(models: Sequence[Logistic], df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`df` once for each model, with its number m and its score."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), model.predict(features).alias("score")) for m, model in enumerate(models)])).alias("model")
    return df.select("*", each).select("*", "model.*").drop("model")


def supervised(df: DataFrame, features: Sequence[str], label: str, train: Column, grid: Sequence[float] = (0.1, 1.0, 10.0)) -> tuple[float, Logistic]:
    """C by average precision on the rows outside `train` (the first wins on ties), refitted on all rows."""
    rows = df.cache()
    try:
        models = fit_logistics(rows.where(train), features, label, grid)
        held = scored_by(models, rows.where(~train).withColumn("y", F.col(label)), features)
        got = {r["m"]: r["auprc"] for r in average_precision(held, ["m"]).collect()}
        best = grid[max(range(len(grid)), key=lambda m: (got.get(m, -1.0), -m))]
        return best, fit_logistic(rows, features, label, best)
    finally:
        rows.unpersist()


def scalar_candidates(df: DataFrame, value: str, train: Column) -> DataFrame:
    """Adds identity, percentile_rank and robust_z of one column; the last from the rows in `train`."""
    spread = df.where(train).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    low, middle, high = (F.lit(float(v)) for v in spread)
    ranked = percentile_rank(df, [], value)
    return ranked.withColumn("identity", F.col(value).cast("double")).withColumn("robust_z", robust_z(F.col("identity"), low, middle, high))


def tune_scalar(df: DataFrame, value: str, label: str, train: Column) -> str:
    """The candidate of best average precision outside `train`; the first wins on ties."""
    scored = scalar_candidates(df, value, train).where(~train).withColumn("y", F.col(label))
    best = (-1.0, "identity")
    for name in ("identity", "percentile_rank", "robust_z"):
        got = average_precision(scored, [], name).first()
        if got is not None and round(got["auprc"], 12) > best[0]:  # sums in another order are no better
            best = (round(got["auprc"], 12), name)
    return best[1]


def random_ranking(df: DataFrame, key: str, label: str, seeds: Sequence[int]) -> DataFrame:
    """seed, auprc of hash-uniform scores, the control for ranking by chance."""
    parts = [average_precision(df.select(F.col(label).alias("y"), uniform(F.col(key).cast("string"), s).alias("score")), []).withColumn("seed", F.lit(s)) for s in seeds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("seed", "auprc")


class RandomMlp(NamedTuple):
    """Two random tanh layers; a control for what width alone gives."""

    first: np.ndarray
    second: np.ndarray

    @property
    def parameters(self) -> int:
        return self.first.size + self.second.size

    def columns(self, inputs: Sequence[Column]) -> list[Column]:
        layer = lambda xs, w: [F.tanh(linear(xs, w[:-1, j], w[-1, j])) for j in range(w.shape[1])]
        return layer(layer(inputs, self.first), self.second)

    def applied(self, x: np.ndarray) -> np.ndarray:
        """The second layer of standardised rows."""
        return np.tanh(np.tanh(x @ self.first[:-1] + self.first[-1]) @ self.second[:-1] + self.second[-1])


#: Layer widths of the two sizes.
MLP_SIZES = {"small": (16, 8), "large": (64, 32)}


def random_mlp(inputs: int, size: str = "small", seed: int = 0) -> RandomMlp:
    rng = np.random.default_rng(seed)
    wide, out = MLP_SIZES[size]
    made = lambda a, b: np.vstack([rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros((1, b))])
    return RandomMlp(made(inputs, wide), made(wide, out))


class Pca(NamedTuple):
    scaler: Scaler
    components: np.ndarray
    explained: np.ndarray

    def columns(self, features: Sequence[str]) -> list[Column]:
        return [linear(self.scaler.columns(features), v, 0.0) for v in self.components]

    def project(self, rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
        """key and the array of the axes' values for a column of vectors without nulls, in Arrow batches: code doesn't grow with the width."""
        kind = rows.schema[key].dataType.simpleString()

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = ((dense(batch.column(1), len(self.scaler.mean)) - self.scaler.mean) / self.scaler.scale) @ self.components.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, name])

        return rows.select(key, F.col(vector).cast("array<double>")).mapInArrow(made, f"{key} {kind}, {name} array<double>")


def fit_pca(df: DataFrame, features: Sequence[str], k: int) -> Pca:
    """Principal axes of the standardised features, from their d x d moments; signs make the largest loading positive."""
    scaler = fit_scaler(df, features)
    full = moments(df, [*scaler.columns(features), F.lit(1.0)])
    n = full[-1, -1]
    covariance = full[:-1, :-1] / max(n, 1.0)
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value)[: max(1, min(k, len(features), int(n) - 1))]
    axes = vector[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Pca(scaler, axes, value[order] / max(value.sum(), 1e-300))


#: Columns that a random range has beyond the axes asked for, factors that one task joins.
SPARE, TOGETHER = 64, 32


def fit_wide_pca(df: DataFrame, vector: str, k: int, seed: int = 3, spare: int = SPARE) -> Pca:
    """The first axes of standardised vectors of any width, without a matrix of width x width anywhere.

    A randomised range finder in two passes: the vectors times some random columns,
    orthogonalised by factors R of tasks' rows that are joined in a tree; then that
    basis times the vectors, as sums of tasks.  What the driver sees is (k + spare)
    x width.  Exact where that many columns span the vectors, as up to a width of
    k + spare; beyond, as good as the spectrum falls behind them.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & _whole("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1

    def first(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = dense(batch.column(0), width)
        yield 0, np.concatenate([[len(x)], x.sum(0)])

    def second(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, ((dense(batch.column(0), width) - mean) ** 2).sum(0)

    n, *total = array_sums(rows, first).get(0, np.zeros(width + 1))
    mean = np.array(total) / max(n, 1.0)
    scale = np.sqrt(array_sums(rows, second).get(0, np.zeros(width)) / max(n, 1.0))
    scaler = Scaler(mean, np.where(scale > 0, scale, 1.0))
    size = int(max(1, min(k + spare, width, n)))
    directions = np.random.default_rng(seed).normal(size=(width, size)) if size < width else np.eye(width)

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, size))
        for batch in batches:
            made = (dense(batch.column(0), width) - scaler.mean) / scaler.scale @ directions
            held = np.linalg.qr(np.concatenate([held, made]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, size))
        for batch in batches:
            held = np.linalg.qr(np.concatenate([held, dense(batch.column(0), 1).reshape(-1, size)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    factors, tasks = rows.mapInArrow(triangles, "r array<double>"), rows.rdd.getNumPartitions()
    while tasks > TOGETHER:
        tasks = -(-tasks // TOGETHER)
        factors = factors.repartition(tasks).mapInArrow(joined, "r array<double>")
    held = np.concatenate([np.zeros((0, size)), *(np.array(r["r"]).reshape(-1, size) for r in factors.collect())])  # TOGETHER rows at most
    triangle = np.linalg.qr(held, mode="r")
    # directions that the vectors don't have give columns of zeros
    u, s, vt = np.linalg.svd(triangle, full_matrices=False)
    kept = s > 1e-10 * max(s.max(initial=0.0), 1e-300)
    basis = directions @ (vt[kept].T / s[kept])  # the vectors times this are orthonormal columns

    def projected(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = (dense(batch.column(0), width) - scaler.mean) / scaler.scale
        yield 0, ((x @ basis).T @ x).ravel()

    small = array_sums(rows, projected).get(0, np.zeros(kept.sum() * width)).reshape(-1, width)
    _, value, axes = np.linalg.svd(small, full_matrices=False)
    axes = axes[: max(1, min(k, width, int(n) - 1))]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Pca(scaler, axes, value[: len(axes)] ** 2 / max(n * float((scale > 0).sum()), 1e-300))


def unpack(df: DataFrame, vector: str, width: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{i}" for i in range(width)]
    return df.withColumns({name: F.col(vector)[i].cast("double") for i, name in enumerate(names)}), names
