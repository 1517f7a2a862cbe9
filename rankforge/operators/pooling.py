"""Vector pooling, tokenisers and geometry on array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """by, vector, n: element-wise mean, summed in double; one aggregation row per (group, element)."""
    parts = df.select(*by, F.posexplode(vector).alias("i", "x"), *([] if weight is None else [weight.alias("__w")]))
    mean = F.avg(F.col("x").cast("double")) if weight is None else F.sum(F.col("x").cast("double") * F.col("__w")) / F.sum("__w")
    per = parts.groupBy(*by, "i").agg(mean.alias("x"), F.count(F.lit(1)).alias("n"))
    packed = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("n"))
    return packed.select(*by, F.transform("v", lambda e: e["x"]).alias("vector"), "n")


def balanced_pool(tokens: DataFrame, entity: str, sample: str, context: Sequence[str], cell: str, vector: str = "embedding") -> DataFrame:
    """entity, context, vector, n_cells, n_samples: mean within each sample, then an equal-weight mean over samples."""
    level = [entity, *context, sample]
    first = mean_vectors(tokens, level, vector).withColumnRenamed("vector", "part").drop("n")
    cells = tokens.groupBy(*level).agg(F.count_distinct(cell).alias("cells"))
    pooled = mean_vectors(first, [entity, *context], "part").drop("n")
    counts = cells.groupBy(entity, *context).agg(F.sum("cells").alias("n_cells"), F.count(F.lit(1)).alias("n_samples"))
    return pooled.join(counts, [entity, *context])


def pool_by_view(df: DataFrame, entity: str, views: dict[str, Column], vector: str, width: int) -> DataFrame:
    """entity, view, vector, available: the mean over a view's rows, or zeros and 0."""
    named = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in views.items()]), lambda v: v.isNotNull())
    hits = df.withColumn("view", F.explode(named))
    pooled = mean_vectors(hits, [entity, "view"], vector)
    grid = df.select(entity).distinct().withColumn("view", F.explode(F.array(*map(F.lit, views))))
    zero = F.array_repeat(F.lit(0.0), width)
    return grid.join(pooled, [entity, "view"], "left").select(entity, "view", F.coalesce("vector", zero).alias("vector"), F.col("vector").isNotNull().cast("int").alias("available"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, e: s + e)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit_products(first: int, second: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over columns first and second: sums of products of (unit first, unit second, 1), by block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, d = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.array(batch.column(i).to_pylist(), dtype=np.float64) for i in (first, second))
            norms = [np.sqrt((x * x).sum(1)) for x in (u, v)]
            ok = (norms[0] > 0) & (norms[1] > 0) & np.isfinite(norms[0]) & np.isfinite(norms[1])
            rows = np.hstack([u[ok] / norms[0][ok, None], v[ok] / norms[1][ok, None], np.ones((ok.sum(), 1))])
            d, total = u.shape[1], rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            parts = {"xx": total[:d, :d], "yy": total[d:-1, d:-1], "xy": total[:d, d:-1], "x": total[:d, -1], "y": total[d:-1, -1], "n": total[-1:, -1]}
            for block, values in parts.items():
                flat = values.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["block", "at", "g"])

    return run


def geometry_correlation(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """pairs, correlation: Pearson of the cosines of all pairs of entities in two embeddings.

    One row per key.  Pairs aren't formed: with unit vectors u and v of the
    entities, the sum of x * y over all ordered pairs is the squared Frobenius
    norm of the sum of u v^T, likewise x^2, y^2 and, from the sums of u and v,
    x and y; an entity with itself adds 1 to each.  Pairs with a vector that is
    null, zero or not finite have no cosine and count in `pairs` only; one width
    per column.  The correlation is NULL where one side is constant.
    """
    rows = df.where(F.col(key).isNotNull()).select(first, second)
    usable = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull() & ~F.exists(first, lambda x: x.isNull()) & ~F.exists(second, lambda x: x.isNull()))
    sums = usable.mapInArrow(_unit_products(0, 1), "block string, at long, g double").groupBy("block", "at").agg(F.sum("g").alias("g"))
    norm = lambda block: F.sum(F.when(F.col("block") == block, F.col("g") * F.col("g")))
    n = F.max(F.when(F.col("block") == "n", F.col("g")))
    got = sums.agg(n.alias("n"), *[((norm(b) - n) / 2).alias(b) for b in ("xx", "yy", "xy", "x", "y")])
    m = F.col("n") * (F.col("n") - 1) / 2
    means = got.select(*[F.try_divide(b, m).alias(b) for b in ("xx", "yy", "xy", "x", "y")])
    spread = {b: F.col(2 * b) - F.col(b) * F.col(b) for b in ("x", "y")}
    varies = (spread["x"] > F.col("xx") * 1e-12) & (spread["y"] > F.col("yy") * 1e-12)
    correlation = F.when(varies, (F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread["x"] * spread["y"]))
    every = F.count(F.lit(1))
    return rows.agg(F.shiftright(every * (every - 1), 1).alias("pairs")).join(means.select(correlation.alias("correlation")))


def rank_tokens(counts: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """cell, tokens, genes: the `length` genes of largest count / total * 1e4 / median, best first.

    counts: cell, gene, ord, value over all genes; dictionary: gene, token,
    median.  The total is over all genes of the cell; ties keep gene order.  The
    counts are read once and move twice, by gene and by cell: totals, ranks and
    lists are all made where a cell lies.
    """
    known = dictionary.groupBy("gene").agg(F.collect_list(F.struct("token", "median")).alias("known"))  # a row for each gene, so that the join keeps the counts' rows
    total = F.sum("value").over(Window.partitionBy("cell")).cast("double")
    mapped = counts.join(known, "gene", "left").withColumn("total", total).where("value > 0 AND total > 0").select("cell", "ord", "value", "total", F.inline("known"))
    score = F.col("value") / F.col("total") * 10_000.0 / F.greatest(F.col("median"), F.lit(1e-12))
    order = Window.partitionBy("cell").orderBy(F.desc("score"), F.asc("ord"))
    ranked = mapped.withColumn("score", score).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= length)
    packed = ranked.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rn", "token", "ord"))).alias("t"))
    return packed.select("cell", F.transform("t", lambda e: e["token"]).alias("tokens"), F.transform("t", lambda e: e["ord"]).alias("genes"))


def binned_tokens(counts: DataFrame, vocabulary: DataFrame, length: int, bins: int, start_token: int) -> DataFrame:
    """cell, tokens, values: a start token, then genes by value, each with its quantile bin.

    counts: cell, gene, ord, value; vocabulary: gene, token.  The total is over
    mapped genes; a value's bin is 1 plus the number of edges below it.
    """
    mapped = counts.join(vocabulary, "gene")
    total = mapped.groupBy("cell").agg(F.sum("value").cast("double").alias("total"))
    scaled = mapped.where("value > 0").join(total, "cell").withColumn("x", F.log1p(F.col("value") / F.col("total") * 10_000.0))
    at = [i / (bins - 2) for i in range(bins - 1)]
    edges = scaled.groupBy("cell").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("edges"))
    order = Window.partitionBy("cell").orderBy(F.desc("x"), F.asc("ord"))
    ranked = scaled.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= length - 1).join(edges, "cell")
    ranked = ranked.withColumn("bin", (F.size(F.filter("edges", lambda e: e < F.col("x"))) + 1).cast("double"))
    packed = ranked.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rn", "token", "bin"))).alias("t"))
    full = counts.select("cell").distinct().join(packed, "cell", "left")
    tail = F.coalesce("t", F.array().cast("array<struct<rn:int,token:bigint,bin:double>>"))
    tokens = F.concat(F.array(F.lit(start_token).cast("long")), F.transform(tail, lambda e: e["token"]))
    return full.select("cell", tokens.alias("tokens"), F.concat(F.array(F.lit(0.0)), F.transform(tail, lambda e: e["bin"])).alias("values"))


def vector_health(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """n, bad (vectors with a value that isn't finite), widths, variance over all values."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.size(vector).alias("w"), F.coalesce(finite, F.lit(False)).alias("ok"), F.explode_outer(vector).alias("x"), F.monotonically_increasing_id().alias("r"))
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad"), F.count_distinct(F.size(vector)).alias("widths"))
    return shape.join(rows.where("ok").agg(F.var_pop(F.col("x").cast("double")).alias("variance")))
