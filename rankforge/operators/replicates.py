"""Metrics over exact bootstrap replicates, without a row for every replicate and row.

A replicate draws n rows with replacement, so its counts are multinomial.  They
come about in two steps that give exactly that: every row takes Poisson(rate)
draws, a hash of (replicate, row), with a rate so far below 1 that the sum stays
under n; what is lacking then, some 6 to 12 times the root of n, is drawn row by
row.  Given their sum, Poisson counts are multinomial, and so is what is added.
Counts are computed where a row is, any number of times; only the added draws
move, and one record for each (part of the rows, replicate).

A metric is an argument.  Rows lie in parts by falling score; a part counts
positives and rows drawn at each of its scores for all replicates at once, then
learns what other parts have before it and at scores it shares with them, and
gives its share of the metric, a sum or a maximum.  The finished value comes from
the merged shares and the replicate's totals.  A score that many rows share may
lie in any number of parts.

Null scores rank last, null labels count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.ranking import position
from rankforge.session import settle

#: Rows in a part, replicates that a part works on together.
ROWS, TOGETHER = 1 << 15, 32
#: Hashes made at a time, numbers of (replicate, row) that a part works on at a time.
CACHED, CELLS = 1 << 15, 1 << 17
#: Rows of a part at least while there are idle cores, added draws of a batch about.
FEW, ADDED = 512, 1 << 16
#: Rates are 1 - 2^-level; a level is used from LEAST * 4^level rows on, 6 standard deviations below n draws.
LEVELS, LEAST = 20, 36
#: Tasks for each core in which parts give their shares, at most.
TASKS = 16
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the SplitMix64 generator


def mix64(z: np.ndarray) -> np.ndarray:
    """SplitMix64's scrambling of 64-bit numbers."""
    z = z + np.uint64(_GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[1])
    return z ^ (z >> np.uint64(31))


def level_of(n: int) -> int:
    return max((j for j in range(1, LEVELS) if n >= LEAST * 4**j), default=0)


@lru_cache
def steps(level: int) -> tuple[int, ...]:
    """P(Poisson <= k) in units of 2^-52, for k from 0 on; a hash counts the steps it reaches."""
    rate = 1 - 0.5**level
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(40):
        total += term
        term *= rate / (k + 1)
        out.append(min(1 << 52, math.floor(total * (1 << 52))))
        if out[-1] >= (1 << 52) - 1 or term * (1 << 52) < 1:
            break
    return tuple(out)


def _keys(seed: int, ids: np.ndarray, stream: int, attempt: int = 0) -> np.ndarray:
    return mix64(np.uint64((seed << 32) + (attempt << 28)) + ids.astype(np.uint64) * np.uint64(2) + np.uint64(stream))


def poisson(keys: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """(replicates, rows) counts, in bytes, of the rows at the positions `at`; some replicates at a time, so that their hashes stay in the processor's cache."""
    own, limits = at.astype(np.uint64), [np.uint64(s) for s in steps(level) if s < 1 << 52]
    out = np.zeros((len(keys), len(own)), np.uint8)
    some = max(1, CACHED // max(1, len(own)))
    hashes, spare, found = (np.empty((min(some, len(keys)), len(own)), t) for t in (np.uint64, np.uint64, bool))
    for k in range(0, len(keys), some):
        made = out[k : k + some]
        z, other, reached = hashes[: len(made)], spare[: len(made)], found[: len(made)]
        np.bitwise_xor(keys[k : k + some, None], own, out=z)
        np.add(z, np.uint64(_GOLDEN), out=z)  # mix64, in place
        for shift, factor in zip((30, 27), _MIX, strict=True):
            np.right_shift(z, np.uint64(shift), out=other)
            np.bitwise_xor(z, other, out=z)
            np.multiply(z, np.uint64(factor), out=z)
        np.right_shift(z, np.uint64(31), out=other)
        np.bitwise_xor(z, other, out=z)
        np.right_shift(z, np.uint64(12), out=z)
        for limit in limits:
            np.greater_equal(z, limit, out=reached)
            if not reached.any():  # steps rise
                break
            np.add(made, reached.view(np.uint8), out=made)
    return out


def _joined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["replicate", "position", "times"])


class Draws(NamedTuple):
    """What tells all counts: the keys of the Poisson draws, their level, and the added draws (replicate, position, times); replicates count from 0."""

    keys: np.ndarray
    level: int
    added: DataFrame


def draw(spark, n: int, ids: Sequence[int], seed: int) -> Draws:
    """Exactly n draws among n rows in a replicate for each of `ids`, which its hashes depend on."""
    ids = np.array(ids)
    level, keys = level_of(n), _keys(seed, ids, 0)
    total, left = np.zeros(len(ids), np.int64), np.arange(len(ids))
    attempt = 0
    while level and len(left):
        own = keys[left]

        def add(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(own), np.int64)
            for batch in batches:
                for k in range(0, len(own), TOGETHER):
                    sums[k : k + TOGETHER] += poisson(own[k : k + TOGETHER], batch.column(0).to_numpy(), level).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(sums)], names=["i", "total"])

        rows = spark.range(0, n, 1, max(1, -(-n // 250_000))).mapInArrow(add, "i long, total long").groupBy("i").agg(F.sum("total").alias("total"))
        for r in rows.collect():  # a row for each replicate
            total[left[r["i"]]] = r["total"]
        left, attempt = left[total[left] > n], attempt + 1  # hardly ever: such a replicate starts anew
        keys[left] = _keys(seed, ids[left], 0, attempt)
    more = _keys(seed, ids, 1)

    def extra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r, lacking in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, times = np.unique(mix64(more[r] ^ np.arange(lacking, dtype=np.uint64)) % np.uint64(max(1, n)), return_counts=True)
                held.append((np.full(len(at), r), at.astype(np.int64), times))
                size += len(at)
                if size > ADDED:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)

    lacking = spark.createDataFrame([(r, int(n - t)) for r, t in enumerate(total)], "replicate long, lacking long")
    return Draws(keys, level, lacking.mapInArrow(extra, "replicate long, position long, times long"))


def counts(numbered: DataFrame, draws: Draws) -> DataFrame:
    """replicate, position, times for the rows of `numbered` (position, an integer) that are drawn; rows of a pair add up."""
    keys, level = draws.keys, draws.level

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in range(0, len(keys), TOGETHER):
                r, i = np.nonzero(made := poisson(keys[k : k + TOGETHER], at, level))
                yield pa.RecordBatch.from_arrays([pa.array(r + k), pa.array(at[i]), pa.array(made[r, i].astype(np.int64))], names=["replicate", "position", "times"])

    schema = "replicate long, position long, times long"
    return numbered.select("position").mapInArrow(drawn, schema).unionByName(draws.added) if level else draws.added


class Thresholds(NamedTuple):
    """A part's scores, falling, and for each (replicate, score) the positives and rows drawn."""

    score: np.ndarray
    #: Of this part's rows.
    positives: np.ndarray
    rows: np.ndarray
    #: Of all rows with this score.
    tied_positives: np.ndarray
    tied_rows: np.ndarray
    #: Of all rows with this score or a higher one.
    upto_positives: np.ndarray
    upto_rows: np.ndarray
    #: Of the replicate, one column.
    all_positives: np.ndarray
    all_rows: np.ndarray


@dataclass(frozen=True)
class Metric:
    """A metric of labels and scores that parts can share.

    `share` gives a part's number for each replicate, `merge` says what becomes of
    the parts' numbers, `finish(merged, positives, rows)` the value; NaN for none.
    """

    name: str
    share: Callable[[Thresholds], np.ndarray]
    finish: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    merge: str = "sum"


def _over(a: np.ndarray, b: np.ndarray, none: float = np.nan) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, none), where=b > 0)


AVERAGE_PRECISION = Metric("auprc", lambda t: (t.positives * _over(t.upto_positives, t.upto_rows, 0.0)).sum(1), lambda m, p, n: _over(m, p))
AUROC = Metric("auroc", lambda t: ((t.rows - t.positives) * (t.upto_positives - t.tied_positives / 2)).sum(1), lambda m, p, n: _over(m, p * (n - p)))
BRIER = Metric("brier", lambda t: (t.positives * (1 - t.score) ** 2 + (t.rows - t.positives) * t.score**2).sum(1), lambda m, p, n: _over(m, n))


class Part(NamedTuple):
    """A part's rows by falling score, the places where scores start, and the added draws by replicate."""

    at: np.ndarray
    y: np.ndarray
    score: np.ndarray
    start: np.ndarray
    added_replicate: np.ndarray
    added_place: np.ndarray

    def drawn(self, keys: np.ndarray, level: int) -> Iterator[tuple[slice, np.ndarray]]:
        """(replicates, counts of the rows in them) some replicates at a time."""
        some = max(1, min(TOGETHER, CELLS // len(self.at)))
        for k in range(0, len(keys), some):
            made = poisson(keys[k : k + some], self.at, level).astype(np.float64)
            mine = slice(*np.searchsorted(self.added_replicate, (k, k + some)))
            np.add.at(made.ravel(), (self.added_replicate[mine] - k) * len(self.at) + self.added_place[mine], 1.0)
            yield slice(k, k + len(made)), made

    def by_score(self, drawn: np.ndarray) -> np.ndarray:
        return drawn if len(self.start) == len(self.at) else np.add.reduceat(drawn, self.start, axis=1)


def _part(rows: pa.Table) -> Part:
    at, y = rows["position"].to_numpy(), rows["y"].to_numpy().astype(np.float64)
    score = np.nan_to_num(rows["score"].to_numpy(), nan=-np.inf)
    order = np.lexsort((at, -score))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    added = rows["added"].combine_chunks()
    lengths = pa.compute.fill_null(pa.compute.list_value_length(added), 0).to_numpy(zero_copy_only=False)
    replicate, place = added.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(place, lengths)
    turn = np.argsort(replicate, kind="stable")
    score = score[order]
    start = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
    return Part(at[order], y[order], score, start, replicate[turn], place[turn])


_STATE = ("before_p", "before_n", "earlier_p", "earlier_n", "later_p", "later_n", "all_p", "all_n")


def replicate_metrics(df: DataFrame, scores: Mapping[str, str], metrics: Sequence[Metric], replicates: int, seed: int, rows_per_part: int = ROWS) -> DataFrame:
    """metric, method, replicate, value: every metric of every method on the same draws; no row where there is no value.

    `df` has ord, y and the score columns that `scores` names by method.
    """
    spark = df.sparkSession
    values = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    numbered = position(df.select("ord", F.coalesce("y", F.lit(0)).cast("double").alias("y"), values.alias("values")), [], ["ord"])
    n = numbered.count()
    draws = draw(spark, n, range(replicates), seed)
    # the added draws lie beside their row, a number of its replicate for each
    added = draws.added.groupBy("position").agg(F.flatten(F.collect_list(F.expr("array_repeat(cast(replicate as int), cast(times as int))"))).alias("added"))
    long = numbered.join(added, "position", "left").select("position", "y", "added", F.explode("values").alias("v")).select("position", "y", "added", "v.*")
    rows = n * len(scores)
    parts = max(1, -(-rows // rows_per_part), min(spark.sparkContext.defaultParallelism, rows // FEW))
    placed = settle(long.repartitionByRange(parts, "method", F.desc("score"), "position").withColumn("part", F.spark_partition_id()))
    keys, level = draws.keys, draws.level

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's methods; a method has no other rows of this part elsewhere."""
        held = list(batches)
        whole = pa.Table.from_batches(held) if held else pa.table({"method": pa.array([], pa.string())})
        for method in pa.compute.unique(whole["method"]):
            rows = whole.filter(pa.compute.equal(whole["method"], method))
            own, sums = _part(rows), np.zeros((replicates, 6))
            head, tail = slice(0, own.start[1] if len(own.start) > 1 else None), slice(own.start[-1], None)
            for some, m in own.drawn(keys, level):
                sums[some] = np.stack([x[:, at].sum(1) if at != slice(None) else x.sum(1) for at in (slice(None), head, tail) for x in (m * own.y, m)], axis=1)
            first, last = (pa.array([x], pa.float64()) for x in (own.score[0], own.score[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([method.as_py()]), rows["part"].combine_chunks()[:1], first, last, pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["method", "part", "first", "last", "sums"])

    counted = placed.mapInArrow(count, "method string, part int, first double, last double, sums array<double>")
    counted = counted.select("method", "part", "first", "last", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.slice("sums", r * 6 + 1, F.lit(6)))).alias("replicate", "s"))
    counted = settle(counted.select("method", "part", "first", "last", F.col("replicate").cast("long").alias("replicate"), *[F.col("s")[k].alias(c) for k, c in enumerate(("p", "n", "first_p", "first_n", "last_p", "last_n"))]))

    line = Window.partitionBy("method", "replicate").orderBy("part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("method", "replicate", "first").orderBy("part").rowsBetween(0, Window.unboundedFollowing)
    to_here = Window.partitionBy("method", "replicate", "last").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    state = counted.withColumns({f"tail_{c}": F.sum(f"first_{c}").over(from_here) for c in "pn"} | {f"head_{c}": F.sum(f"last_{c}").over(to_here) for c in "pn"})
    made = {f"before_{c}": zero(F.sum(c).over(before)) for c in "pn"}
    made |= {f"later_{c}": F.when(F.lead("first").over(line) == F.col("last"), F.lead(f"tail_{c}").over(line)).otherwise(0.0) for c in "pn"}
    made |= {f"earlier_{c}": F.when(F.lag("last").over(line) == F.col("first"), F.lag(f"head_{c}").over(line)).otherwise(0.0) for c in "pn"}
    made |= {f"all_{c}": F.sum(c).over(Window.partitionBy("method", "replicate")) for c in "pn"}
    state = state.withColumns(made).select("method", "part", "replicate", *_STATE)

    def share(rows: pa.Table, beside: pa.Table) -> pa.Table:
        out = {"method": [], "metric": [], "replicate": [], "share": [], "positives": [], "rows": []}
        if len(rows):
            own = _part(rows)
            held = beside.sort_by("replicate")
            held = {c: held[c].to_numpy()[:, None] for c in _STATE}
            for some, drawn in own.drawn(keys, level):
                p, m = own.by_score(drawn * own.y), own.by_score(drawn)
                s = {c: v[some] for c, v in held.items()}
                tied, upto = [p.copy(), m.copy()], []
                for k, c in enumerate("pn"):
                    upto.append(np.cumsum((p, m)[k], axis=1))
                    upto[k] += s[f"before_{c}"]
                    upto[k][:, -1:] += s[f"later_{c}"]
                    tied[k][:, :1] += s[f"earlier_{c}"]
                    tied[k][:, -1:] += s[f"later_{c}"]
                t = Thresholds(own.score[own.start], p, m, tied[0], tied[1], upto[0], upto[1], s["all_p"], s["all_n"])
                for metric in metrics:
                    out["share"].append(metric.share(t))
                    out["metric"] += [metric.name] * len(p)
                    out["replicate"].append(np.arange(some.start, some.stop))
                    out["positives"].append(s["all_p"][:, 0]), out["rows"].append(s["all_n"][:, 0])
            out["method"] = [rows["method"][0].as_py()] * len(out["metric"])
        flat = lambda c, t: pa.array(np.concatenate([np.empty(0), *out[c]]).astype(t))
        return pa.table({"method": pa.array(out["method"], pa.string()), "metric": pa.array(out["metric"], pa.string()), "replicate": flat("replicate", np.int64), **{c: flat(c, np.float64) for c in ("share", "positives", "rows")}})

    tasks = min(parts, TASKS * spark.sparkContext.defaultParallelism)  # many small ones, because work goes by rows x replicates and not by bytes
    by_part = lambda rows: rows.repartition(tasks, "method", "part").groupBy("method", "part")
    shares = by_part(placed).cogroup(by_part(state)).applyInArrow(share, "method string, metric string, replicate long, share double, positives double, rows double")
    merged = shares.groupBy("metric", "method", "replicate").agg(F.sum("share").alias("sum"), F.max("share").alias("max"), F.max("positives").alias("positives"), F.max("rows").alias("rows"))
    by_name = {m.name: m for m in metrics}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, value = np.array(batch.column(0).to_pylist(), dtype=object), np.full(len(batch), np.nan)
            for metric in by_name.values():
                own = name == metric.name
                value[own] = metric.finish(batch.column(metric.merge).to_numpy()[own], batch.column("positives").to_numpy()[own], batch.column("rows").to_numpy()[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(value, from_pandas=True)], names=["metric", "method", "replicate", "value"])

    return merged.mapInArrow(finish, "metric string, method string, replicate long, value double").where("value IS NOT NULL")


# the same draws in SQL


def mix_sql(x: str) -> str:
    wide = lambda v: f"CAST({v} AS UHUGEINT)"
    fit = lambda v: f"CAST(({v}) % {wide(1 << 64)} AS UBIGINT)"
    z = fit(f"{wide(x)} + {wide(_GOLDEN)}")
    for shift, factor in zip((30, 27), _MIX, strict=True):
        z = fit(f"{wide(f'xor({z}, {z} >> {shift})')} * {wide(factor)}")
    return f"xor({z}, {z} >> 31)"


def draws_sql(table: str, replicates: int, seed: int, levels: int = 8) -> str:
    """CTEs that end in `drawn`: the rows of `table` with replicate and times, for tables of under LEAST * 4^levels rows."""
    lists = [(LEAST * 4**j if j else 0, "[" + ", ".join(f"{s}::UBIGINT" for s in steps(j) if s < 1 << 52) + "]::UBIGINT[]") for j in range(levels)]
    chosen = "CASE " + " ".join(f"WHEN n >= {least} THEN {values}" for least, values in reversed(lists)) + " END"
    key = lambda stream: mix_sql(f"({seed << 32} + 2 * replicate + {stream})")
    return f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS position FROM {table}),
size AS MATERIALIZED (SELECT n, {chosen} AS steps FROM (SELECT count(*) AS n FROM {table})),
keys AS MATERIALIZED (SELECT replicate, {key(0)} AS k0, {key(1)} AS k1 FROM range({replicates}) r(replicate)),
hashed AS MATERIALIZED (SELECT replicate, position, xor(k0, CAST(position AS UBIGINT)) AS z FROM numbered, keys),
rated AS MATERIALIZED (SELECT replicate, position, len(list_filter(steps, lambda s: s <= u)) AS times FROM (SELECT replicate, position, {mix_sql('z')} >> 12 AS u FROM hashed), size),
lacking AS MATERIALIZED (SELECT replicate, any_value(n) - sum(times) AS more FROM rated, size GROUP BY replicate),
asked AS MATERIALIZED (SELECT replicate, xor(k1, CAST(j AS UBIGINT)) AS z, n FROM (SELECT replicate, unnest(range(CAST(more AS BIGINT))) AS j FROM lacking) JOIN keys USING (replicate), size),
added AS (SELECT replicate, CAST({mix_sql('z')} % CAST(n AS UBIGINT) AS BIGINT) AS position, 1 AS times FROM asked),
drawn AS MATERIALIZED (
  SELECT replicate, times, numbered.* FROM (SELECT replicate, position, sum(times) AS times FROM (SELECT * FROM rated UNION ALL SELECT * FROM added) GROUP BY 1, 2 HAVING sum(times) > 0) JOIN numbered USING (position)
)"""
