"""Joins with the audit's rules: entity resolution, alignment, conflicts, overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalar import casefold, stripped
from rankforge.session import settle


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(keys)} must be unique")
    return df


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join of two frames with unique keys; columns that clash get the suffixes."""
    require_unique(left, on), require_unique(right, on)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    return left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), list(on), how)


def covered(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that insists on a partner for every row."""
    if not left.join(right, list(on), "left_anti").isEmpty():
        raise ValueError(f"rows without a partner on {list(on)}")
    return one_to_one(left, right, on, "left")


def lookup(df: DataFrame, dictionary: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    out = df.join(dictionary.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, aligned: whether two (ord, id) lists hold the same ids at the same places."""
    both = a.select("ord", F.col("id").alias("a")).join(b.select("ord", F.col("id").alias("b")), "ord", "full")
    return both.agg((F.count_if(~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("aligned"))


def conflicts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return df.groupBy(*by).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def resolve_entities(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """wanted_id, sample, status for (wanted_id, ord, normal_id, patient) against (sample, patient).

    The result of a loop over the rows by `ord`: a row takes the sample of its
    normalised id if that is there and not used; otherwise the only unused sample of
    its patient, if there is exactly one; otherwise it is UNRESOLVED.

    Without the loop: a patient's unused samples are down to one from the time its
    last but one sample is asked for by name until the last one is.  The first row
    of the patient in that time whose own sample is gone takes the last sample, so
    at most one row of a patient does.  A sample's first asker loses it only to such
    a row; where it is of another patient, it may then take that one's last sample.
    Such chains are followed in rounds, until no patient's row comes earlier; all
    else are joins and aggregates, so no patient is one task's work.
    """
    wanted = settle(wanted.select("wanted_id", "ord", "normal_id", "patient"))
    asked = wanted.join(available.select(F.col("sample").alias("normal_id"), F.col("patient").alias("owner")), "normal_id", "left")
    first = settle(asked.where("owner IS NOT NULL").groupBy("normal_id").agg(F.min("ord").alias("first")))
    asked = settle(asked.join(first, "normal_id", "left"))
    # the last two samples of each patient to be asked for; never asked for is last
    order = Window.partitionBy("patient").orderBy(F.col("first").desc_nulls_first(), "sample")
    timed = available.join(first.withColumnRenamed("normal_id", "sample"), "sample", "left").withColumn("place", F.row_number().over(order)).where("place <= 2")
    one = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    pools = timed.groupBy("patient").agg(one(1, "sample").alias("last"), one(1, "first").alias("until"), one(2, "first").alias("since"), F.max("place").alias("n"))
    # two that are never asked for: there is no such time
    pools = settle(pools.where("n = 1 OR since IS NOT NULL").drop("n"))
    in_time = (F.col("since").isNull() | (F.col("ord") > F.col("since"))) & (F.col("until").isNull() | (F.col("ord") < F.col("until")))
    gone = asked.where(F.col("owner").isNull() | (F.col("ord") > F.col("first"))).select("patient", "ord")
    rivals = asked.where((F.col("ord") == F.col("first")) & ~F.col("owner").eqNullSafe(F.col("patient"))).join(pools.select(F.col("last").alias("normal_id")), "normal_id").select("patient", "ord", "owner")
    rivals = settle(rivals)
    taker = lambda rows: rows.join(pools, "patient").where(in_time).groupBy("patient").agg(F.min("ord").alias("by"))
    takers = settle(taker(gone))
    while not rivals.isEmpty():
        lost = rivals.join(takers.select(F.col("patient").alias("owner"), "by"), "owner").where(F.col("by") < F.col("ord")).select("patient", "ord")
        after = settle(takers.unionByName(taker(lost)).groupBy("patient").agg(F.min("by").alias("by")))
        if after.exceptAll(takers).isEmpty():
            break
        takers = after
    taken = takers.join(pools.select("patient", "last"), "patient")
    own = taken.select(F.col("last").alias("normal_id"), F.col("by").alias("lost_at"))
    fallback = taken.select("patient", F.col("by").alias("ord"), "last")
    rows = asked.join(own, "normal_id", "left").join(fallback, ["patient", "ord"], "left")
    exact = (F.col("ord") == F.col("first")) & (F.col("lost_at").isNull() | (F.col("lost_at") > F.col("ord")))
    exact = F.coalesce(exact, F.lit(False))
    return rows.select(
        "wanted_id", F.when(exact, F.col("normal_id")).otherwise(F.col("last")).alias("sample"),
        F.when(exact, "EXACT_NORMALISED_ID").when(F.col("last").isNotNull(), "FALLBACK_UNIQUE_UNMATCHED_PATIENT_TIMEPOINT").otherwise("UNRESOLVED").alias("status"),
    )


def normal_key(column: str) -> Column:
    """128 bits that stand for the stripped, case-folded identifier or text; null for one that is null or blank."""
    plain = stripped(F.col(column))
    return F.when(F.length(plain) > 0, F.unhex(F.md5(casefold(plain).cast("binary"))))


def normal_overlap(left: DataFrame, right: DataFrame, column: str = "id") -> DataFrame:
    """left, right, shared: distinct stripped, case-folded identifiers of both sides; only their 128-bit keys are shuffled."""
    side = lambda df, in_left: df.select(normal_key(column).alias("k"), F.lit(in_left).alias("l")).where("k IS NOT NULL")
    both = side(left, True).unionByName(side(right, False)).groupBy("k").agg(F.max("l").alias("l"), F.max(~F.col("l")).alias("r"))
    return both.agg(F.count_if("l").alias("left"), F.count_if("r").alias("right"), F.count_if(F.col("l") & F.col("r")).alias("shared"))


#: Bits of a filter at most (8 MB), bits a key, and hashes a key.
BLOOM_BITS, KEY_BITS, HASHES = 1 << 26, 12, 6


class Bloom(NamedTuple):
    """Which 128-bit keys may be among those put in; never denies one that is."""

    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        """(keys, HASHES) places for rows of two 64-bit numbers."""
        step = keys[:, 1] | np.uint64(1)
        return (keys[:, :1] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, 8 * len(self.bits))
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _halves(keys: pa.Array) -> np.ndarray:
    """Binary keys of 16 bytes as rows of two numbers."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 2)


def bloom_filter(keys: DataFrame) -> Bloom | None:
    """Of a column k of 128-bit keys: tasks set bits, their bytes are joined by OR; none where it would be larger than BLOOM_BITS.

    The driver sees bytes that hold a bit, BLOOM_BITS / 8 of them at most.
    """
    size = 1 << max(10, (KEY_BITS * max(1, keys.count()) - 1).bit_length())
    if size > BLOOM_BITS:
        return None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = Bloom.places(_halves(batch.column(0)), size).ravel()
            np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        held = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(bits[held].astype(np.int32))], names=["at", "byte"])

    found = keys.select("k").mapInArrow(mark, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[found["at"].to_numpy()] = found["byte"].to_numpy().astype(np.uint8)
    return Bloom(bits)


def overlap_by_group(df: DataFrame, reference: DataFrame, by: str, column: str = "text") -> DataFrame:
    """by, shared: how many distinct normalised texts of `reference` each group holds.

    No text is shuffled: texts become 128-bit keys where they are, keys that the
    reference's Bloom filter denies stay there too, and the others are joined exactly.
    """
    known = settle(reference.select(normal_key(column).alias("k")).where("k IS NOT NULL").distinct())
    rows = df.select(F.col(by).alias("g"), normal_key(column).alias("k"))
    wanted, bloom = rows.where("k IS NOT NULL"), bloom_filter(known)
    if bloom is not None:
        shared = df.sparkSession.sparkContext.broadcast(bloom.bits)

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Bloom(shared.value)
            for batch in batches:
                yield batch.filter(pa.array(held.may_hold(_halves(batch.column(1)))))

        wanted = wanted.mapInArrow(may, wanted.schema)
    hits = wanted.groupBy("g", "k").agg(F.lit(1).alias("one")).join(known, "k", "left_semi")
    hits = hits.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    every = rows.groupBy("g").agg(F.lit(1).alias("one")).withColumnRenamed("g", "h")
    return every.join(hits, F.col("h").eqNullSafe(F.col("g")), "left").select(F.col("h").alias(by), F.coalesce("n", F.lit(0)).cast("long").alias("shared"))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean of `value` over all rows of the other groups, from totals instead of a non-equi join."""
    per = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return per.join(every).select(group, F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("mean_without"))
