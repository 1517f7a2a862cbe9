"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side table is broadcast; beyond it the plain join stays.
BROADCAST_ROWS = 50_000
#: Bytes of rows that reach a Python worker at once, one row at least.
BATCH_BYTES = 4 << 20
#: Rows of a key up to which one task joins them.
HOT = 10_000
#: Types with a bounded size.
FIXED = ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow on batches of BATCH_BYTES at most: the session's bound is lowered where it is larger."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process a temporary one is taken.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().get()


_scratch: list[list[str]] = []


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _scratch:
        _scratch[-1].append(_checkpoint(out))
    return out


def _checkpoint(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete the checkpoint of a settled frame that nothing reads any more."""
    _delete(df.sparkSession, _checkpoint(df))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside are deleted at the end: what is to stay must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a job has finished writing into the folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def count_rows(df: DataFrame) -> int:
    """Rows of a settled frame, counted by its tasks alone: without the exchange of count()."""
    return df._jdf.queryExecution().toRdd().count()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count shows that it has at most `rows` rows.

    Call it on settled frames, whose count is a cheap read.
    """
    return F.broadcast(df) if count_rows(df) <= rows else df


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, spread: str, hot: int = HOT) -> DataFrame:
    """Left join on `key`, null equal to null; `right` is settled, has a row a key, and in `n` how many rows of `left` have it.

    A key with more than `hot` rows is dealt over several tasks by the hash of the
    column `spread`.  A small side of columns with bounded sizes is broadcast; else only the numbers of hot keys' tasks are broadcast, two numbers
    each, of the BROADCAST_ROWS most frequent keys; beyond those a key has less than
    1 / BROADCAST_ROWS of the rows.
    """
    if all(f.dataType.typeName() in FIXED for f in right.schema) and count_rows(right) <= BROADCAST_ROWS:
        side = F.broadcast(right.drop(n).withColumnRenamed(key, "__key"))
        return left.join(side, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    name = lambda c: F.xxhash64(F.col(c)).alias("__name")
    heavy = right.where(F.col(n) > hot).select(name(key), F.ceil(F.col(n) / hot).cast("int").alias("__tasks")).groupBy("__name").agg(F.max("__tasks").alias("__tasks"))
    heavy = F.broadcast(settle(heavy.orderBy(F.desc("__tasks"), "__name").limit(BROADCAST_ROWS)))
    dealt = lambda df, at: df.withColumn("__name", name(key)).join(heavy, "__name", "left").withColumn("__at", at(F.coalesce("__tasks", F.lit(1)))).drop("__name", "__tasks")
    left = dealt(left, lambda m: F.pmod(F.xxhash64(F.col(spread)), m).cast("int"))
    right = dealt(right.drop(n), lambda m: F.explode(F.sequence(F.lit(0), m - 1))).withColumnRenamed(key, "__key").withColumnRenamed("__at", "__to")
    return left.join(right, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__to")), "left").drop("__key", "__at", "__to")


def id_crc(column: str | Column) -> Column:
    """crc32 of an integer id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string").cast("binary"))
