"""Scans, sinks and the streaming extension as queries: each writes what it then reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators.ranking import position
from rankforge.plans.base import CELLS, cells, query
from rankforge.session import settle, table
from rankforge.sources import readers, sinks, sliced
from rankforge.streaming import gate


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the place that executors share."""
    settle(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/io-{uuid.uuid4().hex}"


def _text(df: DataFrame, path: str, order: str | None = None) -> str:
    """Lines as one text file."""
    (df.orderBy(order) if order else df).select("value").coalesce(1).write.text(path)
    return path


@query("s01_csv_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/part.csv"
    sinks.write_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "csv")
    return readers.read_table(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("s02_gzip_csv_index", "SELECT s_suppkey, s_name FROM supplier")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/index.csv"
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", "true").option("compression", "gzip").csv(path)
    return readers.read_csv(spark, path, "s_suppkey long, s_name string")


@query("s03_parquet_by_suffix", "SELECT n_nationkey, n_name FROM nation")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.parquet"
    sinks.write_table(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return readers.read_table(spark, path)


_WHOLE = "whole AS (SELECT gene, sample, sum(value) AS value FROM cells GROUP BY 1, 2)"
#: Columns of one file, genes of one file about, placed columns that are broadcast.
_COLUMNS, _GENES, _PLACED = 200, 1 << 18, 1 << 20


def _blocks(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    """The matrix as lines of files of so many columns each, sorted by file.

    file, o (0 for the header, whose fields are the names, 1 for a gene), gene,
    fields (at, text by place) and width.  A gene has a line only where it has a
    value, and a file about so many of them, so what is written grows with the
    non-zeros, not with genes x samples.  Only entries move, never lines.
    """
    matrix = cells(spark, sf).groupBy("gene", "sample").agg(F.sum("value").alias("value"))
    known = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.count(F.lit(1)).alias("n"))  # entries of a sample at most
    placed = settle(position(known, [], ["sample"]).select("sample", "n", F.floor(F.col("position") / _COLUMNS).alias("block"), (F.col("position") % _COLUMNS).alias("at")))
    parts = placed.groupBy("block").agg(F.ceil(F.sum("n") / _GENES).alias("parts"), F.count(F.lit(1)).alias("width"))
    columns = settle(placed.join(parts, "block").select("sample", "block", "at", "parts", "width"))
    beside = F.broadcast(columns) if columns.count() <= _PLACED else columns
    file = lambda part: F.concat_ws("-", F.col("block").cast("string"), part.cast("string")).alias("file")
    entries = matrix.join(beside, "sample").select(file(F.pmod(F.xxhash64("gene"), F.col("parts"))), F.lit(1).alias("o"), "gene", "at", "width", F.col("value").cast("string").alias("text"))
    names = columns.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    names = names.select(file(F.col("part")), F.lit(0).alias("o"), F.lit(None).cast(matrix.schema["gene"].dataType).alias("gene"), "at", "width", F.concat(F.lit(prefix), F.col("sample").cast("string")).alias("text"))
    files = parts.agg(F.sum("parts")).first()[0] or 1
    held = entries.unionByName(names).repartition(files, "file").groupBy("file", "o", "gene").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("fields"), F.max("width").alias("width"))
    return held.sortWithinPartitions("file", "o")


def _spread(fields: str, sep: str) -> Column:
    """The texts at their places, each behind as many separators as it is places from the one before; zeros are empty fields."""
    gap = lambda e, i: e["at"] - F.coalesce(F.get(fields, i - 1)["at"], F.lit(-1).cast("long"))
    return F.array_join(F.transform(fields, lambda e, i: F.concat(F.repeat(F.lit(sep), gap(e, i).cast("int")), e["text"])), "")


def _wide(spark: SparkSession, sf: str) -> str:
    """The matrix as compressed files of so many columns each, written by one job."""
    held = _blocks(spark, sf)
    rest = F.repeat(F.lit(","), (F.col("width") - 1 - F.element_at("fields", -1)["at"]).cast("int"))
    first = F.when(F.col("o") == 0, "gene").otherwise(F.col("gene").cast("string"))
    path = f"{_folder(spark)}/wide"
    held.select("file", F.concat(first, _spread("fields", ","), rest).alias("value")).write.partitionBy("file").option("compression", "gzip").text(path)
    return f"{path}/*/*.txt.gz"


@query("s05_wide_matrix", f"WITH {CELLS}, {_WHOLE} SELECT CAST(gene AS VARCHAR) AS gene, CAST(sample AS VARCHAR) AS cell, value FROM whole WHERE value <> 0")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    return readers.wide_matrix(spark, _wide(spark, sf))


@query("s06_ragged_matrix", f"WITH {CELLS}, {_WHOLE} SELECT CAST(gene AS VARCHAR) AS gene, 'c' || sample AS cell, value FROM whole WHERE value <> 0")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed ragged files of so many columns and genes each, as one file is one task's work; a row ends behind its last value."""
    lines = F.when(F.col("o") == 0, F.array(_spread("fields", "\t"), F.lit("\tannotation")))
    lines = lines.otherwise(F.array(F.concat(F.col("gene").cast("string"), _spread("fields", "\t"), F.lit("\t"))))
    path = f"{_folder(spark)}/ragged"
    _blocks(spark, sf, "c").select("file", F.explode(lines).alias("value")).write.partitionBy("file").option("compression", "gzip").text(path)
    return readers.ragged_matrix(spark, f"{path}/*/*.txt.gz")


@query("s09_selected_columns", f"WITH {CELLS}, {_WHOLE} SELECT CAST(gene AS VARCHAR) AS gene, CAST(sample AS VARCHAR) AS cell, value FROM whole WHERE value <> 0 AND sample IN (2, 5)")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    return readers.wide_matrix(spark, _wide(spark, sf), cells=["2", "5"])


@query("s07_template_metadata", "SELECT 'Sample ' || s_suppkey AS sample_name, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    key, last = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey").cast("string"))
    body = table(spark, sf, "supplier").select((key + 3).alias("o"), F.concat_ws("\t", F.concat(F.lit("Sample "), key), "s_name", last).alias("value"))
    head = spark.createDataFrame([(0, "SERIES"), (1, "# x\ty"), (2, "Sample name\ttitle\tnation\ttitle")], "o long, value string")
    return readers.template_metadata(spark, _text(head.unionByName(body), f"{_folder(spark)}/template.txt", "o"))


@query("s08_annotated_cells", "SELECT s_suppkey AS cell_id, n_name AS cohort, s_name AS sample, n_name || '|' || s_name AS sample_key FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_name")
    return readers.annotated_cells(joined, {"s_suppkey": "cell_id", "n_name": "cohort", "s_name": "sample"}, "cohort", "sample")


@query("s12_matrix_market", "SELECT n_name AS gene, r_name AS cell, CAST(n_nationkey + 1 AS DOUBLE) AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    body = nation.select((F.col("n_nationkey") + 2).alias("o"), F.concat_ws(" ", F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.col("n_nationkey") + 1).alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{region.count()} {nation.count()} {nation.count()}")], "o long, value string")
    path = _text(head.unionByName(body.select(F.col("o").cast("long"), "value")), f"{_folder(spark)}/m.mtx", "o")
    genes = nation.select((F.col("n_nationkey") + 1).cast("long").alias("ord"), F.col("n_name").alias("id"))
    return readers.matrix_market(spark, path, genes, region.select((F.col("r_regionkey") + 1).cast("long").alias("ord"), F.col("r_name").alias("id")))


@query("s14_sliced_container", f"WITH {CELLS} SELECT gene AS row, cell AS col, CAST(sum(value) AS DOUBLE) AS value FROM cells WHERE gene BETWEEN 40 AND 90 GROUP BY 1, 2")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """All cells as a row-sliced container, of which only the slices are read that the filter leaves."""
    path = f"{_folder(spark)}/sliced"
    made = cells(spark, sf).groupBy(F.col("gene").cast("long").alias("row"), F.col("cell").cast("long").alias("col")).agg(F.sum("value").cast("double").alias("value"))
    sliced.write_sliced(made, path, slice_rows=64)
    return spark.read.format("sliced_csr").load(path).where("row BETWEEN 40 AND 90")


@query("s15_filtered_extract", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id = 8")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return readers.cells_of(table(spark, sf, "events"), event_type="purchase", user_id=8).select("event_id", "user_id", "value")


@query("s16_aligned_vectors", "SELECT vec_id, label, len(embedding) AS width FROM embeddings")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    width = rows.select(F.size("embedding")).first()[0]
    return readers.aligned_vectors(rows.select("vec_id", "label"), rows, "vec_id", width).select("vec_id", "label", F.size("embedding").alias("width"))


@query("k08_resumable_partitions", "SELECT n_nationkey, n_regionkey FROM nation")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the partitions are written, the missing ones found and added, the old ones kept."""
    path = f"{_folder(spark)}/resumed"
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    sinks.write_table(rows.where("n_regionkey < 2"), path, by=["n_regionkey"], resume=True)
    todo = sinks.missing_partitions(spark, rows.select("n_regionkey").distinct(), path, ["n_regionkey"])
    sinks.write_table(rows.join(F.broadcast(todo), "n_regionkey").select("n_nationkey", "n_regionkey"), path, by=["n_regionkey"], resume=True)
    return spark.read.parquet(path)


@query("k10_sealed_artefact", "SELECT count(*) AS n_rows, TRUE AS intact FROM part")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/sealed"
    manifest = sinks.seal(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, "parts")
    return spark.range(1).select(F.lit(manifest["n_rows"]).alias("n_rows"), F.lit(not sinks.verify_seal(spark, path)).alias("intact"))


@query(
    "k10_altered_ranges",
    """WITH a AS (SELECT p_partkey, p_name, p_brand, p_size FROM part),
b AS (SELECT p_partkey, p_name, p_brand, CAST(CASE WHEN p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_partkey % 331 <> 5 UNION ALL SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey = 70),
d AS (SELECT DISTINCT p_partkey // 32 AS range FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT range, (SELECT count(*) FROM a WHERE p_partkey // 32 = range) AS n_before, (SELECT count(*) FROM b WHERE p_partkey // 32 = range) AS n_after FROM d""",
)
def k10_altered(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed parts of which some sizes are then changed, some rows lost and one is there twice: the ranges of keys it happened in."""
    path, columns = f"{_folder(spark)}/sealed", ["p_partkey", "p_name", "p_brand", "p_size"]
    rows = table(spark, sf, "part").select(*columns)
    sinks.seal(rows, path, "parts", ranges="p_partkey div 32")
    size = F.when(F.col("p_partkey") % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    rows.where(F.col("p_partkey") % 331 != 5).withColumn("p_size", size).unionByName(rows.where("p_partkey = 70")).write.mode("overwrite").parquet(f"{path}/data")
    return sinks.altered_ranges(spark, path)


@query(
    "x02_streaming_gate",
    """WITH d AS (SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
last AS (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) AS day FROM events)
SELECT strftime(start, '%Y-%m-%d') AS day, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS total, sum(n) OVER (ORDER BY start) >= 500 AS passes FROM d, last WHERE start < last.day""",
)
def x02(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed, from a stream over the event files."""
    folder = _folder(spark)
    table(spark, sf, "events").repartition(4).write.parquet(f"{folder}/in")
    gate.run_once(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    out = gate.first_passing(spark.read.parquet(f"{folder}/out"), 500)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "total", "passes")
