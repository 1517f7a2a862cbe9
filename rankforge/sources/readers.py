"""Scans: delimited tables, wide matrices, ragged and template text, MatrixMarket, vectors, split files, documents.

Large inputs become long DataFrames inside Spark; only headers, small
dictionaries and manifests are read on the driver, through Spark's readers, so
that any store Spark reads will do.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; gzip is told by the suffix. With a schema, bad rows fail."""
    reader = spark.read.option("header", "true").option("sep", sep)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet, JSON or CSV by suffix."""
    kind = PurePosixPath(path.rstrip("/")).name.lower().removesuffix(".gz")
    if kind.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if kind.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema is not None else spark.read).option("multiLine", str(kind.endswith(".json"))).json(path)
    return read_csv(spark, path, schema, "\t" if kind.endswith((".tsv", ".tab")) else ",")


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names alone."""
    return spark.read.option("header", "true").option("sep", sep).csv(path).columns


def check_alignment(columns: Sequence[str], ids: Sequence[str]) -> None:
    """Matrix columns and annotation rows must name the same cells in the same order."""
    if list(columns) != list(ids):
        first = next((i for i, (a, b) in enumerate(zip(columns, ids, strict=False)) if a != b), min(len(columns), len(ids)))
        raise ValueError(f"columns and annotations differ from position {first} on")


def wide_matrix(spark: SparkSession, path: str, sep: str = ",", cells: Sequence[str] | None = None) -> DataFrame:
    """gene, cell, value of gene x cell tables with gene names first: non-zeros only, optionally of some cells.

    One parser for any number of columns: lines reach tasks as text, with the place
    of their block, whose first line is the header where it begins a file; quoted
    fields may hold separators.  Every file has its own header, so one scan reads the
    column blocks that a very wide table is cut into; the headers, a name for each
    column, pass through the driver.  Neither the plan nor generated code grows with
    the columns, and of a selection only its columns are converted.  A row with
    another number of fields than its header, or a field that isn't a number, fails.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            held = batch["file"].dictionary_encode()
            fresh = [(held.indices.index(i).as_py(), f) for i, f in enumerate(held.dictionary.to_pylist()) if f not in seen]
            seen.update(f for _, f in fresh)
            at = pa.array([i for i, _ in fresh], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["file"].take(at), batch["value"].take(at)], names=["file", "line"])

    heads = {r["file"]: next(csv.reader([r["line"]], delimiter=sep))[1:] for r in text.where("start = 0").mapInArrow(first_lines, "file string, line string").collect()}  # a row for each file
    if cells is not None and (missing := sorted(set(cells).difference(*heads.values()))):
        raise ValueError(f"cells missing from the matrix: {missing[:3]}")
    wanted = None if cells is None else set(cells)
    if wanted is not None:  # files without any of the columns aren't read again
        text = text.where(F.col("file").isin([f for f, names in heads.items() if not wanted.isdisjoint(names)]))

    def table(lines: list[str], names: list[str]) -> pa.RecordBatch:
        chosen = [k for k, n in enumerate(names) if wanted is None or n in wanted]
        read = pyarrow.csv.ReadOptions(column_names=["gene", *(f"f{k}" for k in range(len(names)))])
        kinds = {"gene": pa.string()} | {f"f{k}": pa.float64() for k in chosen}
        convert = pyarrow.csv.ConvertOptions(column_types=kinds, include_columns=list(kinds), null_values=[""], strings_can_be_null=False)
        held = pyarrow.csv.read_csv(io.BytesIO("\n".join(lines).encode()), read, pyarrow.csv.ParseOptions(delimiter=sep), convert)
        values = np.stack([c.to_numpy() for c in held.columns[1:]], axis=1) if chosen else np.zeros((len(held), 0))
        row, at = np.nonzero(np.nan_to_num(values, nan=0.0, posinf=1.0, neginf=1.0))
        cell = pa.array([names[k] for k in chosen], pa.string()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([held["gene"].combine_chunks().take(pa.array(row)), cell, pa.array(values[row, at])], names=["gene", "cell", "value"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            lines, size = [], 0
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = (file, start) != block
                if lines and (size > TEXT_BYTES or (fresh and file != block[0])):
                    yield table(lines, heads[block[0]])
                    lines, size = [], 0
                block = (file, start)
                if (fresh and start == 0) or not line:
                    continue
                lines.append(line)
                size += len(line)
            if lines:
                yield table(lines, heads[block[0]])

    return text.mapInArrow(parse, "gene string, cell string, value double")


#: Characters of lines that are parsed at once, one line at least.
TEXT_BYTES = 1 << 22


def ragged_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell, value of a tab text: line 1 cells, line 2 skipped, then rows that end in an empty field.

    Lines are told by their place in the file, so a file is one task's work, as
    gzip demands; rows are streamed, many lines to an Arrow batch.
    """

    def block(text: str, cells: pa.Array) -> pa.RecordBatch:
        """Whole lines: only fields that hold something become strings, the text's own bytes."""
        raw = np.frombuffer(text.encode(), np.uint8)
        end = np.flatnonzero((raw == 9) | (raw == 10))
        start = np.append(0, end[:-1] + 1)
        last = raw[end] == 10
        row = np.cumsum(last) - last
        first = np.append(0, np.flatnonzero(last)[:-1] + 1)  # of each line
        place = np.arange(len(end)) - first[row]
        kept = np.flatnonzero((start < end) & (place > 0) & (place <= len(cells)))
        spans = np.column_stack([start, end]).ravel().astype(np.int32)  # fields at even places, what parts them at odd ones
        fields = pa.StringArray.from_buffers(len(spans) - 1, pa.py_buffer(spans), pa.py_buffer(raw))
        values = fields.take(pa.array(2 * kept)).cast(pa.float64()).to_numpy()
        kept, values = kept[values != 0], values[values != 0]
        return pa.RecordBatch.from_arrays([fields.take(pa.array(2 * first[row[kept]])), cells.take(pa.array(place[kept] - 1)), pa.array(values)], names=["gene", "cell", "value"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.GzipFile(fileobj=io.BytesIO(content)) if name.endswith(".gz") else io.BytesIO(content)
                lines = io.TextIOWrapper(io.BufferedReader(data), encoding="utf-8")
                cells = pa.array([c for c in next(lines, "").rstrip("\n").split("\t") if c], pa.string())
                next(lines, None)
                while text := "".join(lines.readlines(TEXT_BYTES)):
                    yield block(text if text.endswith("\n") else text + "\n", cells)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "gene string, cell string, value double")


def template_metadata(spark: SparkSession, path: str, first: str = "Sample name", keep: str = r"^Sample\s+\d+$") -> DataFrame:
    """Rows of a spreadsheet-like tab text: the header is the line that starts with `first`, rows match `keep`.

    Short rows are filled with nulls; the first of columns with one name stays.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith(first)).first()
    if head is None:
        raise ValueError(f"no line starts with {first!r}")
    names = head["value"].split("\t")
    parts = F.split("value", "\t", -1)
    columns = [F.get(parts, i).alias(re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_")) for i, n in enumerate(names) if n.strip() and names.index(n) == i]
    return lines.where(F.trim(parts[0]).rlike(keep)).select(*columns)


def annotated_cells(df: DataFrame, names: dict[str, str], cohort: str, sample: str) -> DataFrame:
    """Renamed columns and the composite key cohort|sample: one sample name occurs in several cohorts."""
    return df.withColumnsRenamed(names).withColumn("sample_key", F.concat_ws("|", cohort, sample))


def matrix_market(spark: SparkSession, path: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """gene, cell, value of a coordinate file; the axis that fits `rows` (ord from 1, id) is the gene axis."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    head = lines.first()["value"]  # the sizes; an entry may read the same, so one such line goes, not all
    same = lines.where(F.col("value") == head)
    parts = F.split(F.trim("value"), r"\s+")
    kept = lines.where(F.col("value") != head).unionByName(same.limit(same.count() - 1))
    entries = kept.select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("value"))
    n_genes = rows.count()
    i, j = ("i", "j") if int(head.split()[0]) == n_genes else ("j", "i")
    genes, cells = rows.select(F.col("ord").alias(i), F.col("id").alias("gene")), columns.select(F.col("ord").alias(j), F.col("id").alias("cell"))
    return entries.join(genes, i).join(cells, j).select("gene", "cell", "value")


def sparse_npz(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of CSR .npz files, one file per task."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for batch in batches:
            for content in batch["content"]:
                held = np.load(io.BytesIO(content))
                rows = np.repeat(np.arange(len(held["indptr"]) - 1), np.diff(held["indptr"]))
                yield pd.DataFrame({"row": rows, "col": held["indices"].astype("int64"), "value": held["data"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "row long, col long, value double")


def aligned_vectors(entities: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """Every entity with its vector; missing, repeated, misshapen or non-finite vectors fail."""
    if not vectors.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("repeated ids among the vectors")
    out = entities.join(vectors.select(key, "embedding"), key, "left")
    bad = F.col("embedding").isNull() | (F.size("embedding") != width) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    missing = out.where(bad).select(key).limit(3).collect()
    if missing:
        raise ValueError(f"no usable vector for {[r[0] for r in missing]}")
    return out


def cells_of(df: DataFrame, **equals: object) -> DataFrame:
    """A census-like extract: equality filters that reach the Parquet scan."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document, read through Spark."""
    text = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def find_unique(spark: SparkSession, root: str, name: str) -> str:
    """The only file of that name below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path").limit(3).collect()
    if len(files) != 1:
        raise ValueError(f"{len(files)} files named {name!r} below {root}")
    return files[0]["path"]


# The names of a split file's manifest fields, in order of preference.
PART_LIST = ("parts", "chunks")
PART_NAME = ("name", "filename", "part_name")
PART_SIZE = ("size", "bytes", "part_size")
PART_SHA256 = ("sha256", "part_sha256")
WHOLE_NAME = ("original_name", "filename", "source_name")
WHOLE_SIZE = ("original_size", "size", "source_size")
WHOLE_SHA256 = ("original_sha256", "sha256")
WHOLE_MD5 = ("original_md5", "md5")
SOURCE_NAME, SOURCE_SIZE, SOURCE_SHA256, SOURCE_MD5 = ("name",), ("size",), ("sha256",), ("md5", "md5Checksum")


def _field(entry: dict, names: Sequence[str]) -> object:
    return next((entry[n] for n in names if entry.get(n) is not None), None)


class Manifest(NamedTuple):
    """What a manifest says of the whole file and of its parts (name, size, sha256)."""

    name: str | None
    size: int | None
    sha256: str | None
    md5: str | None
    parts: list[tuple[str, int, str | None]]


def read_manifest(raw: dict) -> Manifest:
    source = raw.get("source") if isinstance(raw.get("source"), dict) else {}
    listed = _field(raw, PART_LIST)
    if listed is None:
        raise ValueError(f"the manifest has none of {PART_LIST}")
    parts = []
    for entry in listed:
        name, size, sha = _field(entry, PART_NAME), _field(entry, PART_SIZE), _field(entry, PART_SHA256)
        if name is None or size is None:
            raise ValueError(f"a part without name or size: {entry}")
        parts.append((str(name), int(size), None if not sha else str(sha).lower()))
    whole = [_field(raw, own) if _field(raw, own) is not None else _field(source, of) for own, of in ((WHOLE_NAME, SOURCE_NAME), (WHOLE_SIZE, SOURCE_SIZE), (WHOLE_SHA256, SOURCE_SHA256), (WHOLE_MD5, SOURCE_MD5))]
    return Manifest(whole[0], None if whole[1] is None else int(whole[1]), *(None if v is None else str(v).lower() for v in whole[2:]), parts)


def check_parts(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """name, ord, ok for every part: its size and, where given, SHA-256 against the manifest; a part may have one more suffix."""
    wanted = spark.createDataFrame([(i, *part) for i, part in enumerate(read_manifest(manifest).parts)], "ord int, name string, size long, sha string")
    files = spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("digest"))
    named = F.expr("file = name OR startswith(file, name || '.')")
    joined = wanted.join(F.broadcast(files), named, "left").groupBy("ord", "name").agg(F.count("file").alias("n"), F.coalesce(F.bool_and((F.col("length") == F.col("size")) & F.coalesce(F.col("digest") == F.col("sha"), F.lit(True))), F.lit(False)).alias("ok"))
    return joined.select("ord", "name", ((F.col("n") == 1) & F.col("ok")).alias("ok"))


def reassemble(spark: SparkSession, root: str, manifest: dict, target: str) -> str:
    """Write the parts one after another to the local file `target` and check the whole; returns its SHA-256."""
    import hashlib
    import os

    bad = [r["name"] for r in check_parts(spark, root, manifest).where("NOT ok").collect()]
    if bad:
        raise ValueError(f"parts that differ from the manifest: {bad}")
    sha, md5, size = hashlib.sha256(), hashlib.md5(), 0
    partial = f"{target}.part"
    files = spark.read.format("binaryFile").load(root).select("path", "content")
    with open(partial, "wb") as out:
        for part, *_ in read_manifest(manifest).parts:  # one part in memory at a time
            name = F.element_at(F.split("path", "/"), -1)
            content = bytes(files.where((name == part) | name.startswith(part + ".")).first()["content"])
            out.write(content), sha.update(content), md5.update(content)
            size += len(content)
    said = read_manifest(manifest)
    wanted = {"size": said.size, "sha256": said.sha256, "md5": said.md5}
    seen = {"size": size, "sha256": sha.hexdigest(), "md5": md5.hexdigest()}
    wrong = [k for k, v in wanted.items() if v is not None and str(v).lower() != str(seen[k])]
    if wrong:
        os.remove(partial)
        raise ValueError(f"the whole differs from the manifest in {wrong}")
    os.replace(partial, target)
    return seen["sha256"]


def hash_normal(key: Column, seed: int) -> Column:
    """A standard normal from the hash of a key (Box and Muller)."""
    from rankforge.functions.scalar import uniform

    u, v = uniform(key, seed), uniform(key, seed + 7919)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * 3.141592653589793 * v)


def simulate(spark: SparkSession, n: int, seed: int = 11, cutoff: int = 2018, end: int = 2023) -> DataFrame:
    """A synthetic candidate table of 17 columns with three planted groups.

    Deterministic in (n, seed); equal in distribution to what the audit needs,
    not in its numbers: biology drives entry in one group, popularity in
    another, nothing in the third.
    """
    from rankforge.functions.scalar import sigmoid, uniform

    key = F.col("id").cast("string")
    z = {name: hash_normal(key, seed + 100 * i) for i, name in enumerate(("expr", "diff", "spec", "net", "pop", "ood"))}
    group = F.when(uniform(key, seed) < 0.2, "biology_signal").when(uniform(key, seed) < 0.5, "popularity_only").otherwise("noise")
    rows = spark.range(n).select("id", group.alias("planted_group"), *[c.alias(f"z_{k}") for k, c in z.items()], uniform(key, seed + 1).alias("u_entry"), uniform(key, seed + 2).alias("u_year"))
    biology = (F.col("planted_group") == "biology_signal").cast("int")
    popular = (F.col("planted_group") == "popularity_only").cast("int")
    before = F.floor(F.exp(1.5 + 0.8 * F.col("z_pop") + 1.2 * popular)).cast("long")
    chance = sigmoid(-2.6 + 1.4 * biology * (1 + F.col("z_diff")) + 0.9 * popular)
    year = F.when(F.col("u_entry") < chance, (cutoff - 12 + F.floor(F.col("u_year") * (end - cutoff + 13))).cast("int"))
    rows = rows.withColumn("entry_year", year).withColumn("before", before)
    column = lambda base, shift, noise: base + shift * biology + 0.3 * F.col(noise)
    return rows.select(
        F.format_string("GENE%06d", "id").alias("gene_id"), "planted_group", "entry_year",
        F.coalesce((F.col("entry_year") <= cutoff).cast("int"), F.lit(0)).alias("label_pre_cutoff"),
        F.coalesce(((F.col("entry_year") > cutoff) & (F.col("entry_year") <= end)).cast("int"), F.lit(0)).alias("label_post_cutoff"),
        F.col("before").alias("publication_count_pre_cutoff"), (F.col("before") + F.floor(F.exp(1 + F.col("z_ood"))).cast("long")).alias("publication_count_all_time"),
        column(F.col("z_expr"), 0.4, "z_net").alias("mean_expression_id"), column(F.col("z_expr"), 0.3, "z_ood").alias("mean_expression_ood"),
        column(F.col("z_diff"), 0.9, "z_net").alias("differential_expression_id"), column(F.col("z_diff"), 0.6, "z_ood").alias("differential_expression_ood"),
        sigmoid(column(F.col("z_spec"), 0.6, "z_net")).alias("cell_type_specificity_id"), sigmoid(column(F.col("z_spec"), 0.4, "z_ood")).alias("cell_type_specificity_ood"),
        sigmoid(F.col("z_net") + 0.3 * biology).alias("network_centrality"), (uniform(F.col("id").cast("string"), seed + 3) < 0.25).cast("int").alias("druggable_class"),
        F.lit(cutoff).alias("cutoff_year"), F.lit(end).alias("evaluation_end_year"),
    )


def simulate_until(spark: SparkSession, n: int, seed: int = 11, least: int = 8, attempts: int = 20) -> DataFrame:
    """`simulate` under the first of `attempts` seeds with `least` positives on both sides of the cutoff."""
    for k in range(attempts):
        df = simulate(spark, n, seed + k)
        pre, post = df.agg(F.sum("label_pre_cutoff"), F.sum("label_post_cutoff")).first()
        if (pre or 0) >= least and (post or 0) >= least:
            return df
    raise ValueError(f"no seed of {attempts} gives {least} positives on both sides")
