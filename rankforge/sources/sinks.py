"""Sinks: tables, byte-stable small files, documents, sealed artefacts, reports."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import merkle

#: Rows up to which a result may become one driver-side file.
DRIVER_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), resume: bool = False) -> None:
    """Parquet, CSV or JSON. `resume` replaces only the partitions that `df` has, so a rerun completes what is missing."""
    writer = df.write.mode("overwrite").option("header", "true").format(kind)
    if by:
        writer = writer.partitionBy(*by)
    if resume:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def missing_partitions(spark: SparkSession, wanted: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """The rows of `wanted` (columns `by`) that have no output below `path` yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return wanted
    return wanted.join(spark.read.parquet(path).select(*by).distinct(), list(by), "left_anti")


def csv_bytes(df: DataFrame, order: Sequence[str], zipped: bool = False) -> bytes:
    """One CSV, gzipped without a time if asked for: equal bytes for equal rows."""
    rows = df.orderBy(*order).limit(DRIVER_ROWS + 1).toPandas()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} rows; write a table and seal its content instead")
    data = rows.to_csv(index=False, lineterminator="\n").encode()
    if not zipped:
        return data
    held = io.BytesIO()
    with gzip.GzipFile(fileobj=held, mode="wb", mtime=0, filename="") as out:
        out.write(data)
    return held.getvalue()


def small_csv(df: DataFrame, path: str, order: Sequence[str]) -> str:
    """One local CSV, gzipped if named .gz. Returns its SHA-256."""
    return write_bytes(csv_bytes(df, order, path.endswith(".gz")), path)


def write_bytes(data: bytes, path: str) -> str:
    """Atomic: a temporary file that takes the place of the old one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "wb") as out:
        out.write(data)
    os.replace(f"{path}.tmp", path)
    return hashlib.sha256(data).hexdigest()


def put_bytes(spark: SparkSession, data: bytes, path: str) -> str:
    """The same for any store that the cluster reaches: through Hadoop's file system, renamed when whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, partial = place(path), place(f"{path}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(partial, True)
    stream.write(bytearray(data))
    stream.close()
    files.delete(target, False)
    if not files.rename(partial, target):
        raise OSError(f"could not rename to {path}")
    return hashlib.sha256(data).hexdigest()


def canonical_json(document: object) -> bytes:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def write_json(document: object, path: str) -> str:
    return write_bytes((json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode(), path)


def seal(df: DataFrame, path: str, kind: str, extra: Mapping[str, object] | None = None, ranges: str = merkle.BY_DIGEST) -> dict:
    """Write `df` as Parquet with a manifest beside it that pins rows, schema and content, and the tree that says where content changed.

    `ranges` is an SQL expression of the columns, a long, for the ranges that a change is found in.
    """
    df.write.mode("overwrite").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    merkle.ranges(written, written.columns, ranges).write.mode("overwrite").parquet(f"{path}/tree")
    top = merkle.root(written.sparkSession.read.parquet(f"{path}/tree")).first().asDict()
    manifest = {"kind": kind, "columns": written.columns, "schema": written.schema.simpleString(), "ranges": ranges, **top, **(extra or {})}
    manifest["manifest_sha256"] = hashlib.sha256(canonical_json(manifest)).hexdigest()
    text = written.sparkSession.createDataFrame([(canonical_json(manifest).decode(),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def verify_seal(spark: SparkSession, path: str) -> list[str]:
    """What differs from the manifest; empty for an intact artefact."""
    manifest = _manifest(spark, path)
    digest = manifest.pop("manifest_sha256", None)
    wrong = [] if hashlib.sha256(canonical_json(manifest)).hexdigest() == digest else ["manifest_sha256"]
    data = spark.read.parquet(f"{path}/data")
    if data.schema.simpleString() != manifest["schema"]:
        return [*wrong, "schema"]
    now = merkle.root(merkle.ranges(data, manifest["columns"], manifest["ranges"])).first().asDict()
    tree = merkle.root(spark.read.parquet(f"{path}/tree")).first()
    return wrong + [k for k, v in now.items() if manifest.get(k) != v] + (["tree"] if tree["root"] != manifest.get("root") else [])


def altered_ranges(spark: SparkSession, path: str) -> DataFrame:
    """range, n_before, n_after of the ranges whose rows aren't the sealed ones."""
    manifest = _manifest(spark, path)
    data = spark.read.parquet(f"{path}/data")
    return merkle.altered(spark.read.parquet(f"{path}/tree"), merkle.ranges(data, manifest["columns"], manifest["ranges"]))


def freeze_scores(scores: DataFrame, pairs: DataFrame, keys: Sequence[str], path: str) -> dict:
    """Seal future scores: exactly the pairs, no repeats, numbers only, nothing that looks like a label."""
    looks = [c for c in scores.columns if "label" in c.lower() or "outcome" in c.lower()]
    if looks:
        raise ValueError(f"label-like columns in a score table: {looks}")
    methods = [c for c in scores.columns if c not in keys]
    if not scores.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("repeated pairs")
    if not scores.select(*keys).exceptAll(pairs.select(*keys)).isEmpty() or not pairs.select(*keys).exceptAll(scores.select(*keys)).isEmpty():
        raise ValueError("the scores' pairs differ from the frozen pairs")
    number = {c: F.col(c).cast("string").try_cast("double") for c in methods}
    bad = scores.select(*[F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias(c) for c, v in number.items()]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"values that are not finite numbers: { {c: n for c, n in bad.items() if n} }")
    return seal(scores.select(*keys, *[v.alias(c) for c, v in number.items()]), path, "frozen_scores", extra={"methods": methods})


#: Rows of a report.
REPORT_ROWS = 1000


def markdown_table(rows: Sequence[Mapping[str, object]]) -> str:
    if not rows:
        return "_no rows_\n"
    names = list(rows[0])
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]) + "\n"


def report(results: DataFrame, claims: Mapping[str, Sequence[str]], title: str) -> str:
    """Markdown from a result table of one row per method."""
    rows = [r.asDict() for r in results.orderBy("method").limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write a table instead")
    said = "".join(f"\n## {kind.capitalize()}\n\n" + "".join(f"- {c}\n" for c in items) for kind, items in claims.items())
    return f"# {title}\n\n{markdown_table(rows)}{said}"
