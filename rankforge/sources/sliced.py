"""Row-sliced sparse containers as a Spark data source.

A container is a folder of slices and an index.  A slice holds some consecutive rows
in compressed sparse form: the rows' numbers, where each begins, columns and values.
Tasks write slices of the rows that they hold, and the index names a slice only when
the whole write is committed; a scan is a task for each slice, and filters on the row
skip slices by the index before any is opened.

    register(spark)
    write_sliced(cells, path)
    spark.read.format("sliced_csr").load(path).where("row BETWEEN 10 AND 90")

Paths go to PyArrow's file systems: local or mounted folders, HDFS, object stores.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "row long, col long, value double"
#: Rows of a slice, rows of the table in a task's partition about.
SLICE_ROWS, PART_ROWS = 4096, 1_000_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    store, at = _place(path)
    with store.open_input_stream(at) as source:
        return source.read()


def _write(path: str, data: bytes) -> None:
    store, at = _place(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as sink:
        sink.write(data)


@dataclass
class Slice(InputPartition):
    file: str
    first: int
    last: int
    cells: int


@dataclass
class Written(WriterCommitMessage):
    slices: list[Slice]


class SlicedCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sliced_csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SlicedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SlicedWriter(self.options["path"], int(self.options.get("slicerows", SLICE_ROWS)), overwrite)


class SlicedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.low, self.high = path, -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the row skip slices; Spark still applies every filter to what is read."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                match f:
                    case EqualTo(_, v):
                        self._within(v, v)
                    case GreaterThan(_, v):
                        self._within(v + 1, self.high)
                    case GreaterThanOrEqual(_, v):
                        self._within(v, self.high)
                    case LessThan(_, v):
                        self._within(self.low, v - 1)
                    case LessThanOrEqual(_, v):
                        self._within(self.low, v)
                    case In(_, values) if values:
                        self._within(min(values), max(values))
            yield f

    def _within(self, low: int, high: int) -> None:
        self.low, self.high = max(self.low, low), min(self.high, high)

    def partitions(self) -> list[Slice]:
        index = [Slice(**s) for s in json.loads(_read(f"{self.path}/index.json"))]
        return [s for s in index if s.last >= self.low and s.first <= self.high]

    def read(self, part: Slice | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where no slice is left
            return
        with np.load(io.BytesIO(_read(f"{self.path}/{part.file}"))) as held:
            row = np.repeat(held["rows"], np.diff(held["starts"]))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(held["columns"]), pa.array(held["values"])], names=["row", "col", "value"])


class SlicedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool) -> None:
        self.path, self.rows, self.overwrite = path, rows, overwrite

    def _slice(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Slice:
        rows, starts = np.unique(row, return_index=True)
        data, file = io.BytesIO(), f"slice-{uuid.uuid4().hex}.npz"
        np.savez_compressed(data, rows=rows, starts=np.append(starts, len(row)), columns=col, values=value)
        _write(f"{self.path}/{file}", data.getvalue())
        return Slice(file, int(rows[0]), int(rows[-1]), len(row))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Slices of a task's cells, which come by row; a row isn't cut."""
        made, held = [], (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            held = tuple(np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns, strict=True))
            begin = np.flatnonzero(np.diff(held[0], prepend=held[0][0] - 1)) if len(held[0]) else np.empty(0, np.int64)
            while len(begin) > self.rows:  # the row after the last one of a slice has begun
                cut = begin[self.rows]
                made.append(self._slice(*(c[:cut] for c in held)))
                held, begin = tuple(c[cut:] for c in held), begin[self.rows :] - cut
        if len(held[0]):
            made.append(self._slice(*held))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        slices = [s for m in messages if m for s in m.slices]
        old = [] if self.overwrite else self._old()
        index = sorted(old + [vars(s) for s in slices], key=lambda s: (s["first"], s["last"], s["file"]))
        _write(f"{self.path}/index.json", json.dumps(index).encode())

    def _old(self) -> list[dict]:
        store, at = _place(f"{self.path}/index.json")
        return json.loads(_read(f"{self.path}/index.json")) if store.get_file_info(at).type == fs.FileType.File else []

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for s in message.slices if message else ():
                store, at = _place(f"{self.path}/{s.file}")
                store.delete_file(at)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlicedCells)


def write_sliced(cells: DataFrame, path: str, slice_rows: int = SLICE_ROWS, part_rows: int = PART_ROWS) -> None:
    """Cells (row, col, value) as a container; one cell for each place, rows in range partitions."""
    register(cells.sparkSession)
    parts = max(1, -(-cells.count() // part_rows))
    ordered = cells.select("row", "col", "value").repartitionByRange(parts, "row").sortWithinPartitions("row", "col")
    ordered.write.format("sliced_csr").mode("overwrite").option("slicerows", slice_rows).save(path)
