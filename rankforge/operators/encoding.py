"""The place where an encoder plugs in.

An encoder is a function from a batch of token lists to vectors.  It runs in
mapInArrow, so hidden states stay inside a batch.  A model that isn't there
raises; nothing is computed in its stead unless the caller passes a stand-in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[list[int]]], list[list[float]]]


class UnavailableModel(RuntimeError):
    """The checkpoint or library of a model is missing."""


def unavailable(name: str) -> Encoder:
    raise UnavailableModel(f"{name} is not available; its embeddings are not computed")


def stand_in(width: int) -> Encoder:
    """Numbers from hashes of the tokens: shapes and plumbing of an encoder, no meaning."""

    def encode(batch: list[list[int]]) -> list[list[float]]:
        out = []
        for tokens in batch:
            digest = hashlib.sha256(",".join(map(str, tokens)).encode()).digest()
            out.append([int.from_bytes(digest[4 * i : 4 * i + 4], "big") / 2**32 for i in range(width)])
        return out

    return encode


def encode(sequences: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """cell and embedding for (cell, tokens); `encoder` is called with at most `batch` sequences.

    Sequences are dealt over the session's shuffle partitions, as encoding costs
    far more than their few bytes let Spark expect.
    """
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            tokens = [held.column(1).slice(at, batch).to_pylist() for at in range(0, len(held), batch)]
            made = pa.array([v for part in tokens for v in encoder(part)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([held.column(0), made], names=["cell", "embedding"])

    return sequences.select(F.col("cell").cast("long"), "tokens").repartition(parts, "cell").mapInArrow(run, "cell long, embedding array<double>")
