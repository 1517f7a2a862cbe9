"""Best-fit packing of documents into sequences by minimum bin slack.

A document is its token ids followed by the end id.  Only documents longer than
a sequence are cut, into pieces of the sequence length of which the first may
be shorter.  Bins are made one at a time: the longest piece left opens the bin,
a subset-sum dynamic program over the lengths still there (a bitset in one
integer, one layer per candidate piece, stopped once the bin can be filled
exactly) finds the fullest feasible combination, and that is taken out.

Pieces are dealt by hash into blocks of about `BLOCK` rows that are packed
independently, so a task holds one block, and only the last bins of a block can
be worse than a joint packing's.

Token ids don't travel with the lengths: only the places do, and are joined to
the pieces by the number of the document's row (`doc_row`), which also tells the
pieces of repeated documents apart.

Defined cases: a null or empty text is one piece with the end id alone; any
text is used whole; repeated rows are separate documents; extra columns are not
carried; an empty table gives an empty packing.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, settle, table
from rankforge.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together.
BLOCK = 16_384


def bin_slack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into `lengths` (each in 1..capacity), fullest combination first."""
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(lengths[i], []).append(i)
    sizes, bins = sorted(stock), []
    while sizes:
        chosen = [sizes[-1]]
        room = capacity - sizes[-1]
        full, reach, layers = 1 << room, 1, []
        for at in range(bisect_right(sizes, room) - 1, -1, -1):
            size = sizes[at]
            left = min(len(stock[size]) - (size == chosen[0]), room // size)
            for _ in range(left):
                fresh = (reach << size) & (2 * full - 1) & ~reach
                if not fresh:
                    break
                layers.append((size, fresh))
                reach |= fresh
            if reach & full:
                break
        rest = reach.bit_length() - 1
        for size, fresh in reversed(layers):
            if rest and fresh >> rest & 1:
                chosen.append(size)
                rest -= size
        bins.append([])
        for size in chosen:
            bins[-1].append(stock[size].pop())
            if not stock[size]:
                del stock[size]
                sizes.pop(bisect_right(sizes, size) - 1)
    return bins


def cut(docs: DataFrame, payload: str = "ids", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, doc_row (a number of the input row), piece, start, length and the payload: ids (array) or ids_crc32."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = payload == "ids"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, part, start, length, held = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                n = -(-len(ids) // capacity)
                for k in range(n):
                    begin = max(0, len(ids) - (n - k) * capacity)
                    own = ids[begin : len(ids) - (n - k - 1) * capacity]
                    rows.append(row), part.append(k), start.append(begin), length.append(len(own))
                    held.append(own.astype("<u4") if whole else zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([x.astype(np.int32) for x in held], pa.list_(pa.int32())) if whole else pa.array(held, pa.int64()),
                ],
                names=["doc_id", "doc_row", "piece", "start", "length", payload],
            )

    return arrow_map(
        docs.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), F.col("text").cast("string").alias("text")), pieces, f"doc_id {kind}, doc_row long, piece int, start long, length long, {payload} {'array<int>' if whole else 'long'}"
    )


def pack(docs: DataFrame, payload: str = "ids", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """The pieces of `cut` with sequence_id and offset; doc_row comes last."""
    pieces = settle(cut(docs, payload, capacity, end_id, vocabulary))
    blocks = max(1, math.ceil(pieces.count() / block))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = group["block"][0].as_py() << 32
        for number, members in enumerate(bin_slack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
        return group.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    whole = payload == "ids"
    light = pieces.drop("ids")  # a block of token ids would be large
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema)
    dealt = light.withColumn("block", F.pmod(F.xxhash64("doc_row", "piece"), F.lit(blocks)))
    placed = dealt.groupBy("block").applyInArrow(place, schema + ", sequence_id long, offset long")
    if whole:
        placed = pieces.join(placed.select("doc_row", "piece", "sequence_id", "offset"), ["doc_row", "piece"])
    return placed.select("doc_id", "piece", "start", "length", payload, "sequence_id", "offset", "doc_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), payload="ids_crc32")
