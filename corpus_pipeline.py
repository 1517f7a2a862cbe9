"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the documents are written as Parquet and read again.  A run
that is given the folder of an earlier one goes on after the last stage that the
earlier one finished, if the stages and the table's path, columns and number of
rows are the same, and else refuses.  A stage's checkpoints are deleted when it is
written; its output stays, as that of a run without a folder does in a new one.

Defined cases: a null text or one without a letter goes in the first stage; a
document without labels of its kind is judged like any other; null sources are a
source, null doc_ids are kept, repeated rows are copies of which one stays; texts are
used whole; extra columns pass through to the mix and end at packing; an empty table
gives an empty result.

The result has the token ids of every piece with its sequence and offset.
`doc_row` tells repetitions of a document apart.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import dedup, language, mixing, packing, quality
from rankforge.llm.common import is_written, scratch, shared_folder, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; the model learns from the stage's own input."""
    return language.keep_known(docs, ~language.is_held_out())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality stay."""
    return quality.keep_good(docs, quality.learn(spark, sf_dir, docs.select("doc_id", "text")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack(docs, payload="ids")


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The learned stages and the signatures have no SQL form; a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    own = json.dumps([[name for name, _ in STAGES], sf_dir, docs.schema.json(), docs.count()])
    if not is_written(spark, f"{folder}/run"):
        spark.createDataFrame([(own,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/run")
    elif spark.read.parquet(f"{folder}/run").first()["run"] != own:
        raise ValueError(f"{folder} holds a run over other stages or another table")
    for name, stage in STAGES:
        if not is_written(spark, f"{folder}/{name}"):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
