"""Command line: one command per audit step.

Exit codes: 0 done, 1 failed, 2 warnings where --strict asks, 3 the gate waits.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import contracts, documents, heads, matching, matrix, ranking, sampling
from rankforge.plans import benchmark as bench
from rankforge.session import get_session
from rankforge.sources import readers, sinks

OK, FAILED, WARNED, WAITS = 0, 1, 2, 3
_STATUS = {"PASS": OK, "WARNING": OK, "FAIL": FAILED}
Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Command, tuple[str, ...], str]] = {}


def command(name: str, *arguments: str) -> Callable[[Command], Command]:
    """Arguments: plain names are required, name=default optional, name? a flag."""

    def add(function: Command) -> Command:
        COMMANDS[name] = (function, arguments, (function.__doc__ or "").splitlines()[0])
        return function

    return add


def _show(document: object) -> None:
    print(json.dumps(document, indent=2, sort_keys=True, default=str))


def _load(path: str) -> object:
    return json.loads(Path(path).read_text())


def _checks(checks: Sequence[documents.Check], strict: bool = False) -> int:
    status = documents.worst(checks)
    _show({"status": status, "checks": [vars(c) for c in checks]})
    return WARNED if strict and status == "WARNING" else _STATUS[status]


def _scored(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("ord"), F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("score"))


@command("simulate", "output", "n=900", "seed=11")
def simulate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write a synthetic candidate table."""
    sinks.write_table(readers.simulate_until(spark, int(a.n), int(a.seed)), a.output)
    return OK


@command("ingest", "data", "output", "edges=")
def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check the canonical table and add network centrality from an edge list."""
    df = readers.read_table(spark, a.data)
    contracts.require_columns(df, ["gene_id", "label_pre_cutoff", "label_post_cutoff", "entry_year"])
    if a.edges:
        edges = readers.read_table(spark, a.edges)
        graph = matrix.degree_centrality(edges.select(F.col(edges.columns[0]).cast("string").alias("src"), F.col(edges.columns[1]).cast("string").alias("dst")))
        graph = graph.select(F.col("node").alias("gene_id"), F.col("centrality").alias("network_centrality"))
        df = df.drop("network_centrality").join(graph, "gene_id", "left").na.fill(0.0, ["network_centrality"])
    contracts.require_columns(df, ["network_centrality"])
    labels = {c: ~F.col(c).isin(0, 1) for c in ("label_pre_cutoff", "label_post_cutoff")}
    checks = contracts.judged(contracts.violations(df, labels).union(contracts.repeats(df, ["gene_id"])))
    status = contracts.overall(checks).first()["status"]
    if status == "FAIL":
        _show([r.asDict() for r in checks.collect()])
        return FAILED
    sinks.write_table(df, a.output)
    return OK


@command("split", "data", "output", "seed=5")
def split(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the stratified historical split and the at-risk universe as columns."""
    df = readers.read_table(spark, a.data)
    out = sampling.stratified_split(df, "gene_id", "label_pre_cutoff", int(a.seed))
    out = out.withColumn("is_evaluation", sampling.at_risk(F.col("label_pre_cutoff"), F.col("entry_year"), F.col("label_post_cutoff")))
    if out.where("is_evaluation AND label_post_cutoff = 1").isEmpty():
        raise ValueError("the evaluation has no positive")
    sinks.write_table(out, a.output)
    return OK


@command("leakage", "corpus", "evaluation", "column=id")
def leakage(spark: SparkSession, a: argparse.Namespace) -> int:
    """Count the identifiers that a corpus and an evaluation table share."""
    read = lambda p: readers.read_table(spark, p).select(F.col(a.column).cast("string").alias("id"))
    found = matching.normal_overlap(read(a.corpus), read(a.evaluation)).first().asDict()
    _show(found)
    return FAILED if found["shared"] else OK


@command("baseline", "data", "output", "column=publication_count_pre_cutoff", "label=label_pre_cutoff", "seed=5")
def baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    """Tune a scalar baseline and write its scores."""
    df = sampling.stratified_split(readers.read_table(spark, a.data), "gene_id", a.label, int(a.seed)).withColumn("ord", F.col("gene_id"))
    best = heads.tune_scalar(df, a.column, a.label, F.col("is_train"))
    sinks.write_table(heads.scalar_candidates(df, a.column, F.col("is_train")).select("gene_id", F.col(best).alias("score")), a.output)
    _show({"configuration": best})
    return OK


@command("embed", "entities", "vectors", "output", "key=gene_id", "width=64")
def embed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Align external vectors with entities and write them."""
    out = readers.aligned_vectors(readers.read_table(spark, a.entities).select(a.key), readers.read_table(spark, a.vectors), a.key, int(a.width))
    sinks.write_table(out, a.output)
    return OK


@command("reassemble-split", "parts", "manifest", "output")
def reassemble(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check the parts of a split file and write the whole."""
    _show({"sha256": readers.reassemble(spark, a.parts, _load(a.manifest), a.output)})
    return OK


@command("real-preprocess", "matrix", "cells", "output", "sep=,")
def preprocess(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pseudobulk, specificity and fractions of a gene x cell table; cells has cell, sample and grp."""
    meta = readers.read_table(spark, a.cells).select("cell", "sample", "grp")
    readers.check_alignment(readers.header(spark, a.matrix, a.sep)[1:], [r["cell"] for r in meta.select("cell").collect()])
    cells = readers.wide_matrix(spark, a.matrix, a.sep).join(meta, "cell")
    sizes = meta.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))
    sinks.write_table(matrix.cpm(matrix.group_sums(cells, ["sample"])), f"{a.output}/pseudobulk")
    features = matrix.specificity(matrix.group_means(cells, sizes, ["grp"]), "grp").join(matrix.cell_summary(cells, F.lit(meta.count())), "gene")
    sinks.write_table(features, f"{a.output}/features")
    return OK


@command("representation-smoke", "sequences", "output", "width=8")
def smoke(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run token sequences (cell, tokens) through the encoder interface with a stand-in."""
    from rankforge.operators.encoding import encode, stand_in

    sinks.write_table(encode(readers.read_table(spark, a.sequences), stand_in(int(a.width))), a.output)
    return OK


@command("response-transfer-proxy", "data", "output", "key=gene_symbol", "target=target", "folds=5")
def transfer(spark: SparkSession, a: argparse.Namespace) -> int:
    """Ridge with hash folds from the numeric columns to a target; writes out-of-fold predictions."""
    df = readers.read_table(spark, a.data)
    features = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name != a.target]
    alpha, out = heads.ridge_by_folds(df.withColumn("ord", F.col(a.key)), features, a.target, a.key, (0.1, 1.0, 10.0, 100.0), int(a.folds))
    row = ranking.spearman(out, [], "prediction", "target").first()
    sinks.write_table(out, a.output)
    _show({"alpha": alpha, "spearman": row["spearman"]})
    return OK


@command("evaluate", "data", "label=label_post_cutoff", "score=score", "key=gene_id", "k=20")
def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rank metrics of one score column."""
    _show(ranking.metric_bundle(_scored(readers.read_table(spark, a.data), a.label, a.score, a.key), [], int(a.k)).first().asDict())
    return OK


@command("benchmark", "data", "output", "label=label_post_cutoff", "key=gene_id", "reference=publication_count_pre_cutoff", "replicates=100", "subset=0")
def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """Compare every numeric feature with the popularity control on the at-risk universe."""
    df = readers.read_table(spark, a.data)
    df = df.where(sampling.at_risk(F.col("label_pre_cutoff"), F.col("entry_year"), F.col("label_post_cutoff")))
    if int(a.subset):
        df = sampling.capped_subset(df, a.key, a.label, int(a.subset), 5)
    names = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    rows = df.withColumns({"ord": F.col(a.key), "y": F.col(a.label).cast("int")})
    results = bench.run_benchmark(rows, {bench.REFERENCE: F.col(a.reference)} | {n: F.col(n) for n in names}, replicates=int(a.replicates)).cache()
    said = bench.claims(results)
    sinks.small_csv(results, f"{a.output}/scores.csv", ["method"])
    sinks.write_json(said, f"{a.output}/claims.json")
    sinks.write_bytes(sinks.report(results, said, "Ranking audit").encode(), f"{a.output}/REPORT.md")
    return OK


@command("report", "scores", "claims", "output")
def report(spark: SparkSession, a: argparse.Namespace) -> int:
    """Render a Markdown report from scores and claims."""
    sinks.write_bytes(sinks.report(readers.read_table(spark, a.scores), _load(a.claims), "Ranking audit").encode(), a.output)
    return OK


@command("contextual-protocol-init", "protocol", "output")
def protocol_init(spark: SparkSession, a: argparse.Namespace) -> int:
    """Freeze a protocol with its digest."""
    sinks.write_json(documents.freeze_protocol(_load(a.protocol)), a.output)
    return OK


@command("contextual-validate", "artefact", "strict?")
def contextual_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check a sealed artefact against its manifest."""
    wrong = sinks.verify_seal(spark, a.artefact)
    return _checks([documents.Check(w, "FAIL") for w in wrong] or [documents.Check("content", "PASS")], a.strict)


@command("contextual-snapshot-gate", "labels", "protocol", "snapshot")
def snapshot_gate(spark: SparkSession, a: argparse.Namespace) -> int:
    """The label-only power gate of a snapshot."""
    rules = _load(a.protocol)
    day, first, last = (date.fromisoformat(str(x)) for x in (a.snapshot, rules["first_snapshot"], rules["last_snapshot"]))
    documents.decide_snapshot({day: "WAIT"}, first, last)
    labels = matching.require_unique(readers.read_table(spark, a.labels), ["target_gene", "indication"])
    found = contracts.power_gate(labels, "target_gene", "indication", "gene_fold", "label_new_clinical_entry", int(rules["holdout_fold"]), rules["thresholds"]).first().asDict()
    _show(found | {"snapshot": a.snapshot})
    return OK if found["gate"] == "PASS" else WAITS


@command("contextual-score-freeze", "scores", "pairs", "output")
def score_freeze(spark: SparkSession, a: argparse.Namespace) -> int:
    """Seal future scores over exactly the frozen pairs."""
    _show(sinks.freeze_scores(readers.read_table(spark, a.scores), readers.read_table(spark, a.pairs), ["target_gene", "indication", "gene_fold"], a.output))
    return OK


@command("contextual-score-freeze-validate", "artefact")
def score_freeze_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check sealed scores."""
    return _checks([documents.Check(w, "FAIL") for w in sinks.verify_seal(spark, a.artefact)] or [documents.Check("content", "PASS")])


@command("temporal-validate", "bundle", "strict?")
def temporal_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check a sealed result bundle: BUNDLE.json names digests, totals and tolerated differences."""
    root = Path(a.bundle)
    spec, summary = _load(str(root / "BUNDLE.json")), _load(str(root / "summary.json"))
    files = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.name != "BUNDLE.json"}
    return _checks(documents.check_bundle(files, spec["files"], spec["totals"], summary, spec.get("tolerated", ())), a.strict)


@command("validate-manifest", "registry")
def validate_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Check a model registry."""
    return _checks(documents.check_registry(readers.read_document(spark, a.registry)))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankforge", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments, text) in COMMANDS.items():
        sub = commands.add_parser(name, help=text)
        for argument in arguments:
            key, optional, default = argument.partition("=")
            if key.endswith("?"):
                sub.add_argument(f"--{key[:-1]}", action="store_true")
            else:
                sub.add_argument(f"--{key}", required=not optional, default=default if optional else None)
    a = parser.parse_args(argv)
    try:
        return COMMANDS[a.command][0](spark or get_session(), a)
    except (ValueError, KeyError, OSError) as problem:
        print(f"{a.command}: {problem}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
