"""Readers, sinks, seals, documents, streams and the command line."""

import gzip
import hashlib
import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge import cli
from rankforge.operators import documents
from rankforge.plans import benchmark, registry
from rankforge.plans import io as scans
from rankforge.sources import readers, sinks
from rankforge.streaming import gate


def test_ragged_text(spark, tmp_path):
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as out:
        out.write("\tc1\tc2\nnote\tx\ty\t\nGENE1\t4\t0\t\nGENE2\t1.5\t7\t\n")
    got = sorted(map(tuple, readers.ragged_matrix(spark, str(tmp_path)).collect()))
    assert got == [("GENE1", "c1", 4.0), ("GENE2", "c1", 1.5), ("GENE2", "c2", 7.0)]


@pytest.mark.parametrize("name", ["s05_wide_matrix", "s06_ragged_matrix", "s09_selected_columns"])
def test_whole_matrix_over_several_files(spark, monkeypatch, name):
    """Every gene and sample comes back, however the matrix is cut into files."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(scans, "_COLUMNS", 4)
    monkeypatch.setattr(scans, "_GENES", 30)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity")).collect()
    want = [(str(g), ("c" if "ragged" in name else "") + str(s), float(v)) for g, s, v in lines if v and ("selected" not in name or s in (2, 5))]
    assert sorted(map(tuple, registry.queries()[name](spark, sf).select("gene", "cell", "value").collect())) == sorted(want)
    assert len({g for g, _, _ in want}) > 60


@pytest.mark.parametrize("name", ["s05_wide_matrix", "s06_ragged_matrix", "s09_selected_columns"])
def test_matrix_files_grow_with_the_values(spark, monkeypatch, tmp_path, name):
    """6,000 values among 2,000 genes x 1,000 samples: neither a field of every pair nor a line of zeros takes its bytes."""
    lines = spark.range(6000).selectExpr("id % 2000 AS l_partkey", "id AS l_orderkey", "(id * 7919) % 1000 AS l_suppkey", "1.0D + id % 9 AS l_quantity")
    lines.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    monkeypatch.setattr(scans, "_folder", lambda _: str(tmp_path / "io"))
    got = registry.queries()[name](spark, str(tmp_path / "sf"))
    assert sum(f.stat().st_size for f in (tmp_path / "io").rglob("part-*")) < 60 * 6000
    want = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity")).collect()
    want = [(str(g), ("c" if "ragged" in name else "") + str(s), v) for g, s, v in want if "selected" not in name or s in (2, 5)]
    assert sorted(map(tuple, got.select("gene", "cell", "value").collect())) == sorted(want)


def test_ragged_rows_of_any_length(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes("\tc1\tc2\tc3\nnote\nA\t1\t\nB\r\n\t5\t\nÄ\t\t0\t2.5\t9\t9\t\nC\t\tnan\nD\t0\t-3".encode())
    got = sorted(map(tuple, readers.ragged_matrix(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert [r[:2] for r in got] == [("", "c1"), ("A", "c1"), ("C", "c2"), ("D", "c2"), ("Ä", "c3")]
    assert [r[2] for r in got if r[0] != "C"] == [5.0, 1.0, -3.0, 2.5] and np.isnan(got[2][2])


def test_template_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("junk\n\nSample name\ttitle\ttitle\tresponse x\nSample 1\ta\tb\tR\nother\tz\nSample 2\tc\n")
    out = readers.template_metadata(spark, str(tmp_path / "t.tsv"))
    assert out.columns == ["sample_name", "title", "response_x"]
    assert [tuple(r) for r in out.orderBy("sample_name").collect()] == [("Sample 1", "a", "R"), ("Sample 2", "c", None)]


def test_wide_and_market(spark, tmp_path):
    (tmp_path / "w.csv").write_text("g,c1,c2\nA,0,2\nB,3,0\n")
    wide = readers.wide_matrix(spark, str(tmp_path / "w.csv"))
    assert sorted(map(tuple, wide.collect())) == [("A", "c2", 2.0), ("B", "c1", 3.0)]
    with pytest.raises(ValueError):
        readers.wide_matrix(spark, str(tmp_path / "w.csv"), cells=["c9"])
    assert readers.header(spark, str(tmp_path / "w.csv")) == ["g", "c1", "c2"]
    with pytest.raises(ValueError):
        readers.check_alignment(["a", "b"], ["b", "a"])
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n3 2 3\n1 1 5\n3 2 3\n2 1 9\n")
    genes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord long, id string")
    cells = spark.createDataFrame([(1, "x"), (2, "y")], "ord long, id string")
    want = [("a", "x", 5.0), ("b", "x", 9.0), ("c", "y", 3.0)]
    assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "m.mtx"), genes, cells).collect())) == want
    (tmp_path / "t.mtx").write_text("%%MatrixMarket\n2 3 3\n1 1 5\n2 3 3\n1 2 9\n")
    assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "t.mtx"), genes, cells).collect())) == want


def test_manifest_spellings():
    plain = {"original_name": "f", "original_size": 3, "original_sha256": "AB", "original_md5": "CD", "parts": [{"name": "p", "size": 3, "sha256": "EF"}]}
    want = readers.Manifest("f", 3, "ab", "cd", [("p", 3, "ef")])
    assert readers.read_manifest(plain) == want
    assert readers.read_manifest({"filename": "f", "size": 3, "sha256": "ab", "md5": "cd", "chunks": [{"filename": "p", "bytes": 3, "part_sha256": "ef"}]}) == want
    assert readers.read_manifest({"source": {"name": "f", "size": 3, "sha256": "ab", "md5Checksum": "cd"}, "parts": [{"part_name": "p", "part_size": 3, "sha256": "ef"}]}) == want
    assert readers.read_manifest({"source_name": "f", "source_size": 3, "parts": [{"name": "p", "size": 3}]}) == readers.Manifest("f", 3, None, None, [("p", 3, None)])
    for broken in ({"size": 1}, {"parts": [{"name": "p"}]}):
        with pytest.raises(ValueError):
            readers.read_manifest(broken)


def test_matrix_of_16000_columns(spark, tmp_path):
    names = [str(i) for i in range(16_000)]
    lines = ['"g",' + ",".join(names)] + [f'"G{k}",' + ",".join("" if i == 7 else str(k) if i % 4000 == k else "0" for i in range(16_000)) for k in range(1, 4)]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    want = sorted((f"G{k}", str(i), float(k)) for k in range(1, 4) for i in range(16_000) if i % 4000 == k)
    assert sorted(map(tuple, readers.wide_matrix(spark, str(tmp_path / "w.csv")).collect())) == want
    some = readers.wide_matrix(spark, str(tmp_path / "w.csv"), cells=["4001", "2"])
    assert sorted(map(tuple, some.collect())) == [("G1", "4001", 1.0), ("G2", "2", 2.0)]


@pytest.mark.parametrize("width", [2, 499, 501])
def test_wide_matrix_has_one_parser(spark, tmp_path, width):
    """Quoted separators, a row like the header, empty fields and blank lines, at any width and over several blocks of a file."""
    names = ["c,0", *(f"c{i}" for i in range(1, width))]
    rest = ",0" * (width - 2)
    lines = ['g,"c,0",' + ",".join(names[1:]), f'"A,x",1{rest},"7"', "", f'"say ""B""",,{rest[1:] + "," if rest else ""}2.5', f"C,0{rest},1e3"]
    for k in (1, 2):
        (tmp_path / f"w{k}.csv").write_text("\n".join(lines) + "\n" + "".join(f"D{i},0{rest},{k}\n" for i in range(50)))
    want = [("A,x", "c,0", 1.0), ("A,x", names[-1], 7.0), ('say "B"', names[-1], 2.5), ("C", names[-1], 1000.0)] * 2 + [(f"D{i}", names[-1], float(k)) for k in (1, 2) for i in range(50)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    try:
        got = readers.wide_matrix(spark, f"{tmp_path}/*.csv").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert sorted(map(tuple, readers.wide_matrix(spark, f"{tmp_path}/*.csv", cells=["c,0"]).collect())) == [("A,x", "c,0", 1.0)] * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_matrix_refuses_what_is_no_number(spark, tmp_path):
    (tmp_path / "w.csv").write_text("g,c1,c2\nA,x,2\n")
    with pytest.raises(Exception, match="ArrowInvalid"):
        readers.wide_matrix(spark, str(tmp_path / "w.csv")).collect()


def test_report_raises_beyond_its_rows(spark):
    rows = spark.range(sinks.REPORT_ROWS + 1).select(F.format_string("m%05d", "id").alias("method"), F.col("id").alias("n"))
    with pytest.raises(ValueError, match="at most"):
        sinks.report(rows, {}, "t")
    assert sinks.report(rows.limit(sinks.REPORT_ROWS), {}, "t").count("\n| m0") == sinks.REPORT_ROWS


def test_checkpoints_on_a_cluster_need_a_shared_folder(monkeypatch):
    from rankforge import session

    class Context:
        master = "spark://host:7077"

        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):
            return True

        def get(self, key):
            return None

    frame = type("Frame", (), {"sparkSession": type("Session", (), {"sparkContext": type("C", (Context,), {"_jsc": Context()})()})()})()
    with pytest.raises(ValueError, match="executors share"):
        session.settle(frame)


def test_npz_and_vectors(spark, tmp_path):
    np.savez(tmp_path / "s.npz", data=np.array([1.0, 2.0]), indices=np.array([1, 0]), indptr=np.array([0, 1, 1, 2]), shape=np.array([3, 2]))
    assert sorted(map(tuple, readers.sparse_npz(spark, str(tmp_path)).collect())) == [(0, 1, 1.0), (2, 0, 2.0)]
    entities = spark.createDataFrame([("a",), ("b",)], "k string")
    vectors = lambda rows: spark.createDataFrame(rows, "k string, embedding array<double>")
    assert readers.aligned_vectors(entities, vectors([("a", [1.0]), ("b", [2.0])]), "k", 1).count() == 2
    for bad in ([("a", [1.0])], [("a", [1.0]), ("b", [float("nan")])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [1.0]), ("a", [1.0]), ("b", [2.0])]):
        with pytest.raises(ValueError):
            readers.aligned_vectors(entities, vectors(bad), "k", 1)


def test_split_parts(spark, tmp_path):
    parts = tmp_path / "parts"
    parts.mkdir()
    (parts / "f.000").write_bytes(b"hello ")
    (parts / "f.001.bin").write_bytes(b"world")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = {"source": {"name": "f", "size": 11, "md5Checksum": hashlib.md5(b"hello world").hexdigest()}, "parts": [{"name": "f.000", "size": 6, "sha256": sha(b"hello ")}, {"name": "f.001", "bytes": 5, "sha256": sha(b"world")}]}
    target = str(tmp_path / "whole")
    assert readers.reassemble(spark, str(parts), manifest, target) == sha(b"hello world")
    (parts / "f.000").write_bytes(b"hellO ")
    with pytest.raises(ValueError, match="f.000"):
        readers.reassemble(spark, str(parts), manifest, target)
    (tmp_path / "a.json").write_text('{"x": [1, {"y": 2}]}')
    assert documents.json_path(readers.read_document(spark, str(tmp_path / "a.json")), "x.1.y") == 2
    assert readers.find_unique(spark, str(tmp_path), "a.json").endswith("/a.json")
    with pytest.raises(ValueError):
        readers.find_unique(spark, str(tmp_path), "f.*")


def test_simulation_is_deterministic_and_planted(spark):
    a, b = readers.simulate(spark, 600, 11), readers.simulate(spark, 600, 11).repartition(5)
    assert len(a.columns) == 17 and sorted(a.collect()) == sorted(b.collect(), key=None)
    row = a.agg(F.max(F.col("label_pre_cutoff") * F.col("label_post_cutoff")), F.count_distinct("gene_id")).first()
    assert tuple(row) == (0, 600)
    late = {r[0]: r[1] for r in readers.simulate(spark, 4000, 3).groupBy("planted_group").agg(F.avg("differential_expression_id")).collect()}
    assert late["biology_signal"] > late["noise"] + 0.5


def test_seals_tell_tampering(spark, tmp_path):
    df = spark.createDataFrame([("g1", "i", 1, 0.5), ("g2", "i", 2, 0.25)], "target_gene string, indication string, gene_fold int, m double")
    keys = ["target_gene", "indication", "gene_fold"]
    path = str(tmp_path / "sealed")
    sinks.freeze_scores(df, df, keys, path)
    assert sinks.verify_seal(spark, path) == []
    df.where("gene_fold = 1").write.mode("overwrite").parquet(f"{path}/data")
    assert "n_rows" in sinks.verify_seal(spark, path)
    for bad in (df.withColumn("my_label", F.lit(1)), df.union(df), df.where("gene_fold = 1"), df.withColumn("m", F.lit("x")), df.withColumn("m", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            sinks.freeze_scores(bad, df, keys, str(tmp_path / "no"))


def test_small_files_are_byte_stable(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.rand(1).alias("v"))
    a = sinks.small_csv(df, str(tmp_path / "a.csv.gz"), ["k"])
    assert a == sinks.small_csv(df.repartition(4), str(tmp_path / "b.csv.gz"), ["k"])
    assert sinks.canonical_json({"b": 1, "a": [1]}) == b'{"a":[1],"b":1}'


def test_registry_claims_schedule():
    good = {"model_id": "m", "family": "f", "checkpoint_identifier": "c", "version": "1", "licence": "x", "documented_pretraining_corpora": ["d"], "leakage_status": "RESOLVED_CLEAN", "availability": "AVAILABLE", "enabled_by_default": True}
    assert documents.worst(documents.check_registry([good])) == "PASS"
    for change in ({"leakage_status": "maybe"}, {"extra": 1}, {"documented_pretraining_corpora": []}, {"version": 1}):
        assert documents.worst(documents.check_registry([good | change])) == "FAIL"
    assert documents.worst(documents.check_registry([good, good])) == "FAIL"
    text = "x <!-- claim file=a path=r.0.v value=0.1234567 --> <!-- claim file=a path=r.0.v value=0.2 -->"
    assert [c.status for c in documents.check_claims(text, lambda f: {"r": [{"v": 0.1234568}]})] == ["PASS", "FAIL"]
    assert documents.add_months(date(2025, 11, 30), 3) == date(2026, 2, 28)
    days = documents.schedule(date(2026, 1, 31), date(2026, 12, 1), 3)
    assert days[:2] == [date(2026, 1, 28), date(2026, 4, 28)]
    assert documents.decide_snapshot({days[1]: "PASS", days[0]: "WAIT"}, days[0], days[-1]) == ("PASS", days[1])
    with pytest.raises(ValueError):
        documents.decide_snapshot({date(2020, 1, 1): "PASS"}, days[0], days[-1])
    frozen = documents.freeze_protocol({"a": 1})
    assert documents.protocol_intact(frozen) and not documents.protocol_intact(frozen | {"a": 2})


def _bundle(tmp_path, **change):
    summary = {"genes": 5, "rows": 9, "lower": -0.1, "delta": 0.0, "upper": 0.2, "conclusion": "NOT_SUPPORTED", "holdout_access_count": 1} | change
    (tmp_path / "summary.json").write_text(json.dumps(summary))
    digest = hashlib.sha256((tmp_path / "summary.json").read_bytes()).hexdigest()
    (tmp_path / "BUNDLE.json").write_text(json.dumps({"files": {"summary.json": digest}, "totals": {"genes": 5, "rows": 10}, "tolerated": ["rows"]}))


def test_sealed_bundle(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["temporal-validate", "--bundle", str(tmp_path), *a], spark)
    _bundle(tmp_path)
    assert run() == cli.OK and run("--strict") == cli.WARNED
    (tmp_path / "summary.json").write_text((tmp_path / "summary.json").read_text() + " ")
    assert run() == cli.FAILED
    for change in ({"conclusion": "SUPPORTED"}, {"lower": 0.5}, {"holdout_access_count": 2}, {"genes": 6}):
        _bundle(tmp_path, **change)
        assert run() == cli.FAILED


def test_benchmark_and_claims(spark):
    rows = spark.range(80).select(F.col("id").alias("ord"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 4 + F.col("id") % 3).cast("double").alias("score")).withColumn("score", -F.col("score"))
    methods = {benchmark.REFERENCE: F.col("score"), "good": F.col("y") + F.rand(1) * 0.1, "bad": -F.col("y").cast("double")}
    out = {r["method"]: r for r in benchmark.run_benchmark(rows, methods, k=5, replicates=25).collect()}
    assert out["good"]["auprc"] == 1.0 and out["good"]["state"] == "DETECTABLE_GAIN" and out["bad"]["state"] == "DETECTABLE_LOSS"
    said = benchmark.claims(benchmark.run_benchmark(rows, methods, k=5, replicates=25))
    assert len(said["permitted"]) == 1 and "good" in said["permitted"][0]
    seen = benchmark.Holdout(rows)
    seen.read(), seen.read()
    assert seen.accesses == 2


def test_stream_drops_late_data_and_closes_windows(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", i % 3, "purchase") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    gate.run_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    late = spark.createDataFrame([(99, "2024-01-01 05:00:00", 1, "purchase"), (100, "2024-01-09 05:00:00", 1, "purchase")], "event_id long, t string, user_id long, event_type string")
    late.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gate.run_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [r["n"] for r in out] == [10, 10, 10, 10]
    passing = gate.first_passing(spark.read.parquet(str(tmp_path / "out")), 15).where("passes").orderBy("start").first()
    assert passing["total"] == 20
    assert gate.session_counts(df).count() > 0


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    run = lambda *a: cli.main(list(a), spark)
    assert run("simulate", "--output", at("c.parquet"), "--n", "600") == cli.OK
    assert run("ingest", "--data", at("c.parquet"), "--output", at("i.parquet")) == cli.OK
    assert run("split", "--data", at("i.parquet"), "--output", at("s.parquet")) == cli.OK
    assert run("baseline", "--data", at("s.parquet"), "--output", at("b.parquet")) == cli.OK
    assert run("evaluate", "--data", at("i.parquet"), "--score", "mean_expression_id") == cli.OK
    assert run("benchmark", "--data", at("i.parquet"), "--output", at("out"), "--replicates", "10") == cli.OK
    assert (tmp_path / "out" / "REPORT.md").read_text().startswith("# Ranking audit")
    assert run("report", "--scores", at("out/scores.csv"), "--claims", at("out/claims.json"), "--output", at("r.md")) == cli.OK
    pairs = spark.createDataFrame([(f"G{i}", f"I{i % 5}", i % 10, int(i < 15)) for i in range(30)], "target_gene string, indication string, gene_fold int, label_new_clinical_entry int")
    pairs.write.parquet(at("labels.parquet"))
    for needed, code in ((10, cli.OK), (99, cli.WAITS)):
        (tmp_path / "p.json").write_text(json.dumps({"first_snapshot": "2026-01-01", "last_snapshot": "2027-01-01", "holdout_fold": 9, "thresholds": {"positive_pairs": needed}}))
        assert run("contextual-snapshot-gate", "--labels", at("labels.parquet"), "--protocol", at("p.json"), "--snapshot", "2026-04-01") == code
    assert run("contextual-snapshot-gate", "--labels", at("labels.parquet"), "--protocol", at("p.json"), "--snapshot", "2025-04-01") == cli.FAILED
    assert run("contextual-protocol-init", "--protocol", at("p.json"), "--output", at("frozen.json")) == cli.OK
    assert documents.protocol_intact(json.loads((tmp_path / "frozen.json").read_text()))
    scores = pairs.select("target_gene", "indication", "gene_fold", F.rand(1).alias("m"))
    scores.write.parquet(at("scores.parquet"))
    assert run("contextual-score-freeze", "--scores", at("scores.parquet"), "--pairs", at("labels.parquet"), "--output", at("sealed")) == cli.OK
    assert run("contextual-score-freeze-validate", "--artefact", at("sealed")) == cli.OK
    assert run("contextual-validate", "--artefact", at("sealed")) == cli.OK
    assert run("leakage", "--corpus", at("i.parquet"), "--evaluation", at("i.parquet"), "--column", "gene_id") == cli.FAILED
    assert len(cli.COMMANDS) >= 19
