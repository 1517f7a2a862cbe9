"""WARC records and revisits, the corpus pipeline, and the subpackage's place."""

import ast
import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import registry, warc
from rankforge.llm.common import settle
from rankforge.llm.tokens import default_vocabulary, encoder
from tests.llm.test_dedup import brute_classes
from tests.llm.test_text_operators import _fill

ROOT = Path(__file__).resolve().parents[2]


def _record(i, kind, url, date, headers, status=200, profile=warc.NOT_MODIFIED):
    return (i, kind, url, date, profile if kind == "revisit" else None, status, headers, b"body")


def test_warc_round_trip(spark, tmp_path):
    rows = [_record("<a>", "response", "http://x/ü", "2024-01-01T00:00:00Z", {"etag": '"1"', "x-a": "b: c"}), _record("<b>", "revisit", "http://x/", None, {}, 304), ("<c>", "metadata", None, None, None, None, {}, b"\r\n\r\nraw")]
    frame = spark.createDataFrame(rows, warc.RECORD)
    members = {r["record_id"]: bytes(r["member"]) for r in warc.as_warc(frame).collect()}
    data = b"".join(members[r[0]] for r in rows)
    for content in (data, gzip.decompress(data), gzip.compress(gzip.decompress(data))):
        got = list(warc.parse_warc(content))
        assert [tuple(r[k] for k in ("record_id", "record_type", "url", "date", "profile", "status", "headers", "body")) for r in got] == rows
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "cut.warc").write_bytes(gzip.decompress(data)[:-9])
    assert warc.read_records(spark, str(tmp_path)).count() == 5


def _brute(rows):
    """Latest earlier full response with the same url, validators, headers."""
    out = {}
    for r in (r for r in rows if r[1] == "revisit"):
        if r[4] != warc.NOT_MODIFIED:
            out[r[0]] = ("not_applicable", None, None)
            continue
        before = [q for q in rows if q[1] == "response" and q[5] == 200 and r[2] is not None and q[2] == r[2] and ((q[3] or "", q[0]) < (r[3] or "", r[0]))]
        if not before:
            out[r[0]] = ("no_response", None, None)
            continue
        q = max(before, key=lambda q: (q[3] or "", q[0]))
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        new, old = low(r[6]), low(q[6])
        if "etag" in new and "etag" in old and not new["etag"].startswith("W/") and not old["etag"].startswith("W/"):
            fits = new["etag"] == old["etag"]
        elif "last-modified" in new and "last-modified" in old:
            fits = new["last-modified"] == old["last-modified"]
        else:
            fits = "etag" in new and new["etag"] == old.get("etag")
        merged = old | {k: v for k, v in new.items() if k not in warc.KEPT_FIELDS}
        out[r[0]] = ("resolved", q[0], merged) if fits else ("validator_mismatch", q[0], None)
    return out


def test_revisits_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        url = rng.choice(["h/hot"] * 6 + ["h/a", "h/b", "h/c", None])
        headers = {k: rng.choice(v) for k, v in {"ETag": ['"1"', '"2"', "W/x"], "Last-Modified": ["m", "n"], "Content-Length": ["1", "2"], "X-Y": ["p", "q"]}.items() if rng.random() < 0.6}
        date = rng.choice([None, *(f"2024-01-{d:02d}" for d in range(1, 29))])
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append(_record(f"r{i:04d}", kind, url, date, headers or None, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([warc.NOT_MODIFIED] * 5 + ["other"])))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], warc.RECORD + ", canon string, part int")
    for size in (7, 100_000):  # many range partitions, one
        got = {r["record_id"]: (r["state"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(frame, size).collect()}
        assert got == _brute(rows)
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/a/#f", "https://example.com/a", "example.com/a/?", "http://example.com", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a", "example.com/a", "example.com/a/?", "example.com", None, ""]


def test_pipeline_stages_decide(spark, tmp_path):
    """Each stage against its brute-force version on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_dedup", "mixing", "packing"]
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name + "_in"] = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == frames["language_id_in"].columns
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert texts(frames["quality_in"]) == texts(frames["language_id_in"])  # all of them are in a learned language
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in frames["near_dedup_in"].collect()}
    good = [i for i in marks if marks[i] == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i not in kept for i in marks if marks[i] == 0) >= 0.8 * sum(m == 0 for m in marks.values())
    before = texts(frames["near_dedup_in"])
    truth = brute_classes(before)
    assert texts(frames["mixing_in"]) == [r for r in before if truth[r[0]] == r[0]]
    size = lambda t: len(t.split())
    source = {r["doc_id"]: (r["source"], size(r["text"])) for r in frames["mixing_in"].collect()}
    sizes, taken = {}, {}
    for s, n in source.values():
        sizes[s] = sizes.get(s, 0) + n
    for r in frames["packing_in"].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    for s, goal in _fill(sizes).items():
        assert abs(taken.get(s, 0) - goal) <= max(n for t, n in source.values() if t == s) / 2 + 1e-6
    packed = docs.collect()
    assert sum(r["length"] for r in packed if r["piece"] == 0) > 0
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in frames["packing_in"].collect()}
    # the result is the corpus: every repetition's token ids, whole and in order
    encode, made = encoder(default_vocabulary()), {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        made.setdefault((r["doc_id"], r["doc_row"]), []).extend(r["ids"])
    want = sorted((r["doc_id"], [*encode(r["text"] or "").tolist(), 0]) for r in frames["packing_in"].select("doc_id", "text").collect())
    assert sorted((i, ids) for (i, _), ids in made.items()) == want


def test_language_stage_drops_foreign_documents(spark):
    """Planted documents in a language that none of the rows has, a few sentences and 20,000 words long."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    latin = "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. "
    planted = [(-1, latin * 3), (-2, latin * 1000), (-3, "\u0395\u03bd \u03b1\u03c1\u03c7\u03ae \u03ae\u03bd \u03bf \u03bb\u03cc\u03b3\u03bf\u03c2 " * 900), (-4, "12 34 " * 90), (-5, None)]
    more = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text")])
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(more), "")
    assert kept.columns == docs.columns and kept.where("doc_id < 0").count() == 0
    assert kept.count() >= 0.99 * docs.count()


def test_a_run_goes_on_where_an_earlier_one_ended(spark, tmp_path, monkeypatch):
    done = []

    def stage(name):
        def work(spark, docs, sf_dir):
            done.append(name)
            if name == "b" and done.count("b") == 1:
                raise RuntimeError("lost")
            return settle(docs.where(f"doc_id % {len(name) + 1} = 0"))

        return work

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in "abc"])
    folder = str(tmp_path / "run")
    try:
        corpus_pipeline.run(spark, "/root/testdata/sf0.001", folder)
    except RuntimeError:
        pass
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001", folder)
    assert done == ["a", "b", "b", "c"] and out.count() == 100
    with pytest.raises(ValueError, match="another table"):
        corpus_pipeline.run(spark, "/root/testdata/sf0.01", folder)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, and one of nulls, repeated rows and a document of some thousand pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, rows in (("none", docs.limit(0)), ("odd", docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", None, 0), (900_002, "", "en", "s", 0), (900_003, "12 34", "fr", "s", 5)], docs.schema)))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}
        got = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        assert bool(got) == (name == "odd") and not got & {None, 900_001, 900_002, 900_003}


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "rankforge").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
