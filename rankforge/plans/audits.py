"""Documents, byte-exact files and audits as queries: each builds its documents from the small tables and then reads or checks them."""

from __future__ import annotations

import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.operators import contracts, documents
from rankforge.plans import benchmark
from rankforge.plans.base import query, scored
from rankforge.plans.io import _folder
from rankforge.session import rounded, table
from rankforge.sources import readers, sinks


def _rows(spark: SparkSession, sf: str, name: str, order: str) -> list[dict]:
    """The rows of `region` or `nation`, tables of fixed size."""
    return [r.asDict() for r in table(spark, sf, name).orderBy(order).collect()]


def _checks(spark: SparkSession, checks: list[documents.Check]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.status) for c in checks], "name string, status string")


@query(
    "c02_model_registry",
    """SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 1 OR n_nationkey % 7 = 2 OR (n_nationkey % 2 = 0 AND (n_nationkey % 3 = 2 OR n_nationkey % 4 = 0)) THEN 'FAIL' ELSE 'PASS' END AS status
FROM nation""",
)
def c02(spark: SparkSession, sf: str) -> DataFrame:
    """Registry entries with some licences missing, some states misspelt and some defaults without provenance."""
    entries = []
    for r in _rows(spark, sf, "nation", "n_nationkey"):
        k = r["n_nationkey"]
        entry = {
            "model_id": r["n_name"], "family": "f", "checkpoint_identifier": f"c{k}", "version": "1", "licence": "MIT", "documented_pretraining_corpora": [] if k % 4 == 0 else ["corpus"],
            "leakage_status": "CLEAN" if k % 7 == 2 else documents.LEAKAGE_STATES[k % 3], "availability": "AVAILABLE", "enabled_by_default": k % 2 == 0, "parameter_count": None,
        }
        if k % 5 == 1:
            del entry["licence"]
        entries.append(entry)
    return _checks(spark, documents.check_registry(entries))


@query(
    "c05_sealed_bundle",
    """SELECT 'file ' || r_name || '.json' AS name, CASE WHEN r_regionkey = 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM region
UNION ALL SELECT 'undeclared extra.json', 'FAIL'
UNION ALL SELECT 'total nations', CASE WHEN count(*) = 25 THEN 'PASS' ELSE 'FAIL' END FROM nation
UNION ALL SELECT 'total regions', CASE WHEN count(*) = 6 THEN 'PASS' ELSE 'WARNING' END FROM region
UNION ALL SELECT unnest(['interval order', 'conclusion', 'single holdout access']), 'PASS'""",
)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle of one file per region: one file changed after sealing, one never declared, one total that is known to differ."""
    files = {f"{r['r_name']}.json": sinks.canonical_json(r) for r in _rows(spark, sf, "region", "r_regionkey")}
    manifest = {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}
    changed = next(n for n, data in files.items() if json.loads(data)["r_regionkey"] == 2)
    files[changed] += b" "
    files["extra.json"] = b"{}"
    totals = {"nations": table(spark, sf, "nation").count(), "regions": table(spark, sf, "region").count()}
    summary = {"nations": 25, "regions": 6, "lower": -0.1, "delta": 0.2, "upper": 0.3, "conclusion": "NOT_SUPPORTED", "holdout_access_count": 1}
    return _checks(spark, documents.check_bundle(files, manifest, totals, summary, tolerated=["regions"]))


@query(
    "c08_traced_claims",
    """SELECT 'summary.json:regions.' || r_regionkey || '.n' AS name, CASE WHEN r_regionkey = 3 THEN 'FAIL' ELSE 'PASS' END AS status FROM region
UNION ALL SELECT 'summary.json:share', 'PASS' UNION ALL SELECT 'missing.json:n', 'FAIL'""",
)
def c08(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of a text against a document in the shared folder; one is wrong, one names no document."""
    folder, counts = _folder(spark), {}
    for r in _rows(spark, sf, "nation", "n_nationkey"):
        counts[r["n_regionkey"]] = counts.get(r["n_regionkey"], 0) + 1
    summary = {"regions": [{"n": counts.get(k, 0)} for k in range(5)], "share": 1 / 3}
    sinks.put_bytes(spark, sinks.canonical_json(summary), f"{folder}/summary.json")
    said = [(f"regions.{k}.n", counts.get(k, 0) + (k == 3)) for k in range(5)] + [("share", 0.3333333)]
    text = "\n".join(f"so many <!-- claim file=summary.json path={path} value={value} -->" for path, value in said) + "<!-- claim file=missing.json path=n value=1 -->"
    held = {"summary.json": readers.read_document(spark, f"{folder}/summary.json")}
    return _checks(spark, documents.check_claims(text, held.__getitem__))


@query(
    "c09_external_vectors",
    """WITH wanted AS (SELECT DISTINCT l_partkey AS id FROM lineitem), got AS (SELECT vec_id AS id, embedding FROM embeddings)
SELECT 'missing' AS name, count(*) FILTER (got.id IS NULL) AS bad_rows, CASE WHEN count(*) FILTER (got.id IS NULL) = 0 THEN 'PASS' ELSE 'WARNING' END AS status FROM wanted LEFT JOIN got USING (id)
UNION ALL SELECT 'width', count(*) FILTER (len(embedding) <> w), CASE WHEN count(*) FILTER (len(embedding) <> w) = 0 THEN 'PASS' ELSE 'FAIL' END FROM got, (SELECT mode(len(embedding)) AS w FROM got)
UNION ALL SELECT 'finite', count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0), 'PASS' FROM got
UNION ALL SELECT 'unique_id', count(*) - count(DISTINCT id), 'PASS' FROM got""",
)
def c09(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of vectors from outside as counts: coverage of the entities, width, finite values, unique ids."""
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    got = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    covered = contracts.violations(wanted.join(got.select("id", F.lit(True).alias("has")), "id", "left"), {"missing": F.col("has").isNull()})
    infinite = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    width = got.agg(F.mode(F.size("embedding"))).first()[0]
    shaped = contracts.violations(got, {"width": F.size("embedding") != F.lit(width), "finite": infinite})
    return contracts.judged(covered.unionByName(shaped).unionByName(contracts.repeats(got, ["id"], "unique_id")), warnings=["missing"])


@query(
    "c11_claims",
    """WITH s AS (SELECT source, count(*) % 3 AS m FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT 'permitted' AS kind, count(*) FILTER (m = 0) AS n FROM s UNION ALL SELECT 'conditional', count(*) FILTER (m = 1) FROM s UNION ALL SELECT 'unsupported', count(*) FILTER (m = 2) + 1 FROM s""",
)
def c11(spark: SparkSession, sf: str) -> DataFrame:
    """What the comparison states of the sources, here by their numbers of documents, permit to be said."""
    m = F.count(F.lit(1)) % 3
    state = F.when(m == 0, "DETECTABLE_GAIN").when(m == 1, "NO_DETECTABLE_DIFFERENCE").otherwise("NOT_COMPUTED")
    states = table(spark, sf, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("method")).agg(state.alias("state"))
    said = benchmark.claims(states.unionByName(spark.createDataFrame([(benchmark.REFERENCE, "NO_DETECTABLE_DIFFERENCE")], "method string, state string")))
    return spark.createDataFrame([(kind, len(items)) for kind, items in said.items()], "kind string, n long")


@query("c12_single_holdout_access", "SELECT lang, CAST(count(*) % 3 + 1 AS INTEGER) AS accesses, CASE WHEN count(*) % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    """A holdout for each language, looked at once or more often, as its number of documents says."""
    docs, seen = table(spark, sf, "documents"), []
    for r in docs.where("lang IS NOT NULL").groupBy("lang").agg((F.count(F.lit(1)) % 3 + 1).alias("looks")).collect():  # a row for each language
        holdout = benchmark.Holdout(docs.where(F.col("lang") == r["lang"]))
        for _ in range(r["looks"]):
            holdout.read()
        seen.append((r["lang"], holdout.accesses, "PASS" if holdout.accesses == 1 else "FAIL"))
    return spark.createDataFrame(seen, "lang string, accesses int, status string")


@query("k02_byte_stable_gzip", "SELECT sha256(string_agg(line, '' ORDER BY k)) AS digest, TRUE AS stable FROM (SELECT -1 AS k, 'n_nationkey,n_name' || chr(10) AS line UNION ALL SELECT n_nationkey, n_nationkey || ',' || n_name || chr(10) FROM nation)")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows in another layout give the same file, byte by byte."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    first, again = (sinks.csv_bytes(x, ["n_nationkey"], zipped=True) for x in (rows, rows.repartition(3)))
    folder = _folder(spark)
    sinks.put_bytes(spark, first, f"{folder}/nation.csv.gz")
    lines = spark.read.text(f"{folder}/nation.csv.gz", wholetext=True)
    return lines.select(F.sha2("value", 256).alias("digest"), F.lit(first == again).alias("stable"))


@query("k07_markdown_report", "SELECT '| ' || r_name || ' | ' || r_regionkey || ' |' AS line FROM region UNION ALL SELECT unnest(['# Regions', '', '| method | value |', '|---|---|', '', '## Permitted', '', '- all of it'])")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    rows = table(spark, sf, "region").select(F.col("r_name").alias("method"), F.col("r_regionkey").alias("value"))
    sinks.put_bytes(spark, sinks.report(rows, {"permitted": ["all of it"]}, "Regions").encode(), f"{folder}/report.md")
    return spark.read.text(f"{folder}/report.md").select(F.col("value").alias("line"))


@query("s11_sparse_npz", "SELECT n_regionkey::BIGINT AS row, n_nationkey::BIGINT AS col, n_nationkey + 0.5::DOUBLE AS value FROM nation")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by nations as a compressed sparse matrix."""
    import numpy as np

    cells = sorted((r["n_regionkey"], r["n_nationkey"]) for r in _rows(spark, sf, "nation", "n_nationkey"))
    row, col = np.array(cells).T
    held = io.BytesIO()
    np.savez_compressed(held, indptr=np.searchsorted(row, np.arange(row.max() + 2)), indices=col, data=col + 0.5, shape=(row.max() + 1, col.max() + 1))
    path = f"{_folder(spark)}/cells.npz"
    sinks.put_bytes(spark, held.getvalue(), path)
    return readers.sparse_npz(spark, path)


@query("s17_vector_pair", "SELECT vec_id, len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[1]::DOUBLE + 100, 6) AS control FROM embeddings")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    """A sealed pair of matrices, the vector and its control in the row instead of by position."""
    path = f"{_folder(spark)}/pair"
    rows = table(spark, sf, "embeddings")
    sinks.seal(rows.select("vec_id", "embedding", F.transform("embedding", lambda x: x.cast("double") + 100).alias("control")), path, "vector_pair")
    if sinks.verify_seal(spark, path):
        raise ValueError("the pair differs from its seal")
    pair = spark.read.parquet(f"{path}/data")
    return pair.select("vec_id", F.size("embedding").alias("width"), rounded(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), rounded(F.get("control", F.lit(0)), 6).alias("control"))


@query("s18_dictionaries", "SELECT n_nationkey, r_name AS region, CASE WHEN n_regionkey % 2 = 0 THEN 'even' END AS parity FROM nation JOIN region ON n_regionkey = r_regionkey")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary document (one entry per region) as a broadcast side; keys that it lacks give null."""
    folder = _folder(spark)
    names = {str(r["r_regionkey"]): r["r_name"] for r in _rows(spark, sf, "region", "r_regionkey")}
    sinks.put_bytes(spark, sinks.canonical_json({"region": names, "parity": {k: "even" for k in names if int(k) % 2 == 0}}), f"{folder}/names.json")
    out = table(spark, sf, "nation").withColumn("k", F.col("n_regionkey").cast("string"))
    for name, entries in readers.read_document(spark, f"{folder}/names.json").items():
        side = spark.createDataFrame(list(entries.items()), f"k string, {name} string")
        out = out.join(F.broadcast(side), "k", "left")
    return out.select("n_nationkey", "region", "parity")


@query("s19_document_scan", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/regions.json"
    sinks.put_bytes(spark, sinks.canonical_json({"regions": [{"key": r["r_regionkey"], "name": r["r_name"]} for r in _rows(spark, sf, "region", "r_regionkey")]}), path)
    return spark.createDataFrame([(r["key"], r["name"]) for r in readers.read_document(spark, path)["regions"]], "key long, name string")


@query("s20_unique_file", "SELECT r_name AS name, TRUE AS found FROM region UNION ALL SELECT 'twice', FALSE UNION ALL SELECT 'nowhere', FALSE")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    """One file per region in a folder of its own, and a name that stands in two folders."""
    folder = _folder(spark)
    names = [r["r_name"] for r in _rows(spark, sf, "region", "r_regionkey")]
    for i, name in enumerate(names):
        sinks.put_bytes(spark, name.encode(), f"{folder}/d{i}/{name.replace(' ', '_')}.txt")
    for i in range(2):
        sinks.put_bytes(spark, b"x", f"{folder}/d{i}/twice.txt")

    def found(name: str) -> bool:
        try:
            return bool(readers.find_unique(spark, folder, f"{name.replace(' ', '_')}.txt"))
        except ValueError:
            return False

    return spark.createDataFrame([(n, found(n)) for n in [*names, "twice", "nowhere"]], "name string, found boolean")


@query("s21_split_file_parts", "SELECT r_regionkey AS ord, 'part' || r_regionkey AS name, r_regionkey NOT IN (2, 4) AS ok FROM region")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a split file against their manifest: one has a suffix, one has changed, one is missing."""
    folder, parts = _folder(spark), []
    for r in _rows(spark, sf, "region", "r_regionkey"):
        k, data = r["r_regionkey"], sinks.canonical_json(r)
        parts.append({"part_name": f"part{k}", "part_size": len(data), "part_sha256": hashlib.sha256(data).hexdigest()})
        if k != 4:
            sinks.put_bytes(spark, data.swapcase() if k == 2 else data, f"{folder}/parts/part{k}" + (".bin" if k == 1 else ""))
    return readers.check_parts(spark, f"{folder}/parts", {"original_name": "region", "chunks": parts})


@query(
    "x03_window_extension",
    """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, ntile(4) OVER w::INTEGER AS quarter, round(cume_dist() OVER w, 9) AS share,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def x03(spark: SparkSession, sf: str) -> DataFrame:
    """Lag, lead, ntile, cume_dist and a moving frame, which the audit itself does not need."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.round(F.cume_dist().over(w), 9).alias("share"),
        F.max("value").over(w.rowsBetween(-2, 0)).alias("recent"),
    )
