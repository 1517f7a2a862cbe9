"""Secret scans: spans against Python's regular expressions, and what the ledger spares."""

import hashlib
import random
import re
import uuid

import pytest

from rankforge.llm import secrets

DOC = "doc_id long, text string"
PATTERNS = {  # as the contract words them
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(PATTERNS.values()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(found)


def _texts(rng, n):
    bits = ["token", "PassWord", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "X" * 12, "é", "ab", "\U0001f600", "\n", "ſecret", "a" * 15, "Z9", "_", "-"]
    for _ in range(n):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


@pytest.fixture
def ledger(tmp_path):
    return f"{tmp_path}/ledger-{uuid.uuid4().hex}"


def test_spans_equal_python(spark, ledger):
    texts = list(_texts(random.Random(2), 3000))
    texts += ["token: secret: " + "x" * 20, "password=" + "q" * 11, "token = 'AKIA" + "Z" * 20 + "'", "f" * 15, "f" * 16 + "g" + "0" * 17, "AKIA", "AKIAAKIA" + "A" * 9, "AKIAAKIA" + "A" * 10]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(rows, DOC).repartition(4), ledger).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(map(bool, got.values())) > 300


def test_query_digests(spark, tmp_path):
    rows = [(1, 'k api_key="abcdefghijkl0123456789abcdef" '), (1, 'k api_key="abcdefghijkl0123456789abcdef" '), (2, None), (None, "AKIA" + "Q" * 14), (3, "")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOC}, spans string, blob int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secrets.query(spark, str(tmp_path)).collect()), key=str)

    def row(i, t):
        kinds = [list(PATTERNS)[k] for _, k, _ in brute(t)]
        spans = ",".join(f"{k}:{s}:{e}" for (s, _, e), k in zip(brute(t), kinds, strict=True))
        return (i, *(kinds.count(k) for k in PATTERNS), hashlib.sha256(spans.encode()).hexdigest(), spans)

    assert got == sorted((row(*r) for r in rows), key=str)


def test_only_unseen_pairs_are_scanned(spark, ledger):
    first = spark.createDataFrame([("a.txt", 1, "token=abcdefghijklm"), ("b.txt", 1, "token=abcdefghijklm"), ("c.txt", 1, "nothing")], "path string, version int, text string")
    key = ("path", "version")
    secrets.scan(first, ledger, key).collect()
    ledger_rows = lambda: sorted((len(r["spans"]), sorted(r["rules"])) for r in secrets.read_ledger(spark, ledger).collect())
    every = sorted(r.name for r in secrets.RULES)
    assert ledger_rows() == [(0, every), (1, every)]  # two blobs of three versions

    # a new version with known content adds nothing, one with new content adds its blob
    second = first.unionByName(spark.createDataFrame([("c.txt", 2, "token=abcdefghijklm"), ("d.txt", 1, "0123456789abcdef0")], first.schema))
    got = {(r["path"], r["version"]): [tuple(s) for s in r["spans"]] for r in secrets.scan(second, ledger, key).collect()}
    assert got == {("a.txt", 1): [(0, 0, 19)], ("b.txt", 1): [(0, 0, 19)], ("c.txt", 1): [], ("c.txt", 2): [(0, 0, 19)], ("d.txt", 1): [(0, 2, 17)]}
    assert ledger_rows() == [(0, every), (1, every), (1, every)]

    # a new version of one rule is applied to every blob, alone; what its old version found is no longer shown
    rules = (*secrets.RULES[:2], secrets.RULES[2]._replace(version=2, pattern="[0-9a-f]{17,}", least=17), secrets.Rule("word", 1, "nothing", 0, 1))
    got = {(r["path"], r["version"]): [tuple(s) for s in r["spans"]] for r in secrets.scan(second, ledger, key, rules).collect()}
    assert got[("d.txt", 1)] == [(0, 2, 17)] and got[("c.txt", 1)] == [(0, 3, 7)] and got[("c.txt", 2)] == [(0, 0, 19)]
    assert ledger_rows() == [(0, every), (0, ["hex@2", "word@1"]), (1, every), (1, every), (1, ["hex@2", "word@1"]), (1, ["hex@2", "word@1"])]
    # and the first rules find theirs without a scan
    before = len(ledger_rows())
    got = {(r["path"], r["version"]): [tuple(s) for s in r["spans"]] for r in secrets.scan(second, ledger, key).collect()}
    assert got[("c.txt", 1)] == [] and got[("d.txt", 1)] == [(0, 2, 17)] and len(ledger_rows()) == before


def test_rows_added_twice_count_once(spark, ledger):
    docs = spark.createDataFrame([(1, "token=abcdefghijklm 0123456789abcdef"), (2, "-")], DOC)
    want = sorted(map(tuple, secrets.scan(docs, ledger).collect()))
    secrets.read_ledger(spark, ledger).write.mode("append").parquet(ledger)
    assert sorted(map(tuple, secrets.scan(docs, ledger).collect())) == want


def test_long_texts_many_matches_and_odd_tables(spark, ledger):
    many = " ".join(f"{i:016x}" for i in range(30_000))
    long = "word " * 400_000 + "token=abcdefghijklm"
    docs = spark.createDataFrame([(1, many), (2, long), (3, "z" * 3_000_000)], f"{DOC}")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, ledger).collect()}
    assert len(got[1]) == 30_000 and tuple(got[1][-1]) == (29_999 * 17, 2, 29_999 * 17 + 16)
    assert [tuple(s) for s in got[2]] == [(2_000_000, 0, 2_000_019)] and got[3] == []
    assert secrets.scan(spark.createDataFrame([], DOC), ledger).collect() == []


def test_no_python_in_the_plan(spark, ledger):
    docs = spark.createDataFrame([(1, "token=abcdefghijklm")], DOC)
    plan = secrets.scan(docs, ledger)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
