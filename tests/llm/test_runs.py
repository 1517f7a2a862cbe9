"""Periodic runs: every run of small texts against brute force, digests, odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rankforge.llm import runs

DOC = "doc_id long, text string"


def brute(w, least=6, times=4):
    """All (start, length, period), stretch by stretch."""
    n, out = len(w), []
    for s in range(n):
        for e in range(s + least, n + 1):
            for q in range(1, (e - s) // times + 1):
                if all(w[i] == w[i + q] for i in range(s, e - q)):
                    if (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q]):
                        out.append((s, e - s, q))
                    break
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(rng, n):
    for _ in range(n):
        kinds, size = rng.choice([1, 2, 2, 3]), rng.randint(0, 36)
        w = [rng.randrange(kinds) for _ in range(size)]
        if rng.random() < 0.5 and size > 8:
            a, p = rng.randrange(size), rng.randint(1, 4)
            w[a:] = [w[a + (i - a) % p] for i in range(a, size)]
        yield w


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_all_runs_of_joined_texts_equal_brute_force(least, times):
    texts = list(_texts(random.Random(least), 400))
    for pairs in (1, 50, 1 << 20):
        got = runs.find_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least, times, pairs)
        assert list(map(tuple, got.tolist())) == [(k, *r) for k, t in enumerate(texts) for r in brute(t, least, times)]


def test_a_wrong_hash_is_noticed(monkeypatch):
    """With a hash that takes everything for equal at first, the words decide."""
    true, calls = runs.PrefixHash, []

    class Blind(true):
        def __init__(self, words, seed):
            super().__init__(words, seed)
            self.seed = seed
            calls.append(seed)

        def equal(self, at, apart, length):
            return super().equal(at, apart, length) if self.seed else np.ones(len(at), bool)

    monkeypatch.setattr(runs, "PrefixHash", Blind)
    words = np.array([5, 6, 1, 2, 1, 2, 1, 2, 1, 2, 7, 8])
    assert runs.find_runs(words, np.array([12])).tolist() == [[0, 2, 8, 2]]
    assert calls == [0, 1]


def test_long_periodic_texts_are_whole():
    for w, want in [(np.zeros(300_000, np.int64), (0, 300_000, 1)), (np.arange(300_001) % 70_000, (0, 300_001, 70_000)), (np.concatenate([np.arange(1000) + 9, np.arange(90_000) % 7]), (1000, 90_000, 7))]:
        assert runs.find_runs(w, np.array([len(w)])).tolist() == [[0, *want]]


def _expected(doc_id, text):
    """The contract's row in plain Python."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t  "]).join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))), "x") for i in range(150)]
    rows += [(200, None, None), (201, "", "x"), (202, "a " * 30, "x"), (202, "a " * 30, "x"), (203, "é b " * 9, "x"), (204, "q" * 100_000, "y")]
    rows = [(i, t, s) for i, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((_expected(i, t) for i, t, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, _ in rows)


def test_columns_and_odd_tables(spark):
    odd = spark.createDataFrame([(None, "x x x x x x y", "r", 1), (1, None, None, 2)], f"{DOC}, runs string, n_words int")
    got = {r["doc_id"]: r for r in runs.detect(odd).collect()}
    assert got[None]["runs"] == [(0, 6, 1)] and got[None]["collapsed"] == "x y" and got[None]["strongest"] == (0, 6, 1)
    assert (got[1]["n_words"], got[1]["runs"], got[1]["strongest"], got[1]["collapsed"]) == (0, [], None, "")
    assert runs.detect(spark.createDataFrame([], DOC)).collect() == []
    long = spark.createDataFrame([(7, "one two three " * 200_000)], DOC)
    assert runs.detect(long).select("n_words", "runs", "collapsed").first() == (600_000, [(0, 600_000, 3)], "one two three")
