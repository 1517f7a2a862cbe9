"""Near-duplicates against brute force, and the pieces of the method."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import dedup
from rankforge.llm.common import settle
from rankforge.llm.components import components
from rankforge.llm.minhash import band_keys, signatures
from rankforge.llm.words import CHUNK, shingles, words_of

DOC = "doc_id long, text string, lang string, source string, node string"


def _grams(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def _similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """doc_id -> least doc_id of its class, for rows (doc_id, text) with distinct ids."""
    sets = {i: _grams(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i, _ in rows if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i].keys() & sets[j].keys() and _similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def _mutate(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.random()) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(12):  # groups of near copies around the threshold, and passages that several share
        base = [word() for _ in range(rng.randint(30, 300))]
        texts += [" ".join(base)] + [" ".join(_mutate(rng, base, rng.choice([0.005, 0.02, 0.03, 0.05]))) for _ in range(rng.choice([1, 3, 25]))]
        texts += [" ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]) for _ in range(3)]
    texts += ["one two three", "ONE  two\nthree", "one two four", "a", "", " \n", None, "line of words here again\n" * 40, "line of words here again\n" * 41, "line of words here again\n" * 90]
    rng.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


def test_classes_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame([(*r, "en", "s", "x") for r in corpus], DOC)
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(docs).select("doc_id", "class_id").collect()}
    assert got == brute_classes(corpus)


def _copies(rng, n, words, changed):
    """n texts, each the same text with `changed` words of its own."""
    base, out = [f"w{rng.randrange(5000)}" for _ in range(words)], []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), changed):
            own[at] = f"v{i}x{at}"
        out.append(" ".join(own))
    return out


def test_large_group_just_below_the_similarity(spark):
    """Copies that are pairwise at 0.6 to 0.79, and the links that a few pairs have: whole, and without all pairs."""
    rng = random.Random(5)
    texts = _copies(rng, 700, 150, 2)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOC)
    made = settle(dedup.describe(docs))
    nodes = settle(made.groupBy("node").agg(F.max("weight").alias("weight"), F.any_value("bands").alias("bands")).select("*", F.monotonically_increasing_id().alias("id"), F.xxhash64("node").alias("draw")))
    members = dedup._members(nodes)
    sets = dedup._sets(docs, made.select("doc_id", "tag", "node"), nodes.select("id", "node"), 5)
    pivots = members.groupBy("key").agg(F.max("rank").alias("top")).select("key", F.col("top.id").alias("p"))
    compared = dedup._differences(members, pivots, sets, 0.8)
    assert compared.where("NOT linked").count() > 300  # a pivot alone doesn't do it
    left = dedup._open_pairs(compared.withColumn("part", F.col("u")), 0.8).count()
    assert left < 0.05 * len(rows) ** 2 / 2, left
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(docs).select("doc_id", "class_id").collect()}
    assert got == brute_classes(rows)


def test_open_pairs_hold_every_link(spark, corpus):
    """With no link of a pivot used, the difference sets alone must leave all links of nodes with a common pivot."""
    sets = {i: {(g, k) for g, n in _grams(t).items() for k in range(n)} for i, t in corpus if _grams(t)}
    ids = sorted(sets)
    number = {}
    code = lambda s: sorted(number.setdefault(e, len(number) + 1) for e in s)
    rows, wanted = [], set()
    for p in ids[:6]:
        group = [u for u in ids if u != p]
        for u in group:
            apart = code(sets[u] - sets[p]) + [-e for e in code(sets[p] - sets[u])]
            linked = len(apart) <= (len(sets[u]) + len(sets[p])) / 9 + 1e-9
            if apart:
                rows.append((p, u, p if linked else u, len(sets[u]), len(sets[p]), len(apart), linked, apart))
        for i, u in enumerate(group):
            for v in group[:i]:
                both, size = len(sets[u] & sets[v]), len(sets[u]) + len(sets[v])
                links = [len(sets[x] ^ sets[p]) <= (len(sets[x]) + len(sets[p])) / 9 + 1e-9 for x in (u, v)]
                if both and size - 2 * both <= size / 9 + 1e-9 and not all(links) and sets[u] != sets[p] != sets[v]:
                    wanted.add((min(u, v), max(u, v)))
    frame = spark.createDataFrame(rows, "p long, u long, part long, size int, p_size int, d int, linked boolean, apart array<long>")
    got = {(r["u"], r["v"]) for r in dedup._open_pairs(frame, 0.8).collect()}
    assert wanted and wanted <= got


def test_keep_one(spark, corpus):
    # repeated rows, a shared id with other text, null ids and rows without words
    rows = [*corpus, corpus[0], corpus[0], (corpus[0][0], "quite another text under the same id"), (None, "nameless text of some five words"), (None, "nameless text of some five words"), (900_001, None), (900_001, None)]
    docs = spark.createDataFrame([(*r, "en", "s", "x") for r in rows], DOC)
    kept = dedup.keep_one(docs)
    assert kept.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    truth = brute_classes(corpus)
    want = [r for r in corpus if truth[r[0]] == r[0]] + [(corpus[0][0], "quite another text under the same id"), (None, "nameless text of some five words"), (900_001, None), (900_001, None)]
    assert got == sorted(want, key=str)


def test_keep_one_with_columns_of_its_own_names(spark):
    text = "one two three four five six seven"
    names = ["__row_id", "__row_tag", "__tag", "id", "of", "tag", "row", "n", "is_first", "root", "kept_id"]
    rows = [(1, text), (1, text), (2, text), (3, "quite another text of seven words here")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert dedup.classes(empty).count() == 0 and dedup.keep_one(empty).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], DOC)
    assert sorted((r["doc_id"], r["class_id"]) for r in dedup.classes(alone).collect()) == [(1, 1), (2, 2)]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.choice([0.5, 1.0, 2.0, 7.3], 300), rng.choice([0.5, 1.0, 2.0, 7.3], 300)
    a[:60] = 1e-9
    used = [keys, keys], [a, b]
    k = 2048
    made = signatures(np.repeat([0, 1], 300), np.concatenate(used[0]), np.concatenate(used[1]), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((made[0] == made[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 2, 30, 5000)]
    together = signatures(np.repeat(np.arange(4), [len(s) for s in sets]), np.concatenate(sets), np.ones(sum(map(len, sets))), 4, 144)
    for i, s in enumerate(sets):
        alone = signatures(np.zeros(len(s), int), s, np.ones(len(s)), 1, 144)
        assert (alone[0] == together[i]).all()
    assert band_keys(together, 24).shape == (4, 24)


def test_words_and_shingles():
    assert len(words_of("")) == 0 and len(words_of(" a\tb\nc ")) == 3
    assert (words_of("Ab cD") == words_of("aB  cd")).all()
    long = " ".join(f"w{i}" for i in range(400_000)) + " " + "x" * (2 * CHUNK)
    hashes = words_of(long)
    assert len(hashes) == len(set(hashes.tolist())) == 400_001
    assert hashes[123_456] == words_of("w123456")[0] and hashes[-1] == words_of("x" * (2 * CHUNK))[0]
    assert len(shingles(words_of("a b c d e f"))) == 2 and len(shingles(words_of("a b"))) == 1 and len(shingles(words_of(""))) == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(500, i) for i in range(501, 560)] + [(7, 7), (0, 1), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == find(i) for i in list(root))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
