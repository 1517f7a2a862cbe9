"""URL filters, mixing, chat formatting, packing: fixtures, round trips, brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rankforge.llm import chat, mixing, packing, url_filter
from rankforge.llm.tokens import default_vocabulary, encoder
from rankforge.llm.url_filter import UrlTrie

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# URL filters


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://WWW.Example.com/en/a?x#y", ("www.example.com", "/en/a")), ("http://a.b", ("a.b", "")), ("a.b/c", ("", "")), (None, ("", "")), ("", ("", "")),
        ("x://h?q/r", ("h", "")), ("x://h#f", ("h", "")), ("x:///p", ("", "/p")), ("s://h/a://b", ("h", "/a://b")), ("s://ÄX.net/es/", ("Äx.net", "/es/")),
    ],
)
def test_split_url(url, expected):
    assert url_filter.split_url(url) == expected


def _brute(rules, host, path):
    fits = [r for r in rules if (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return None
    most = max(fits, key=lambda r: (len(r[0].split(".")) if r[0] else 0, len(r[1]), r[2] == "block"))
    return most[0] + most[1], most[2]


def test_trie_agrees_with_brute_force():
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "ab", "c"])
    host = lambda: ".".join(part() for _ in range(rng.randint(1, 3)))
    path = lambda: rng.choice(["", "/", "/" + "/".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", "/"])])
    for _ in range(30):
        rules = [(rng.choice([host(), ""]), path(), rng.choice(["allow", "block"])) for _ in range(25)]
        trie = url_filter.UrlTrie(rules)
        for _ in range(60):
            h, p = host(), path()
            assert trie.match(h, p) == _brute(rules, h, p)


def test_url_filter_rows(spark):
    rows = [(1, "https://x.example.com/en/"), (1, "https://x.example.com/en/"), (2, None), (None, "ftp://a.net/fr/x"), (3, "http://www.example.com/en/q"), (4, "h://net")]
    out = url_filter.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string"))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(
        [(1, "x.example.com", "/en/", "example.com/en/", "block")] * 2
        + [(2, "", "", None, "allow"), (None, "a.net", "/fr/x", "net/fr/", "block"), (3, "www.example.com", "/en/q", "www.example.com/en/", "allow"), (4, "net", "", None, "allow")],
        key=str,
    )
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# mixing


def test_many_rules_on_one_parent_and_long_urls():
    rng = random.Random(9)
    rules = [("big.org", "/d/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), rng.choice(["allow", "block"])) for _ in range(3000)]
    trie = UrlTrie(rules)
    verdict = {}
    for host, path, what in rules:
        verdict[host + path] = "block" if "block" in (what, verdict.get(host + path)) else "allow"
    for _ in range(500):
        path = "/d/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) + rng.choice(["", "/x/y", "/" * 50_000])
        want = max((r for r in verdict if ("big.org" + path).startswith(r)), key=len)
        assert trie.match("a.big.org", path) == (want, verdict[want])
    assert trie.match("big.org", "/e") is None
    assert trie.match(".".join(["x"] * 20_000) + ".big.org", "/d/ab" + "z" * 100_000) is not None


def _fill(sizes, share=1.5, epochs=2.0):
    """Water-filling round by round, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, clamped, total = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        goal = {s: epochs * sizes[s] for s in clamped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if goal[s] > epochs * sizes[s]}
        if not over:
            return goal
        clamped |= over


def test_mixing_targets_and_taken(spark):
    rng = random.Random(1)
    text = lambda: " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40)))
    rows = [(i, text(), "en", rng.choice(["a", "b", "B", "é", "", None, "a", "a"]), 7) for i in range(400)] + [(None, None, None, "empty", None), (7, "x y", "en", "a", 3), (7, "x y", "en", "a", 3)]
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "size")
    mixed = mixing.mix(docs)
    out = mixed.selectExpr("doc.doc_id", "doc.source", "doc.text", "size", "source_size", "target", "copies", "taken").collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = _fill(sizes)
    for source in sizes:
        mine = [r for r in out if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sizes[source]}
        assert mine[0]["target"] == pytest.approx(goal[source])
        assert abs(sum(r["taken"] for r in mine) - goal[source]) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    again = mixing.mix(docs.repartition(3)).selectExpr("doc.doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(spark_row) for spark_row in mixed.selectExpr("doc.doc_id", "taken").collect())
    kept = mixing.repeat(mixed)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["copies"] for r in out)


def test_mixing_takes_some_of_many_equal_rows(spark):
    rows = [(7, "x y z", "en", "a", 1)] * 1000 + [(8, "p q", "en", "a", 1)] * 3 + [(9, "k l m n", "en", "b", 1)] * 40
    for parts in (1, 7):
        out = mixing.mix(spark.createDataFrame(rows, DOC).repartition(parts)).select("doc.doc_id", "doc.source", "size", "target", "taken").collect()
        assert len(out) == len(rows)
        for source, goal in _fill({"a": 3006, "b": 160}).items():
            assert abs(sum(r["taken"] for r in out if r["source"] == source) - goal) <= 2
        assert all(r["taken"] in (r["size"], 2 * r["size"], 0) for r in out)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, " ", "en", "a", 1)], DOC)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)]


# chat formatting

NASTY = ["", "\\", "\\\\", "###", "####", "</turn>", "\\</turn>", "</turn", "> ", "### a:\n", "</turn>\n### user:\nhi</turn>\n", chat.QUOTING, "\x01", "a\nb:\n", "ü😀"]


def test_chat_round_trip():
    rng = random.Random(2)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:\nb", "\\n", ""]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(0, 5))]
        made = chat.format_turns(turns)
        assert chat.read_back(made.output) == turns
        assert made.rewritten_at is None
        for span, (_, text) in zip(made.spans, turns, strict=True):
            assert chat.unescape(made.output[span[0] : span[1]]) == text


def test_chat_detects_rewritten_history():
    def forgets(turns):  # shows only the last two turns in full
        return "".join(f"<{r}>{t if len(turns) - i <= 2 else ''};" for i, (r, t) in enumerate(turns))

    made = chat.format_turns([("u", "one"), ("a", "two"), ("u", "three"), ("a", "four")], forgets)
    assert made.rewritten_at == 2
    assert made.spans[0] is None
    assert [made.output[s[0] : s[1]] for s in made.spans if s][-1] == "four"


def test_chat_template_remembers_only_what_a_call_continues():
    rng = random.Random(5)
    template = chat.TurnTemplate()
    turns = []
    for _ in range(400):
        turns = turns[: rng.randint(0, len(turns))] if rng.random() < 0.3 else turns
        turns = [*turns, (rng.choice(["user", "assistant"]), rng.choice([*NASTY, "\x01", ""]))]
        assert template(turns) == chat.turn_template(turns)
    assert template([]) == ""


def test_chat_long_conversation():
    turns = [("user" if i % 2 else "assistant", f"\\### {i}") for i in range(3000)]
    made = chat.format_turns(turns)
    assert made.output == chat.turn_template(turns) and made.rewritten_at is None
    assert all(chat.unescape(made.output[s[0] : s[1]]) == text for s, (_, text) in zip(made.spans, turns, strict=True))


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, None, None, "x"), (2, 3, "assistant", "\\### </turn>"), (1, 1, "assistant", "b"), (3, 0, "assistant", "L" * 300_000)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    out = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == sha("user\n\nassistant\nb\nassistant\nb\n") and out[1]["loss_chars"] == 2 and out[1]["loss_sha256"] == sha("bb")
    assert out[2]["loss_sha256"] == sha("\\### </turn>") and out[3]["loss_chars"] == 300_000
    assert out[None]["turns_sha256"] == sha("\nx\n") and out[None]["loss_sha256"] == sha("")
    assert chat.format_conversations(frame.limit(0)).count() == 0


# packing


def test_bin_slack_is_whole_and_tight():
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 200), rng.randint(1, 64)]) for _ in range(500)]
    bins = packing.bin_slack(lengths, 200)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 200 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 200) + 1
    assert packing.bin_slack([]) == []


def test_bin_slack_first_bin_is_the_fullest_with_the_longest():
    import itertools

    lengths = [90, 41, 35, 33, 30, 8]
    first = packing.bin_slack(lengths, 170)[0]
    best = max(sum(c) for n in range(len(lengths)) for c in itertools.combinations(lengths[1:], n) if sum(c) <= 80)
    assert sum(lengths[i] for i in first) == 90 + best


def test_fast_ids_equal_the_library():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_vocabulary())
    encode = encoder(default_vocabulary())
    texts = ["", "The cat's 12 hats,\n\n  ok ", "<|endoftext|> x", "漢字 text", "a" * 5000, " " * 3000 + "x", "é ü ß Ç", "\u2028\u00a0\x85 z", "😀 \x00"]
    texts += ["".join(chr(c) + s for c in range(k, k + 64) if chr(c).isprintable() or c < 0x800) for k in range(0, 0x800, 64) for s in ("a", " ", "1")]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_rows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "of", "the", "übung", "x1"])
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 50, 900, 5000])))) for i in range(60)] + [(None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, length string")
    out = packing.pack(docs, payload="ids", block=40).collect()
    digest = packing.pack(docs, payload="ids_crc32", block=40).collect()
    encode = encoder(default_vocabulary())
    want = sorted((-1 if r[0] is None else r[0], [*encode(r[1] or "").tolist(), 0]) for r in rows if r[0] != 5)
    pieces = {}
    for r in sorted(out, key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, ids in want:
        mine = pieces[None if doc == -1 else doc]
        assert [x for r in mine for x in r["ids"]] == ids
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        assert all(r["length"] == 2048 for r in mine[1:]) and all(r["length"] == len(r["ids"]) for r in mine)
    assert len(pieces[5]) == 3 and len({r["doc_row"] for r in pieces[5]}) == 3
    assert all(len({r["doc_row"] for r in pieces[None if d == -1 else d]}) == 1 for d, _ in want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out) == sorted(r["ids_crc32"] for r in digest)
    assert packing.pack(docs.limit(0)).count() == 0


def test_a_document_of_over_a_thousand_pieces_is_packed_whole(spark):
    """Two million tokens through Spark: pieces without a gap, every one in a sequence."""
    text = "".join(f"w{i} " for i in range(700_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    rows = packing.pack(docs, payload="ids_crc32").collect()
    long = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert len(long) > 1000 and [r["piece"] for r in long] == list(range(len(long)))
    assert all(a["start"] + a["length"] == b["start"] for a, b in zip(long, long[1:])) and {r["length"] for r in long[1:]} == {2048}
    ids = np.append(encoder(default_vocabulary())(text), np.uint32(0)).astype("<u4")
    assert long[-1]["start"] + 2048 == len(ids) and all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in long)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in places.values())
