"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words.  The encoder of a passage is
learned: every word and every pair of words has an embedding, found by hashing in
a table of `SLOTS` rows; a layer takes their mean, together with shares of
character classes, word shapes and local repetition, to the passage's encoding.
Gated attention turns the encodings into weights that sum to 1 over the document,
and the weighted passage representation is scored.  Embeddings, layer, attention
and scorer are learned together from document labels alone.

The fit uses labelled documents in the order of a hash of doc_id: at most `SAMPLE`
of them, and no more than have `FIT_CHARS` characters together (documented bounds;
the first one always).  It learns from all passages of each.  Scoring reads whole
texts, in one pass without a shuffle.

Defined cases: null and empty texts are one passage without words; documents
with several labels count with the largest; null labels are left out; repeated
rows of a labelled doc_id are learned from once each, as far as the sample goes;
with no label, or of one kind only, every score is 0.5, or near that kind's;
repeated rows score alike; extra columns are not carried (the filter keeps all
columns); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, id_crc, table
from rankforge.llm.words import mix, spans, word_hashes

PASSAGE = 64
SAMPLE = 4096
FIT_CHARS = 1 << 25
#: Rows of the embedding table, and their width.
SLOTS, EMBED = 1 << 12, 8
HELD_OUT = (3, 1)
EPOCHS = 8
#: Share of an embedding that a step takes away, over the number of documents learned from.
DECAY = 3.0
#: Least score with which the filter keeps a document.
KEEP = 0.5

_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".", ",;:", "!?", "|", "#$%&*@^~+=<>\\_", "()[]{}/\"'-`")
_CLASS = np.full(256, len(_KINDS), dtype=np.intp)
for _k, _kind in enumerate(_KINDS):
    _CLASS[list(_kind.encode())] = _k
_CLASS[0x80:0xC0] = len(_KINDS) + 1
_CLASS[0xC0:] = len(_KINDS) + 2
_CLASSES = len(_KINDS) + 3
#: Width of a passage's raw description.
WIDTH = _CLASSES + 9


class Bag(NamedTuple):
    #: (passages, WIDTH): shares of classes and shapes.
    shape: np.ndarray
    #: Places in the embedding table of the passages' words and pairs of words, one passage after the other.
    grams: np.ndarray
    #: How many of them each passage has.
    count: np.ndarray


def bag_of(text: str | None) -> Bag:
    """The passages of a text, one at least."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    begin, end = spans(raw)
    word = word_hashes(raw, begin, end)
    pair = mix(word[1:] + word[:-1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
    grams = np.empty(max(0, 2 * len(word) - 1), np.int16)  # word, pair, word, pair, ..
    grams[::2], grams[1::2] = word >> np.uint64(64 - 12), pair
    return Bag(passages(raw, begin, end, word), grams, np.diff(np.append(np.arange(0, 2 * max(1, len(word)), 2 * PASSAGE), len(grams))))


def passages(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(passages, WIDTH) description of a text's bytes, given its words, one row at least."""
    n = max(1, -(-len(begin) // PASSAGE))
    out = np.zeros((n, WIDTH))
    if not len(begin):
        out[0, _CLASSES] = 1.0
        return out
    first = begin[::PASSAGE].copy()
    first[0] = 0
    length = np.diff(np.append(first, len(raw)))
    for at in range(0, n, 4096):  # bounds the memory that a long text takes
        stop = min(n, at + 4096)
        piece = raw[first[at] : first[stop - 1] + length[stop - 1]]
        owner = np.repeat(np.arange(stop - at), length[at:stop])
        out[at:stop, :_CLASSES] = np.bincount(owner * _CLASSES + _CLASS[piece], minlength=(stop - at) * _CLASSES).reshape(-1, _CLASSES)
    upper = np.concatenate(([0], np.cumsum(_CLASS[raw] == 1)))
    capitals = upper[end] - upper[begin]
    size = end - begin
    last = _CLASS[raw[end - 1]]
    same = [np.concatenate((np.zeros(min(lag, len(word)), bool), word[lag:] == word[:-lag] if len(word) > lag else np.zeros(0, bool))) for lag in (1, 2, 3)]
    per_word = np.stack([np.minimum(size, 40) / 10.0, size == 1, (capitals == size) & (size > 1), last == 7, (last == 8) | (last == 9), *same]).astype(np.float64)
    starts = np.arange(0, len(word), PASSAGE)
    count = np.diff(np.append(starts, len(word)))
    out[:, :_CLASSES] /= np.maximum(length, 1)[:, None]
    out[:, _CLASSES] = 0.0
    out[:, _CLASSES + 1 :] = (np.add.reduceat(per_word, starts, axis=1) / count).T
    return out


def _softmax(score: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    e = np.exp(score - np.maximum.reduceat(score, starts)[owner])
    return e / np.add.reduceat(e, starts)[owner]


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of the given lengths, which may be 0."""
    out = np.zeros((len(count), values.shape[1]), values.dtype)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some], axis=0)
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    table: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def encoded(self, bags: list[Bag]) -> tuple[np.ndarray, np.ndarray]:
        """What the layer sees of every passage, and where documents start."""
        count = np.concatenate([b.count for b in bags])
        mean = _sums(self.table[np.concatenate([b.grams for b in bags])], count) / np.maximum(count, 1)[:, None]
        shape = (np.concatenate([b.shape for b in bags]) - self.mean) / self.scale
        return np.concatenate([shape, mean], axis=1), np.cumsum([0, *(len(b.count) for b in bags[:-1])])

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Everything between encoded passages and the documents' logits."""
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.maximum(x @ self.encode + self.encode_bias, 0.0)
        t, g = np.tanh(h @ self.value), 1.0 / (1.0 + np.exp(-np.clip(h @ self.gate, -30, 30)))
        a = _softmax((t * g) @ self.attend, starts, owner)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return owner, h, t, g, a, z, z @ self.out + self.out_bias[0]

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        out, bags, words = [], [], 0

        def flush() -> None:
            if bags:
                out.append(1.0 / (1.0 + np.exp(-np.clip(self.forward(*self.encoded(bags))[-1], -30, 30))))

        for text in texts:  # documents are scored together up to some number of words
            bags.append(bag_of(text))
            words += len(bags[-1].grams)
            if words > 1 << 16:
                flush()
                bags, words = [], 0
        flush()
        return np.concatenate([np.empty(0), *out])


def gradients(model: Model, bags: list[Bag], labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighted mean cross-entropy, for the parameters from `table` on."""
    x, starts = model.encoded(bags)
    owner, h, t, g, a, z, logit = model.forward(x, starts)
    d_logit = (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight / len(bags)
    d_z = d_logit[:, None] * model.out
    d_a = (d_z[owner] * h).sum(1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[owner])
    d_tg = d_e[:, None] * model.attend
    d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
    d_h = (a[:, None] * d_z[owner] + d_t @ model.value.T + d_g @ model.gate.T) * (h > 0)
    count = np.concatenate([b.count for b in bags])
    d_mean = (d_h @ model.encode[WIDTH:].T) / np.maximum(count, 1)[:, None]
    grams = np.concatenate([b.grams for b in bags])
    share = np.repeat(d_mean, count, axis=0)
    d_table = np.stack([np.bincount(grams, share[:, k], minlength=SLOTS) for k in range(EMBED)], axis=1)
    return d_table, x.T @ d_h, d_h.sum(0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_e, z.T @ d_logit, np.array([d_logit.sum()])


def train(bags: list[Bag], labels: np.ndarray, epochs: int = EPOCHS, hidden: int = 24, attention: int = 12, seed: int = 7) -> Model:
    """Learn by Adam on the cross-entropy of document labels, classes weighted alike; embeddings decay towards 0."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([b.shape for b in bags]) if bags else np.zeros((1, WIDTH))
    scale = every.std(0)
    model = Model(
        every.mean(0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 0.01, (SLOTS, EMBED)), rng.normal(0, WIDTH**-0.5, (WIDTH + EMBED, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, attention)),
        rng.normal(0, hidden**-0.5, (hidden, attention)), rng.normal(0, attention**-0.5, attention), np.zeros(hidden), np.zeros(1),
    )
    if not bags:
        return model
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weight = np.minimum(np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), 10.0)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in model[2:]]
    step = 0
    for _ in range(max(epochs, min(60, epochs * 1024 // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            step += 1
            for k, (p, d, (m, v)) in enumerate(zip(model[2:], gradients(model, [bags[i] for i in part], labels[part], weight[part]), state, strict=True)):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (0.01 if k else 0.003) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if not k:
                    p *= 1 - min(0.1, DECAY / len(bags))
    return model._replace(table=model.table.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = FIT_CHARS) -> Model:
    """Learn from `labels` (doc_id, label) on the texts of `docs`."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [bag_of(t.as_py()) for t in batch.column(1)]
            parts = [[b.shape.astype(np.float32).ravel() for b in held], [b.grams for b in held], [b.count.astype(np.int32) for b in held]]
            kinds = [pa.float32(), pa.int16(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(k)) for x, k in zip(parts, kinds, strict=True)), batch.column(2)], names=["doc_id", "shape", "grams", "count", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    # repeated documents can be more rows than labels: the least by hash
    joined = joined.withColumn("turn", F.xxhash64("doc_id", "text"))
    sizes = joined.select("turn", F.coalesce(F.length("text"), F.lit(0)).alias("size")).orderBy("turn").limit(sample).toArrow()  # two numbers a row
    taken = int((np.cumsum(sizes["size"].to_numpy()) <= chars).sum())
    if len(sizes):
        joined = joined.where(F.col("turn") <= F.lit(sizes["turn"][max(0, taken - 1)].as_py()))
    joined = joined.orderBy("turn", "doc_id").limit(sample).drop("turn")
    got = arrow_map(joined, describe, f"doc_id {kind}, shape array<float>, grams array<smallint>, count array<int>, label int").toArrow().sort_by([("doc_id", "ascending")])
    bags = [Bag(s.values.to_numpy().astype(np.float64).reshape(-1, WIDTH), g.values.to_numpy(), c.values.to_numpy()) for s, g, c in zip(got["shape"], got["grams"], got["count"], strict=True)]
    return train(bags, got["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.scores(x.as_py() for x in batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), judge, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The documents, all columns, with at least the score `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(known.scores(x.as_py() for x in batch.column("text")) >= least))

    return arrow_map(docs, keep, docs.schema)


def is_held_out(modulus: int = HELD_OUT[0], rest: int = HELD_OUT[1]) -> Column:
    return id_crc("doc_id") % modulus == rest


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels").where(~is_held_out()).select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(spark, sf_dir, docs))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
