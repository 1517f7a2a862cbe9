"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of
byte n-grams (n = 1..3, case folded, everything but letters as one space) that
both contain, over the geometric mean of how many each contains; n-grams are
hashed into `SPACE` places.  `LANDMARKS` training documents span the Nyström
space, in which one-versus-rest kernel ridge regression is solved in closed
form.  Scoring is one matrix product of a batch's presence rows with the
landmarks and one with the coefficients.

The fit uses about `SAMPLE` documents (a documented bound), or two of each
language where that is more, as many of each language as of any other where
there are enough, chosen by a hash of
doc_id and text, repeated rows once; the counts behind the sampling rates are taken over all documents.

Defined cases: a null text or one without a letter is `und` with score 0; with
nothing to learn from, everything is `und` with score 0; ties go to the language
that is first in code-point order; repeated rows are judged alike; extra columns
are not carried (the filter keeps all columns); an empty table gives an empty
result.  Texts are read whole, long ones slice by slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, id_crc, table

UNKNOWN = "und"
SPACE = 1 << 14
LANDMARKS = 128
SAMPLE = 2048
RIDGE = 1e-2
HELD_OUT = (4, 2)
#: The filter judges a text by windows of equal length, at most so many characters, that cover all of it.
WINDOW = 1000
#: Lengths of the windows that the filter's lines are learned at; between them lines are interpolated.
LENGTHS = (8, 16, 32, 64, 125, 250, 500, 1000)
#: This share of the texts of a language that isn't learned stays under the filter's lines, and at most OWN of each learned one's.
FOREIGN, OWN = 0.9, 0.001
#: The learned texts' line lies so much lower than the sample says, for what a sample can't show.
SLACK = 0.85
#: With one language there is no other to leave out: the least share of n-grams that the landmarks have.
COVERED = 0.7
FOLDS = 4
_SLICE = 1 << 20
#: Presence rows of one matrix product.
_ROWS = 128

_FOLD = np.full(256, 0x20, dtype=np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(text: str) -> bool:
    """Whether any code point is of a letter category (L*)."""
    return any(map(str.isalpha, text))


def _places(codes: np.ndarray) -> Iterator[np.ndarray]:
    gram = codes
    for n in (1, 2, 3):
        if len(codes) < n:
            return
        if n > 1:
            gram = gram[:-1] * np.uint32(257) + codes[n - 1 :]
        yield ((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


def mark(text: str, row: np.ndarray) -> None:
    """Set row[place] = 1 for every n-gram of the text."""
    for at in range(0, len(text), _SLICE):
        codes = _FOLD[np.frombuffer(text[at : at + _SLICE + 2].lower().encode(), dtype=np.uint8)]
        blank = codes == 0x20
        blank[1:] &= blank[:-1]
        codes = codes[~blank]
        for places in _places(codes):
            row[places] = 1


def windows(text: str) -> Iterator[str]:
    """The text in as few parts of equal length, give or take one, as WINDOW allows."""
    n = -(-len(text) // WINDOW)
    for k in range(n):
        yield text[len(text) * k // n : len(text) * (k + 1) // n]


class Model(NamedTuple):
    languages: list[str]
    #: Presence of the landmarks' n-grams, over the root of their number.
    landmarks: np.ndarray
    coefficients: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        present = rows.astype(np.float32, copy=False)
        norm = np.sqrt(np.maximum(present.sum(1, dtype=np.float64), 1.0))
        return (present @ self.landmarks) / norm[:, None]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score for each text."""
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return found, scores
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for at in range(0, len(known), _ROWS):
            part = known[at : at + _ROWS]
            rows = np.zeros((len(part), SPACE), dtype=np.uint8)
            for row, i in zip(rows, part, strict=True):
                mark(texts[i], row)
            margin = self.kernel(rows) @ self.coefficients
            best = margin.argmax(1)
            for i, k, value in zip(part, best, margin.max(1), strict=True):
                found[i], scores[i] = self.languages[k], min(1.0, max(0.0, (1.0 + float(value)) / 2))
        return found, scores

    def familiar(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text, its best language, and the means over its windows with a letter of the gap to the second one, of the score and of the share of n-grams that the landmarks cover; NaN without one.

        A share of distinct n-grams falls with a text's length, one over windows of bounded length doesn't.
        """
        margin, score = np.zeros((len(texts), max(1, len(self.languages)))), np.zeros(len(texts))
        covered, count = np.zeros(len(texts)), np.full(len(texts), np.nan)
        if self.languages:
            seen = (self.landmarks > 0).any(1).astype(np.float32)
            parts = ((i, part) for i, text in enumerate(texts) if text for part in windows(text) if has_letter(part))
            while held := list(islice(parts, _ROWS)):
                at = np.array([i for i, _ in held])
                rows = np.zeros((len(held), SPACE), dtype=np.float32)
                for row, (_, part) in zip(rows, held, strict=True):
                    mark(part, row)
                made = self.kernel(rows) @ self.coefficients
                np.add.at(margin, at, made)
                np.add.at(score, at, scores_of(made))
                np.add.at(covered, at, (rows @ seen) / np.maximum(rows.sum(1), 1.0))
                count[at] = np.nan_to_num(count[at])
                np.add.at(count, at, 1)
        return margin.argmax(1), gap(margin) / count, score / count, covered / count


def scores_of(margin: np.ndarray) -> np.ndarray:
    return np.clip((1.0 + margin.max(1)) / 2, 0.0, 1.0)


def gap(margin: np.ndarray) -> np.ndarray:
    """How far the best language is above the second; with one there is none."""
    if margin.shape[1] < 2:
        return np.zeros(len(margin))
    two = np.partition(margin, -2, axis=1)[:, -2:]
    return two[:, 1] - two[:, 0]


class Lines(NamedTuple):
    """By length: how far texts of languages that aren't learned get in gap and score; by language and length: the least of both over that, and of the covered share."""

    gap: np.ndarray
    score: np.ndarray
    least: np.ndarray
    covered: np.ndarray

    def passed(self, texts: list[str | None], model: Model) -> np.ndarray:
        if not model.languages:
            return np.zeros(len(texts), dtype=bool)
        best, apart, score, covered = model.familiar(texts)
        size = np.array([len(t or "") for t in texts], dtype=np.float64)
        size = np.log2(np.maximum(1.0, size / np.maximum(1.0, np.ceil(size / WINDOW))))
        at = lambda line: np.interp(size, np.log2(LENGTHS), line)
        of = lambda lines: np.array([at(line) for line in lines])[best, np.arange(len(best))]
        return (beyond(apart, score, at(self.gap), at(self.score)) >= of(self.least)) & (covered >= of(self.covered))  # NaN passes nothing


def beyond(apart: np.ndarray, score: np.ndarray, gap_line: np.ndarray, score_line: np.ndarray) -> np.ndarray:
    """At least 1 for a text that is clearly in one learned language, or clearly like learned texts, be it in two languages."""
    return np.maximum(apart / np.maximum(gap_line, 1e-9), score / np.maximum(score_line, 1e-9))


def _solved(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model, which rows are its landmarks, and all rows' kernel with them."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((SPACE, 0), np.float32), np.zeros((0, 0))), np.zeros(0, np.int64), np.zeros((0, 0))
    label = np.array([names.index(x) for x in languages])
    rank = np.zeros(len(label), dtype=np.int64)  # landmarks: the languages take turns
    for k in range(len(names)):
        rank[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, rank))[: max(landmarks, len(names))]  # one of each language at least
    marks = rows[chosen].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1.0))
    blank = Model(names, np.ascontiguousarray(marks.T), np.zeros((len(chosen), len(names))))
    kernel = np.concatenate([blank.kernel(rows[i : i + 256]) for i in range(0, len(rows), 256)])
    return blank._replace(coefficients=_ridge(kernel, kernel[chosen], label, len(names), ridge)), chosen, kernel


def solve(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model from presence rows and their languages, in a fixed order."""
    return _solved(rows, languages, landmarks, ridge)[0]


def _ridge(kernel: np.ndarray, own: np.ndarray, label: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of the landmarks; `kernel` compares the training rows with them, `own` the landmarks with each other."""
    value, vector = np.linalg.eigh(own.astype(np.float64))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = kernel @ whiten
    weight = 1.0 / np.bincount(label, minlength=n)[label]
    target = np.where(label[:, None] == np.arange(n), 1.0, -1.0)
    gram = features.T @ (features * weight[:, None]) + ridge * n / max(len(label), 1) * np.eye(features.shape[1])
    return whiten @ np.linalg.solve(gram, features.T @ (target * weight[:, None]))


def learn_lines(model: Model, chosen: np.ndarray, kernel: np.ndarray, label: np.ndarray, parts: list[list[np.ndarray | None]]) -> Lines:
    """What tells learned languages from others, learned from the training texts' own windows.

    `parts` has each training text's n-gram places in a window of each length, None
    where the text is shorter.  Models without one of the languages show how far
    texts of no learned language get: the FOREIGN quantile of their gaps and
    scores (the largest over the languages), and the share of n-grams that
    others cover of nearly all of them (the smallest quantile).  Models without a fold show how far the
    learned languages' own texts do; where OWN of them would go, the line is lower.
    """
    n, folds = len(model.languages), np.arange(len(label)) % FOLDS
    views = [("own", f, folds[chosen] != f, folds != f) for f in range(FOLDS)] + [("foreign", k, label[chosen] != k, label != k) for k in range(n) if n > 1]
    views = [(what, k, marks, _refit(kernel, chosen, label, marks, rows)) for what, k, marks, rows in views if marks.any() and rows.any()]
    seen = np.stack([(model.landmarks[:, marks] > 0).any(1) for _, _, marks, _ in views], axis=1).astype(np.float32) if views else np.zeros((SPACE, 0), np.float32)
    lines = Lines(*np.zeros((2, len(LENGTHS))), *np.zeros((2, n, len(LENGTHS))))
    for w in range(len(LENGTHS)):
        own = np.array([i for i in range(len(label)) if parts[i][w] is not None], np.int64)
        made = [np.zeros((0, len(views), 3))]
        for at in range(0, len(own), 256):
            rows = np.zeros((len(own[at : at + 256]), SPACE), np.float32)
            for row, i in zip(rows, own[at : at + 256], strict=True):
                row[parts[i][w]] = 1
            compared = model.kernel(rows)
            margins = [compared[:, marks] @ c for _, _, marks, c in views]
            covered = (rows @ seen) / np.maximum(rows.sum(1), 1.0)[:, None]
            made.append(np.stack([np.stack([gap(m), scores_of(m), covered[:, v]], axis=1) for v, m in enumerate(margins)], axis=1))
        made = np.concatenate(made)
        far = [made[label[own] == k, v] for v, (what, k, _, _) in enumerate(views) if what == "foreign" and (label[own] == k).any()]
        if far and n > 2:  # with two languages there is nothing to compare without one
            lines.gap[w], lines.score[w] = np.max([np.quantile(x[:, :2], FOREIGN, axis=0) for x in far], axis=0)
        shared = min(np.quantile(x[:, 2], 1 - FOREIGN) for x in far) if far else COVERED
        mine = np.full((len(own), 3), np.nan)
        for v, (what, f, _, _) in enumerate(views):
            if what == "own":
                mine[folds[own] == f] = made[folds[own] == f, v]
        for k in range(n):
            held = mine[(label[own] == k) & ~np.isnan(mine[:, 0])]
            reached = beyond(held[:, 0], held[:, 1], lines.gap[w], lines.score[w])
            low = lambda x: np.quantile(x, OWN) if len(x) else np.inf
            lines.least[k, w] = SLACK * min(1.0, low(reached)) if far and n > 2 else 0.0
            lines.covered[k, w] = min(shared, low(held[:, 2]))
    return lines


def _refit(kernel: np.ndarray, chosen: np.ndarray, label: np.ndarray, marks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Coefficients from some of the landmarks and some of the rows."""
    names = np.unique(label[rows])
    return _ridge(kernel[rows][:, marks], kernel[chosen][marks][:, marks], np.searchsorted(names, label[rows]), len(names))


def _sampled(docs: DataFrame, train: Column, sample: int, lengths: Sequence[int]) -> tuple[np.ndarray, list[str], list[list[np.ndarray | None]]]:
    """Presence rows, languages and windows of the training texts, in a fixed order."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()  # a row for each language
    if not counted:
        return np.zeros((0, SPACE), np.uint8), [], []
    each = max(2, sample // len(counted))
    rates = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], each / r["n"])) for r in counted], "lang string, rate double")
    rows = rows.join(F.broadcast(rates), "lang").select("doc_id", "lang", "text", "rate")

    def places(text: str) -> np.ndarray:
        row = np.zeros(SPACE, dtype=np.uint8)
        mark(text, row)
        return np.flatnonzero(row).astype(np.int16)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts = [], []
            for text in batch.column(2).to_pylist():
                held.append(places(text))
                at = [zlib.crc32(text.encode()) % (len(text) - n + 1) if len(text) >= n else None for n in lengths]
                cut = [None if i is None else text[i : i + n] for i, n in zip(at, lengths, strict=True)]
                parts.append([places(x) if x is not None and has_letter(x) else None for x in cut])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int16())), pa.array(parts, pa.list_(pa.list_(pa.int16())))], names=["doc_id", "lang", "places", "parts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = arrow_map(rows.where(draw <= F.col("rate")).drop("rate"), present, f"doc_id {kind}, lang string, places array<smallint>, parts array<array<smallint>>").distinct().toArrow().combine_chunks()
    # whole columns of numbers: as Python lists they would take the driver many times the room
    own, ids, languages = _slices(got["places"]), got["doc_id"].to_pylist(), got["lang"].to_pylist()
    order = sorted(range(len(got)), key=lambda i: (hash_order(ids[i]), languages[i], own[i].tobytes()))
    matrix = np.zeros((len(got), SPACE), dtype=np.uint8)
    for row, i in zip(matrix, order, strict=True):
        row[own[i]] = 1
    parts = _slices(got["parts"].chunk(0).flatten()) if lengths and len(got) else []
    n = len(lengths)
    return matrix, [languages[i] for i in order], [parts[n * i : n * (i + 1)] for i in order]


def _slices(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray | None]:
    """The lists of a column as views on its numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    ends, numbers = column.offsets.to_numpy(), column.values.to_numpy()
    return [numbers[ends[i] : ends[i + 1]] if known else None for i, known in enumerate(column.is_valid().to_pylist())]


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learn from the rows of `docs` for which `train` holds and lang is not null."""
    return solve(*_sampled(docs, train, sample, ())[:2])


def fit_filter(docs: DataFrame, train: Column, sample: int = SAMPLE) -> tuple[Model, Lines]:
    """The model, and the lines of its filter from the same rows."""
    matrix, languages, parts = _sampled(docs, train, sample, LENGTHS)
    model, chosen, kernel = _solved(matrix, languages)
    return model, learn_lines(model, chosen, kernel, np.searchsorted(model.languages, languages), parts)


def hash_order(doc_id: object) -> int:
    """A fixed scattered order of ids."""
    return (int(doc_id or 0) * 0x9E3779B97F4A7C15 >> 11) & ((1 << 52) - 1) if isinstance(doc_id, int | None) else hash_order(int.from_bytes(str(doc_id).encode(), "big"))


def identify(docs: DataFrame, train: Column, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred and score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model or fit(docs, train)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            found, scores = known.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), judge, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, train: Column) -> DataFrame:
    """The documents, all columns, that are in learned languages.

    A document stays if it has a letter, if its best language is far above the second
    or its score high, and if its n-grams are covered, as the learned lines for this
    language and length ask.  With fewer than three languages the n-grams alone decide.
    """
    model, lines = fit_filter(docs, train)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(model), tuple(lines)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, learned = Model(*shared.value[0]), Lines(*shared.value[1])
        for batch in batches:
            yield batch.filter(pa.array(learned.passed(batch.column("text").to_pylist(), known), pa.bool_()))

    return arrow_map(docs, keep, docs.schema)


def is_held_out(modulus: int = HELD_OUT[0], rest: int = HELD_OUT[1]) -> Column:
    return id_crc("doc_id") % modulus == rest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~is_held_out()).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
