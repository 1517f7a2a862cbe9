"""Periodic run detection: which stretches of words only repeat what is before them.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least `LEAST` words and `TIMES` periods that no neighbouring
word extends.  Words q apart agree over (TIMES - 1) * q places or more of it, so
one of the places 0, s, 2s, .. with s = (TIMES - 1) * q lies there: for all
periods together these places are a harmonic grid of some n log n / (TIMES - 1)
points.

All pairs (period, grid point) whose words agree, there and beside, are extended at once, forward
and backward, by a binary search over prefix hashes in NumPy.  A hash never tells
equal words apart, so an extension can only be too long; every run is verified by
its words, and a text with a wrong one is done again with other bases.  A multiple
of a run's period gives the same stretch, which is kept once, with the smallest.

Defined cases: a null or empty text has no words and no runs; a text is used
whole, its grid in blocks of `PAIRS`; of runs that are equally strong the first,
then the one with the smaller period is the strongest; repeated rows are judged
alike; extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache, partial
from itertools import chain, compress, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, table

LEAST = 6
TIMES = 4
#: Pairs of the grid that are extended together: bounds the working memory.
PAIRS = 1 << 20
#: Words of texts that are judged together, one text at least.
TOGETHER = 1 << 18

_PRIME = np.uint64((1 << 31) - 1)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = dict.fromkeys(words)
    for k, word in enumerate(number):
        number[word] = k
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class PrefixHash:
    """Sums of words times powers of a base modulo a prime, for two bases."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        value = rng.integers(1, int(_PRIME), int(words.max(initial=0)) + 1, dtype=np.uint64)[words]
        self.power, self.total = [], []
        for base in rng.integers(1 << 16, int(_PRIME) - 1, 2):
            power = np.ones(len(words) + 1, np.uint64)
            done, step = 1, np.uint64(base)
            while done < len(power):
                power[done : 2 * done] = power[: len(power) - done][:done] * step % _PRIME
                done, step = 2 * done, step * step % _PRIME
            self.power.append(power)
            self.total.append(np.concatenate(([np.uint64(0)], np.cumsum(value * power[:-1] % _PRIME) % _PRIME)))

    def equal(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from `at` on and `apart` later hash alike."""
        same = np.ones(len(at), bool)
        for power, total in zip(self.power, self.total, strict=True):
            near = (total[at + length] + _PRIME - total[at]) % _PRIME
            far = (total[at + apart + length] + _PRIME - total[at + apart]) % _PRIME
            same &= near * power[apart] % _PRIME == far
        return same


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """The largest k <= most for which fits(k) holds, for all at once; k = 0 always fits."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high + 1) // 2, low)
        good = fits(middle)
        low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
    return low


def _grid(size: np.ndarray, times: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place in the text) of the texts' harmonic grids, in blocks."""
    periods = size // times
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    places = (size[text] - period - 1) // (period * (times - 1)) + 1
    upto = np.cumsum(places)
    block = upto // pairs
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(text)]
    for first, last in pairwise(cuts):
        own, n = slice(first, last), places[first:last]
        held = np.repeat(period[own], n)
        yield np.repeat(text[own], n), held, (np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n)) * held * (times - 1)


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)))]


def _candidates(words: np.ndarray, size: np.ndarray, hashes: Callable[[], PrefixHash], least: int, times: int, pairs: int) -> np.ndarray:
    """(text, start, end, period) by extension of the grid's pairs, each once and in this order."""
    found, base = [np.empty((0, 4), np.int64)], np.cumsum(size) - size
    for text, period, place in _grid(size, times, pairs):
        at = place + base[text]
        agree = np.flatnonzero(words[at] == words[at + period])
        text, period, place, at = text[agree], period[agree], place[agree], at[agree]
        after, before = size[text] - period - place, place
        if max(least, times) > 2:  # words agree over two places at least, so beside a grid point as well
            right, left = at + (after > 1), at - (before > 0)
            beside = ((right > at) & (words[right] == words[right + period])) | ((left < at) & (words[left] == words[left + period]))
            text, period, place, at, after, before = (x[beside] for x in (text, period, place, at, after, before))
        if not len(at):
            continue
        known = hashes()
        after = _longest(lambda k, i=at, p=period: known.equal(i, p, k), after)
        before = _longest(lambda k, i=at, p=period: known.equal(i - k, p, k), before)
        made = np.stack([text, place - before, place + period + after, period], axis=1)
        found.append(_distinct(made[before + period + after >= np.maximum(least, times * period)]))
    return _distinct(np.concatenate(found))


def find_runs(words: np.ndarray, size: np.ndarray, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period; `words` has the numbered words of all texts, `size` how many each has."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    base = np.cumsum(size) - size
    for seed in count():
        text, start, end, period = _candidates(words, size, cache(partial(PrefixHash, words, seed)), least, times, pairs).T
        first = np.concatenate((np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
        smallest = period[first][np.cumsum(first) - 1]
        runs = np.stack([text[first], start[first], end[first] - start[first], period[first]], axis=1)
        spans = zip(base[runs[:, 0]] + runs[:, 1], runs[:, 2], runs[:, 3], strict=True)
        if not (period % smallest).any() and all(np.array_equal(words[s : s + m - q], words[s + q : s + m]) for s, m, q in spans):
            return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """Of (start, length, period) rows, the run with the greatest exact length / period."""
    ratio = runs[:, 1] / runs[:, 2]
    return min(map(tuple, runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def kept_words(size: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """True for every word that no run contains after its first period."""
    step, begin = np.zeros(size.sum() + 1, np.int64), (np.cumsum(size) - size)[runs[:, 0]] + runs[:, 1]
    np.add.at(step, begin + runs[:, 3], 1)
    np.add.at(step, begin + runs[:, 2], -1)
    return np.cumsum(step[:-1]) == 0


def judge_texts(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(runs, collapsed text) for the words of each text."""
    words = list(chain.from_iterable(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    runs = find_runs(word_numbers(words), size, least, times)
    kept, begin = kept_words(size, runs), np.cumsum(size) - size
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    for k, own in enumerate(texts):
        if cuts[k] < cuts[k + 1]:
            own = compress(own, kept[begin[k] : begin[k] + size[k]])
        yield runs[cuts[k] : cuts[k + 1], 1:], b" ".join(own)


def detect(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs, strongest (a run or null) and collapsed: the words that no run repeats, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held, words = [], [], 0
            for k, text in enumerate(batch.column(1)):
                held.append((text.as_py() or b"").split())  # bytes split at ASCII white space
                words += len(held[-1])
                if k + 1 == len(batch) or words > TOGETHER:
                    made += zip(map(len, held), judge_texts(held, least, times), strict=True)
                    held, words = [], 0
            runs = [r for _, (r, _) in made]
            best = [dict(zip(("start", "length", "period"), strongest(r), strict=True)) if len(r) else None for r in runs]
            every = np.concatenate([np.empty((0, 3), np.int64), *runs])
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in every.T.copy()], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), listed, pa.array(best, _RUN), pa.array([c for _, (_, c) in made], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    run = "struct<start: long, length: long, period: long>"
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return arrow_map(rows, judge, f"doc_id {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the contract asks for it by the crc32 of the id, the words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    placed = marked.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    tail = F.slice(F.flatten(again), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(repeat_tails(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        digest(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
