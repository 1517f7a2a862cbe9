"""DartMinHash: sparse weighted MinHash signatures.

Darts are thrown at the plane of weight and rank of every element by hashing.
The weight axis of an element is cut into regions [2^v - 1, 2^(v+1) - 1); in a
region the ranks of its darts are the arrivals of a Poisson process whose rate
is the region's width, drawn gap by gap from hashes of (element, region, number
of the dart).  A dart counts if its weight lies below the element's weight.
Each dart belongs to one of k coordinates; a coordinate's value is the print of
its dart of least rank.  Darts are thrown up to a rank at which a set of total
weight W expects k (ln k + 3) of them, so the work is about W + k ln k for all k
coordinates; where a coordinate stays empty, the set is thrown again up to twice
that rank.  Two sets agree in a coordinate with the probability of their
weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from rankforge.llm.words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_REGION = np.uint64(0xD1B54A32D192ED03)
_UNIT = 2.0**-53


def _regions(owner: np.ndarray, key: np.ndarray, weight: np.ndarray):
    """One row per (element, weight region)."""
    levels = np.ceil(np.log2(weight + 1.0)).astype(np.int64)
    element = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix(key[element] + (level.astype(np.uint64) + np.uint64(1)) * _REGION)
    return owner[element], seed, weight[element], 2.0**level


def _throw(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int):
    """(slot, rank, print) of all darts up to their set's rank limit."""
    own, seed, most, width = _regions(owner, key, weight)
    rank, number = np.zeros(len(own)), np.zeros(len(own), dtype=np.uint64)
    slots, ranks, prints = [], [], []
    while len(own):
        room = (limit[own] - rank) * width
        expected = room.mean()
        block = int(min(64, expected + 2 * np.sqrt(expected) + 1))  # nearly all are done after one block
        drawn = mix(seed[:, None] + (number[:, None] + np.arange(1, block + 1, dtype=np.uint64)) * _STEP)
        at = rank[:, None] + np.cumsum(-np.log(((drawn >> np.uint64(11)) + np.uint64(1)) * _UNIT) / width[:, None], axis=1)
        dart = mix(drawn ^ _REGION)
        hit = at <= limit[own][:, None]
        heavy = width > 1
        fits = hit
        if heavy.any() or (most < 1).any():
            place = width[:, None] * (1 + (mix(dart ^ _STEP) >> np.uint64(11)) * _UNIT) - 1
            fits = hit & (place < most[:, None])
        rows, _ = np.nonzero(fits)
        dart = dart[fits]
        slots.append(own[rows] * k + (dart % np.uint64(k)).astype(np.int64))
        ranks.append(at[fits])
        prints.append(mix(dart + _STEP))
        more = hit[:, -1]
        own, seed, most, width, rank, number = own[more], seed[more], most[more], width[more], at[more, -1], number[more] + np.uint64(block)
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(prints)


def signatures(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) prints; `owner` names each element's set, every set has an element of positive weight."""
    out = np.zeros(sets * k, dtype=np.uint64)
    total = np.bincount(owner, weight, minlength=sets)
    limit = k * (np.log(k) + 3.0) / total
    todo = np.ones(sets, dtype=bool)
    while todo.any():
        part = todo[owner]
        slot, rank, dart = _throw(owner[part], key[part], weight[part], limit, k)
        last = np.argsort(-rank)  # later assignments win, so the least rank goes last
        filled = np.zeros(sets * k, dtype=bool)
        filled[slot] = True
        out[slot[last]] = dart[last]
        todo &= ~filled.reshape(sets, k).all(1)
        limit = limit * 2
    return out.reshape(sets, k)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) keys: equal where all coordinates of a band are."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(parts.shape[2]):
        key = mix(key * _STEP + parts[:, :, r])
    return key
