"""Token ids of a public byte-level BPE vocabulary.

The ids are those of `tokenizers` with the vocabulary's JSON file and
add_special_tokens=False (a special token's string in a text becomes that
token).  The same vocabulary as a rank file lets `tiktoken` give equal ids
several times faster; it is used where both split a text alike by construction:
no special token's string and no code point from 0x800 on, below which a test
compares both code point by code point.  All other texts, and any that the fast
path refuses (very long runs of white space), go to `tokenizers`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """text -> ids as uint32; one per Python worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    fast = _ranked(os.path.splitext(vocabulary)[0] + ".tiktoken")

    def slow_ids(text: str) -> np.ndarray:
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if fast is None or np.frombuffer(text.encode(), dtype=np.uint8).max() >= 0xE0 or any(s in text for s in special):
            return slow_ids(text)
        try:
            return np.asarray(fast(text), dtype=np.uint32)
        except BaseException as refused:  # the library's panics don't derive from Exception
            if isinstance(refused, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return slow_ids(text)

    return ids


def _ranked(path: str):
    """The fast encoder, if the vocabulary is also there as a rank file."""
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
