"""Hashed words of Arrow text columns, for operators that compare word sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and the place where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    return flat, ends


def hash_distinct(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each distinct word, and for every word its number among them."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    coded = words.dictionary_encode()
    return pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False), np.asarray(coded.indices)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; each distinct word is hashed once."""
    distinct, places = hash_distinct(words)
    return distinct[places]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; entry i is of words i to i + size - 1."""
    count = max(len(hashes) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * MULTIPLIER + hashes[k : k + count]
    return mixed(out)
