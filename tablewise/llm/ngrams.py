"""Symbol grams inside distinct words, shared by the text models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablewise.llm.batches import buffer_of, spread_indices

BEGIN, END = 2, 3

#: Everything in ASCII that is no letter parts words.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words between BEGIN and END marks as one array, and offsets (n + 1)."""
    raw, at = buffer_of(words)
    n = len(at) - 1
    out = np.empty(len(raw) + 2 * n, np.uint8)
    at2 = at + 2 * np.arange(n + 1)
    out[at2[:-1]] = BEGIN
    out[at2[1:] - 1] = END
    if n:
        out[spread_indices(at2[:-1] + 1, np.diff(at))] = raw
    return out, at2


def grams(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For each symbol, it and up to ``order - 1`` symbols before it in its word, packed in a number
    with the symbol itself in the lowest byte; missing ones are zero."""
    within = np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at))
    key = symbols.astype(np.uint64)
    for j in range(1, order):
        part = np.zeros(len(symbols), np.uint64)
        part[j:] = symbols[:-j]
        part[within < j] = 0
        key |= part << np.uint64(8 * j)
    return key


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key in the sorted keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys
