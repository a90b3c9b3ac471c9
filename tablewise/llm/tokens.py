"""Byte-level BPE ids of whole texts, each distinct word encoded once per worker.

A byte-level BPE never merges across the pieces of its pre-tokeniser pattern. A text may therefore be
cut at places where such a piece is sure to end, encoded cut by cut, and joined again: the ids are
those of the whole text. The cuts repeat a lot, so a worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tablewise.llm.batches import coded, spread_indices

#: Cuts a worker remembers; beyond it starts anew. About 150 bytes each.
CACHE = 300_000
#: Cuts encoded in one line.
JOINED = 300

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_SOLID = ~_ASCII_SPACE
_SOLID[0x80:] = False
# First bytes of white space beyond ASCII; what begins with another byte is none.
_OPENS_SOLID = ~_ASCII_SPACE
_OPENS_SOLID[0x80:0xC0] = False
_OPENS_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def cut_places(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where a pre-tokeniser piece is sure to begin: before a single space, around a single
    line feed, and between a Latin letter and ASCII punctuation; documents always begin one."""
    mark = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        before, here = raw[:-1], raw[1:]
        opens = _OPENS_SOLID[here]
        # a space whose next byte opens a visible character, or whose last one is visible ASCII
        space = here == 0x20
        follows = np.append(_OPENS_SOLID[raw[2:]], False)
        mark[1:-1] |= space & (follows | _SOLID[before])
        line = here == 0x0A
        mark[1:-1] |= line & _SOLID[before]
        mark[2:-1] |= (before[1:] == 0x0A) & _SOLID[before[:-1]] & opens[1:]
        latin = _LETTER[before]
        latin[1:] |= (before[:-1] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        mark[1:-1] |= latin & _PUNCT[here]
    mark[at] = True
    mark[len(raw)] = False
    return np.flatnonzero(mark)


class Encoder:
    """ids of many texts at once; the tokeniser file is a parameter and is read once per worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their spelling in a text is ordinary text
        # ids of a byte-level vocabulary are spelt with one character for each byte they stand for
        spelt = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(spelt.values()) + 1, np.int64)
        self.bytes_of[list(spelt.values())] = [len(t) for t in spelt]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _encode_lines(self, lines: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([b.decode("utf-8", "replace") for b in lines], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _learn(self, new: list[bytes]) -> None:
        """Encode cuts. Those that begin with a space begin a piece wherever they stand, so they are
        encoded many to a line, and told apart by the bytes that each id stands for."""
        joined = [w for w in new if w[:1] == b" "]
        alone = [w for w in new if w[:1] != b" "]
        new = joined + alone
        ids = self._encode_lines([b"".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))))
        rest = self._encode_lines(alone)
        ends = np.concatenate([ends + 1, len(ids) + np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))])
        ids = np.concatenate([ids, *rest])
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.begin[n : n + len(new)] = self.used + begins
        self.length[n : n + len(new)] = ends - begins
        self.known.update(zip(new, range(n, n + len(new))))
        self.used += len(ids)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): document i has ids[offsets[i]:offsets[i + 1]]."""
        starts = cut_places(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        cuts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]
        )
        index, words = coded(cuts)
        words = words.to_pylist()
        if len(self.known) + len(words) > CACHE:
            self._clear()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = self.length[rows][index]
        ids = self.flat[spread_indices(self.begin[rows][index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(starts, at)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every document."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
