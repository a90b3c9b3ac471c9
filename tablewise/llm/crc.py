"""CRC-32 of many joined strings at once, from the CRC-32 of their parts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: The CRC-32 polynomial, bits reversed.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), value >> np.uint32(1))
    return value


STEP = _byte_table()


def crc_then_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC-32 of each string with one more byte at its end."""
    state = ~crc.astype(np.uint32)
    return ~((state >> np.uint32(8)) ^ STEP[(state ^ np.uint32(byte)) & np.uint32(255)])


def _by_tables(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = tables[0][value & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables(powers: int = 31) -> np.ndarray:
    """For each power of two, four tables that move a CRC over so many zero bytes."""
    one = np.empty((4, 256), np.uint32)
    for k in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = (value >> np.uint32(8)) ^ STEP[value & np.uint32(255)]
    out = [one]
    for _ in range(powers - 1):
        out.append(np.stack([_by_tables(out[-1], t) for t in out[-1]]))
    return np.stack(out)


SHIFT = _shift_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of left and right strings joined, given both CRCs and the lengths on the right."""
    moved, power = left.astype(np.uint32), 0
    while len(right_length) and (right_length >> power).any():
        rows = np.flatnonzero((right_length >> power) & 1)
        moved[rows] = _by_tables(SHIFT[power], moved[rows])
        power += 1
    return moved ^ right.astype(np.uint32)


def crc_of(strings: pa.Array) -> np.ndarray:
    """CRC-32 of each string of a binary array."""
    return np.array([zlib.crc32(s.as_buffer()) for s in strings], np.uint32)
