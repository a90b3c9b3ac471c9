"""Whole texts as byte buffers inside Arrow tasks.

Texts of a task arrive as Arrow batches; they are cut into slices of bounded bytes and looked at
as one byte array with document offsets, so that numpy handles many documents at once.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.plans.shape import planned_bytes

SLICE_BYTES = 4 << 20
PART_BYTES = 16 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions for work that is heavy per byte: follows the size of the plan, and is never less
    than the cores or the shuffle partitions of the session. Sizes that Spark cannot tell, or that it
    multiplies up over joins, count for no more than a few parts for each partition there is."""
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(math.ceil(planned_bytes(df) / part_bytes), 32 * df.rdd.getNumPartitions()))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` and nothing else; a null text is an empty one."""
    return df.select(
        ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text")
    )


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if kind == pa.large_binary() else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what this worker has freed to the machine. Workers serve many tasks, and what each of an
    executor's workers holds on to adds up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """Yield (rows, bytes, offsets): consecutive rows of at most ``limit`` bytes, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = buffer_of(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
        del batch, raw, at
        give_back()


def pieces(raw: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of bytes that are not ``apart`` (a flag for each of 256 bytes), none across documents.

    Returns the pieces in order and the index of each document's first piece (n + 1 entries).
    """
    inside = ~apart[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    kept = raw[inside]
    place = np.cumsum(inside, dtype=np.int64) - inside
    offsets = np.append(place[starts], len(kept))
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]
    )
    return array, np.searchsorted(starts, at)


def coded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each piece among the distinct pieces, and the distinct pieces."""
    if not len(array):
        return np.zeros(0, np.int64), array
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each document, given the index of its first value (n + 1 entries)."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def spread_indices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of many ranges, as one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
