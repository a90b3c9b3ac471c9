"""Token ids in bit-packed files: each id takes the fewest bits that hold the vocabulary.

A table is a folder of Parquet files whose rows are *frames*. A frame holds whole documents: their
ids and lengths, where it begins among the tokens of its file part, and the packed ids. Packed ids
are cut into blocks of ``BLOCK`` ids; a table of block offsets in front of them lets a reader unpack
only the blocks it needs. Eight ids of b bits fill b bytes, so packing and unpacking are a few shifts
over whole columns of ids.

    b"TWB1" | bits u8 | 3 zero bytes | ids u64 | block offsets u64[blocks + 1] | blocks
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.batches import documents, parts_for, slices
from tablewise.llm.tokens import encoder, with_end
from tablewise.plans.shape import remove_at_exit, shared_folder

MAGIC = b"TWB1"
BLOCK = 4096
HEAD = struct.Struct("<4sB3xQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first; the last group of eight is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    eights = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    eights.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(eights), bits), np.uint8)
    for k in range(8):
        for j in range(k * bits // 8, -(-(k + 1) * bits // 8)):
            shift = 8 * j - k * bits
            part = eights[:, k] >> np.uint64(shift) if shift >= 0 else eights[:, k] << np.uint64(-shift)
            out[:, j] |= part.astype(np.uint8)
    return out.tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    groups = np.frombuffer(data, np.uint8)[: -(-n // 8) * bits].reshape(-1, bits)
    out = np.zeros((len(groups), 8), np.uint32)
    for k in range(8):
        value = np.zeros(len(groups), np.uint64)
        for j in range(k * bits // 8, -(-(k + 1) * bits // 8)):
            shift, part = 8 * j - k * bits, groups[:, j].astype(np.uint64)
            value |= part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)
        out[:, k] = value & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def pack_frame(ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return HEAD.pack(MAGIC, bits, len(ids)) + at.tobytes() + b"".join(blocks)


def read_frame(frame: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a frame, unpacking only the blocks that hold them."""
    magic, bits, n = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(frame, "<u8", -(-n // BLOCK) + 1, HEAD.size)
    body = HEAD.size + at.nbytes
    low, high = first // BLOCK, -(-last // BLOCK)
    held = unpack_bits(frame[body + int(at[low]) : body + int(at[high])], min(n, high * BLOCK) - low * BLOCK, bits)
    return held[first - low * BLOCK : last - low * BLOCK]


FRAME_SCHEMA = "part int, first_token long, n_tokens long, doc_ids binary, nulls binary, lengths binary, frame binary"


def _frames(path: str, end: int, bits: int):
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for rows, raw, at in slices(batches):
            ids, offsets = with_end(*encoder(path).encode(raw, at), end)
            docs = rows.column("doc_id")
            values = {
                "part": part,
                "first_token": before,
                "n_tokens": len(ids),
                "doc_ids": docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                "nulls": docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                "lengths": np.diff(offsets).astype("<u4").tobytes(),
                "frame": pack_frame(ids, bits),
            }
            before += len(ids)
            yield pa.RecordBatch.from_pylist(
                [values],
                pa.schema(
                    [("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64())]
                    + [(c, pa.binary()) for c in ("doc_ids", "nulls", "lengths", "frame")]
                ),
            )

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 0, vocabulary: int = 50257, id_col="doc_id", text_col="text"
) -> None:
    """Encode every whole text, append ``end`` and write frames in ascending key order.

    Rows are range-partitioned by key, so the order of the parts, frames and documents is the order
    of keys over all files; a null key comes first, equal keys follow by the hash of their text. A
    null or empty text is its end id alone. A text longer than a frame has a frame of its own.
    """
    plain = documents(docs, id_col, text_col)
    ordered = plain.repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    frames = ordered.mapInArrow(_frames(tokenizer, end, bits_for(vocabulary)), FRAME_SCHEMA)
    frames.write.option("compression", "none").parquet(folder)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["doc_ids"], "<i8")
            null = np.frombuffer(row["nulls"], np.uint8).astype(bool)
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            data = read_frame(row["frame"]).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            begins = ends - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), row["part"], np.int32)),
                    pa.array(keys, mask=null),
                    pa.array(row["first_token"] + begins),
                    pa.array(lengths),
                    pa.array([zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())], pa.int64()),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the unpacked ids of the files."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(folder)
    # One row per file part: its tokens, and those of the parts before it.
    sizes = frames.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = frames.mapInArrow(_read, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(begins, "part").select(
        "doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark, folder: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every document in the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, null = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
                at = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<u4"))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(read_frame(row["frame"]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), ids], ["doc_id", "ids"])

    return spark.read.schema(FRAME_SCHEMA).parquet(folder).mapInArrow(run, "doc_id long, ids array<int>")


def scratch_token_files(docs: DataFrame, tokenizer: str, end: int = 0) -> str:
    """Write to a new folder beside the checkpoints and return its name."""
    import uuid

    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    remove_at_exit(docs.sparkSession, folder)
    write_token_files(docs, folder, tokenizer, end)
    return folder
