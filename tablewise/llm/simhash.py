"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint of 64 bits is eight (position, byte) entries. Two fingerprints that differ in at most
three bits share at least five entries, and five of eight positions always hold one of the 14 blocks
of four positions below. So the index lists fingerprints under four shared entries at a time: no link
is lost, and an unrelated pair meets only by 32 equal bits. Pairs that meet are tallied (at least
five shared entries) and then verified bit by bit. Where a list gets long it is dealt again under
each fifth entry, which linked pairs must also share; in such a list only 24 bits are free, so each
fingerprint has at most 2,324 neighbours, and those are looked up instead of trying all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.batches import documents, slices
from tablewise.llm.components import components
from tablewise.plans.shape import spread, stored

SHARED = 5
LIST_LIMIT = 2048


def position_blocks() -> list[tuple[int, ...]]:
    """The 14 sets of four positions whose three-bit numbers cancel out (a Steiner system on eight
    points, in which any three points lie in one block): every five positions contain one."""
    return [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``width`` words, or of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter((digest(b" ".join(r), 42) for r in runs), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the lower-cased words of a text; zero if it has none."""
    return majority(shingle_hashes(text.lower().split(), width))


def fingerprints(docs: DataFrame, width: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, fingerprint long``: the signed form of the 64 bits."""

    def run(batches):
        for rows, raw, at in slices(batches):
            data = raw.tobytes()
            values = [fingerprint(data[i:j], width) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fingerprint"]
            )

    return spread(documents(docs, id_col, text_col)).mapInArrow(run, "doc_id long, fingerprint long")


def _byte(position: int):
    return F.shiftrightunsigned("fingerprint", 8 * position).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...]):
    key = F.lit(0).cast("long")
    for p in positions:
        key = key * 256 + _byte(p)
    return key


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _masks(bits: list[int], radius: int) -> np.ndarray:
    out = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(bits, r)]
    return np.array(out, np.uint64)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def list_links(values: np.ndarray, radius: int, free: list[int] | None) -> np.ndarray:
    """For one list: its fingerprints and, for each, the least one it is linked to within the list."""
    values = np.unique(values)
    parent = np.arange(len(values))

    def join(left, right):
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = _root(parent, i), _root(parent, j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    if len(values) <= LIST_LIMIT or free is None:
        step = max(1, (1 << 20) // max(1, len(values)))
        for first in range(0, len(values), step):
            differ = values[first : first + step, None] ^ values[None, :]
            shared = (np.ascontiguousarray(differ).view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1)
            i, j = np.nonzero((shared >= SHARED) & (_bits(differ) <= radius))
            keep = i + first < j
            join(i[keep] + first, j[keep])
    else:
        for mask in _masks(free, radius):
            near = values ^ mask
            at = np.minimum(np.searchsorted(values, near), len(values) - 1)
            i = np.flatnonzero((values[at] == near) & (near > values))
            join(i, at[i])
    roots = np.array([_root(parent, i) for i in range(len(values))], int)
    linked = roots != np.arange(len(values))
    return np.stack([values[linked], values[roots[linked]]], 1)


def _links(radius: int):
    blocks = position_blocks()

    def finish(block: int, fifth: int, held: list[np.ndarray]):
        free = [8 * p + b for p in range(8) if p not in blocks[block] and p != fifth for b in range(8)]
        return list_links(np.concatenate(held), radius, free if fifth >= 0 else None)

    def run(batches):
        last, held, out = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "fifth", "key")]
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                here = tuple(int(c[i]) for c in cols)
                if here != last and held:
                    out.append(finish(last[0], last[1], held))
                    held = []
                last = here
                held.append(values[i:j])
            if out:
                yield _pairs(np.concatenate(out))
                out = []
        if held:
            yield _pairs(finish(last[0], last[1], held))

    return run


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    signed = np.ascontiguousarray(pairs).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["a", "b"])


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` that connect the fingerprints within ``radius`` bits of each other.

    ``distinct(fingerprint)`` must be a stored table. Only links that a list's own components need are
    returned, so there are at most as many as index entries; all true links are implied by them.
    """
    if radius > 8 - SHARED:
        raise ValueError(f"the index holds for up to {8 - SHARED} bits")
    blocks = position_blocks()
    entries = distinct.select(
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _key(b).alias("key")) for i, b in enumerate(blocks)])).alias("_e"),
    ).select("fingerprint", "_e.block", "_e.key")
    sizes = entries.groupBy("block", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = stored(entries.join(sizes, ["block", "key"]))
    short = met.where(F.col("_n") <= LIST_LIMIT).select(
        "block", F.lit(-1).alias("fifth"), "key", "fingerprint"
    )
    fifths = F.array(
        *[
            F.when(
                F.col("block").isin([i for i, b in enumerate(blocks) if p not in b]),
                F.struct(F.lit(p).alias("fifth"), _byte(p).alias("byte")),
            )
            for p in range(8)
        ]
    )
    long = (
        met.where(F.col("_n") > LIST_LIMIT)
        .select("block", "key", "fingerprint", F.explode(F.array_compact(fifths)).alias("_f"))
        .select("block", "_f.fifth", (F.col("key") * 256 + F.col("_f.byte")).alias("key"), "fingerprint")
    )
    lists = short.union(long).repartition("block", "fifth", "key").sortWithinPartitions("block", "fifth", "key")
    return lists.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows with equal fingerprints (so all copies) are one node; the component is named by the smallest
    key in it. Null and wordless texts have fingerprint zero and link like any other; a null key is
    never the smallest unless a component has no other. Repeated keys are rows of their own.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")))
    labels = components(near_links(nodes.select("fingerprint"), radius))
    named = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_label")
    )
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    member = stored(named.join(least, "_label").select("fingerprint", "component_id"))
    return rows.join(member, "fingerprint").select("doc_id", "fingerprint", "component_id")
