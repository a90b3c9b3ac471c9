"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.plans.ordering import row_index


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that wins ``key``: the least of -ln(u) / weight, u drawn from (key, shard).

    A shard's draws depend on nothing but the key and its own number, so a new shard can only take
    keys for itself, a removed one only gives its own away, and a shard wins keys in proportion to
    its weight. A null key draws like any other key.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive and name a shard at least")
    draws = []
    for shard, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard)).cast("long")), 11).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(int(shard)).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def shard_documents(
    docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], id_col="doc_id", text_col="text"
) -> DataFrame:
    """Shard and slot of every row, and its shard once ``grown`` holds.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Rows with equal keys share a
    shard; each row, repeated ones too, has a slot of its own, counted from 0 in key order. A null
    text has size 1 and the checksum of nothing. Other columns are not looked at.
    """
    body = F.coalesce(ref(text_col).cast("string"), F.lit("")).cast("binary")
    key = ref(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
    )
    numbered = row_index(placed, ["doc_id", "size", "text_crc32"], ["shard"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
