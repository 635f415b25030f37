"""Stable assignment of rows to shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Multiplier of the generator in Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm".
JUMP_MULTIPLIER = 2862933555777941757
#: Sub-buckets of a shard within which rows are numbered; each is sorted on its own.
SLOT_BUCKETS = 1024


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key; with one more shard a key stays or moves into the new one."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.float64)
    active = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(active):
            shard[active] = jump[active].astype(np.int64)
            state[active] = state[active] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            step = float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[active] = np.floor((shard[active] + 1) * step)
            active = active[jump[active] < n_shards]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its shard, its place there, and its shard were there one more.

    The law is ``key``: the id and the shard count alone decide, so any worker can
    place a row without a table of shards.  Places count from 0 without a gap.
    Every shard is numbered in sub-buckets, whose counts (at most
    ``n_shards * SLOT_BUCKETS`` rows) give the offsets; no task sorts a shard.

    A null text has size 1 and checksum 0; a null id is a key like any other; repeated
    rows each get a place, equal ids meet in one shard; an empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")

    @F.pandas_udf("struct<shard int, grown_shard int>")
    def place(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(np.int64)
        return pd.DataFrame({"shard": jump_hash(keys, n_shards).astype(np.int32), "grown_shard": jump_hash(keys, n_shards + 1).astype(np.int32)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"))
    placed = own.select("*", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"), place("key").alias("at")).select("*", "at.*").drop("at")
    counts = (
        docs.select(key.alias("key"))
        .select(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"), place("key")["shard"].alias("shard"))
        .groupBy("shard", "bucket")
        .count()
    )
    before = counts.select("shard", "bucket", (F.sum("count").over(W.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "bytes")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before), ["shard", "bucket"])
        .select(
            "doc_id",
            (F.col("bytes") + 1).alias("size"),
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("within")).alias("slot"),
            "grown_shard",
        )
    )
