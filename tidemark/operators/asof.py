"""State as of a time or a sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(ts: int | None = None, seq: int | None = None, window_ms: int | None = None, window_seq: int | None = None) -> tuple[str, int, int | None]:
    """The column, the target, and the floor above which rows count (exclusive), once arguments are checked."""
    if (ts is None) == (seq is None):
        raise ValueError("give either ts or seq")
    if window_ms is not None and ts is None or window_seq is not None and seq is None:
        raise ValueError("window_ms goes with ts, window_seq with seq")
    column, target, window = ("ts", ts, window_ms) if ts is not None else ("seq", seq, window_seq)
    if target < 0 or window is not None and window < 0:
        raise ValueError("targets and windows aren't negative")
    return column, target, None if window is None else target - window


def as_of(rows: DataFrame, **at: int) -> DataFrame:
    """The latest row of each id up to the target, within the window if one is given.

    The filter reaches the scan; the winner is one aggregate with partial sums, so no
    history of an id is gathered.  Of rows with equal (seq, ts) the one of the first
    chunk wins if rows carry ``chunk_seq_min``, ``file`` and ``pos``.
    """
    column, target, floor = bounds(**at)
    kept = rows.where(F.col(column) <= target)
    if floor is not None:
        kept = kept.where(F.col(column) > floor)
    ties = [c for c in ("chunk_seq_min", "pos") if c in rows.columns]
    order = F.struct("seq", "ts", *[-F.col(c) for c in ties])
    columns = [c for c in rows.columns if c != "id"]
    return kept.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("_w")).select("id", "_w.*").select(*rows.columns)


def prune(chunks: DataFrame, **at: int) -> DataFrame:
    """Chunks with ``kept``: whether they can hold rows that count.  Quarantined ones are pruned."""
    column, target, floor = bounds(**at)
    kept = ~F.col("quarantined") & (F.col(f"{column}_min") <= target)
    if floor is not None:
        kept = kept & (F.col(f"{column}_max") > floor)
    return chunks.withColumn("kept", kept)


def proof(chunks: DataFrame, present: DataFrame, **at: int) -> DataFrame:
    """One row: chunks consulted, pruned, and kept but missing from ``present`` (files there)."""
    there = prune(chunks, **at).join(present.select("file").distinct().withColumn("there", F.lit(True)), "file", "left")
    missing = F.col("kept") & F.col("there").isNull()
    return there.agg(F.count_if(F.col("kept") & ~missing).alias("consulted"), F.count_if(~F.col("kept")).alias("pruned"), F.count_if(missing).alias("skipped_missing"))


def assert_complete(proof_row) -> None:
    if proof_row["skipped_missing"]:
        raise RuntimeError(f"{proof_row['skipped_missing']} chunks are missing")
