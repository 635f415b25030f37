"""Point lookups and the pruning of chunks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import bloom_may_contain, synthetic_id


def matches(key: str) -> Column:
    """Rows with that id, or with that table, device and number in the qualified form."""
    return (F.col("id") == key) | (synthetic_id(F.col("table"), F.col("device_id"), F.col("seq")) == key)


def candidates(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks with ``hit``: ranges (and Bloom filters, if there) don't rule the key out.  Unknown ranges rule nothing out."""
    within = F.coalesce((F.col("min_key") <= key) & (F.col("max_key") >= key), F.lit(True))
    maybe = bloom_may_contain(F.col("bloom"), F.lit(key)) if "bloom" in chunks.columns else F.lit(True)
    return chunks.withColumn("hit", ~F.col("quarantined") & within & maybe)


def segments_for(cold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Segments that hold a candidate chunk, and which of theirs: no other segment needs a look."""
    held = cold.select(F.col("file").alias("segment"), F.explode("chunks").alias("file"))
    return held.join(candidates.where("hit").select("file"), "file", "left_semi").select("segment", "file")


def months_for(pointers: DataFrame, key: str) -> DataFrame:
    """Months whose key range holds the key: a filter for partitions."""
    return pointers.where((F.col("min_key") <= key) & (F.col("max_key") >= key)).select("month")


def find(rows: DataFrame, key: str) -> DataFrame:
    """All rows that match; equality on ``id`` goes down to the scan when the key isn't a qualified one."""
    return rows.where(matches(key) if "\x1f" in key else F.col("id") == key)


def find_first(rows: DataFrame, key: str) -> DataFrame:
    """The first match by sequence number and device."""
    return find(rows, key).orderBy("seq", "device_id", "table").limit(1)
