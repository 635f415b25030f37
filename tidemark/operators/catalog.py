"""The catalog of chunks: statistics, months, sparse index, Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import bloom_positions, month_of


def chunk_entries(rows: DataFrame, bloom: bool = False) -> DataFrame:
    """A catalog row for each ``file`` of the rows: ranges, counts, a content hash and, if asked for, a Bloom filter.

    The content hash is made of sums of the rows' SHA-256 in four parts, so chunks aren't
    sorted or gathered for it, and the order of rows doesn't count.
    """
    columns = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in ("device_id", "seq", "ts", "id", "table", "body")]
    rows = rows.withColumn("_row", F.sha2(F.concat_ws(",", *columns), 256))
    parts = [F.sum(F.conv(F.substring("_row", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    entries = rows.groupBy("file", "table").agg(
        F.min("seq").alias("seq_min"),
        F.max("seq").alias("seq_max"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.count("*").alias("rows"),
        F.sum(F.octet_length("body") + F.octet_length("id") + F.octet_length("device_id") + 48).cast("bigint").alias("bytes"),
        F.sha2(F.concat_ws(":", *parts, F.count("*").cast("string")), 256).alias("sha256"),
        F.min("id").alias("min_key"),
        F.max("id").alias("max_key"),
    )
    entries = entries.withColumn("month", month_of(F.col("ts_min"))).withColumn("quarantined", F.lit(False))
    if not bloom:
        return entries
    bits = rows.select("file", F.explode_outer(bloom_positions(F.col("id"))).alias("bit")).groupBy("file").agg(F.sort_array(F.collect_set("bit")).alias("bloom"))  # 2048 bits at most
    return entries.join(bits, "file")


def month_pointers(chunks: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Chunks, rows, key and time ranges of each month; months of ``previous`` that have no chunk now stay."""
    now = chunks.where(~F.col("quarantined")).groupBy("month").agg(F.count("*").alias("chunks"), F.sum("rows").alias("rows"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))
    return now if previous is None else now.unionByName(previous.join(now, "month", "left_anti"))


def sparse_index(chunks: DataFrame) -> DataFrame:
    """Files by key range, quarantined ones left out; order by ``min_key`` to search it."""
    return chunks.where(~F.col("quarantined")).select("file", "min_key", "max_key", "seq_min", "month")


def append_entries(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The union of both, in which a file that was there keeps its entry."""
    return catalog.unionByName(new.join(catalog, "file", "left_anti"))


def dictionary_ranking(rows: DataFrame, cap_bytes: int = 32 * 1024, sample_rows: int = 10_000, span: int = 4096) -> DataFrame:
    """The most frequent bodies among the first rows of each table whose bytes, a separator each, fit the cap.

    What is ranked is bounded by ``sample_rows`` for each table, the definition of the ranking.
    Counts by stretch of numbers tell which stretches hold the first rows; only those are sorted.
    """
    from pyspark.sql import Window as W

    at = rows.withColumn("_part", F.floor(F.col("seq") / span))
    counts = at.groupBy("table", "_part").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("table").orderBy("_part")) - F.col("_n")).where(F.col("_before") < sample_rows)
    near = at.join(first.select("table", "_part"), ["table", "_part"], "left_semi").drop("_part")
    sample = near.withColumn("_n", F.row_number().over(W.partitionBy("table").orderBy("seq", "device_id"))).where(F.col("_n") <= sample_rows)
    counted = sample.groupBy("table", "body").agg(F.count("*").alias("n"), F.min("_n").alias("first"))
    upto = F.sum(F.octet_length("body") + 1).over(W.partitionBy("table").orderBy(F.desc("n"), "first"))
    return counted.withColumn("upto", upto).where(F.col("upto") <= cap_bytes).drop("first")
