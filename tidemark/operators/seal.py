"""Taking rows in: watermarks, keep-last, bounds and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["table", "device_id", "seq"]


def after_watermark(rows: DataFrame, watermark: DataFrame) -> DataFrame:
    """Rows with ``skipped``: whether their sequence number is at most their device's mark (or the one for all, under '')."""
    everyone = watermark.where("device_id = ''").agg(F.max("high").alias("all_high"))
    own = watermark.where("device_id <> ''").select(F.col("device_id").alias("d"), "high")
    marked = rows.join(own, F.col("device_id") == F.col("d"), "left").join(F.broadcast(everyone))  # of one row
    return marked.withColumn("skipped", F.col("seq") <= F.coalesce(F.greatest("high", "all_high"), F.lit(0))).drop("d", "high", "all_high")


def advance_watermark(watermark: DataFrame, rows: DataFrame) -> DataFrame:
    """Marks raised to the largest sequence number of each device."""
    return watermark.select("device_id", "high").unionByName(rows.select("device_id", F.col("seq").alias("high"))).groupBy("device_id").agg(F.max("high").alias("high"))


def keep_last(rows: DataFrame, position: str = "pos") -> DataFrame:
    """The last row of each table, device and sequence number by input position: one partial sum, no sort of groups."""
    columns = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*columns), position).alias("_l")).select(*KEY, "_l.*").select(*rows.columns)


def replaced(rows: DataFrame, position: str = "pos") -> DataFrame:
    """How often a row of a key differs in body from the one before, by table."""
    before = F.lag("body").over(W.partitionBy(*KEY).orderBy(position))
    return rows.select("table", (before.isNotNull() & (before != F.col("body"))).alias("r")).groupBy("table").agg(F.count_if("r").alias("replaced"))


def bounded(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by sequence number, device and position, and all others with the last one's (device, seq).

    Cutting between rows of one device and number would lose the rest to the watermark.
    """
    head = rows.orderBy("seq", "device_id", "pos").limit(n)
    last = head.agg(F.max_by(F.struct("seq", "device_id"), F.struct("seq", "device_id")).alias("l")).select("l.*").withColumnsRenamed({"seq": "s", "device_id": "d"})
    return rows.join(F.broadcast(last), (F.col("seq") < F.col("s")) | ((F.col("seq") == F.col("s")) & (F.col("device_id") <= F.col("d"))), "left_semi")


def running_total(rows: DataFrame, by: list[str], order: str, value: str, span: int, name: str = "upto") -> DataFrame:
    """Sum of ``value`` up to and with each row in the order of a whole number, in two levels.

    Rows are summed by stretches of ``span`` numbers, the stretches' totals give
    offsets, and only rows of one stretch are sorted together.
    """
    part = F.floor(F.col(order) / span)
    totals = rows.groupBy(*by, part.alias("_part")).agg(F.sum(value).alias("_t"))
    before = totals.select(*by, "_part", (F.sum("_t").over(W.partitionBy(*by).orderBy("_part")) - F.col("_t")).alias("_before"))
    within = F.sum(value).over(W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_part", part).withColumn("_w", within).join(before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def pack(rows: DataFrame, target_bytes: int, span: int = 4096, by: list[str] | None = None) -> DataFrame:
    """Rows of a table (or of each group of ``by``) in runs of about ``target_bytes``: ``chunk_no`` counts the targets filled before a row."""
    size = (F.octet_length("body") + F.octet_length("id") + F.octet_length("device_id") + 48).cast("long")
    sized = rows.withColumn("row_bytes", size)
    return running_total(sized, by or ["table"], "seq", "row_bytes", span).withColumn("chunk_no", F.expr(f"(upto - row_bytes) div {target_bytes}")).drop("upto")
