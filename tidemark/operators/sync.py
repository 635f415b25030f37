"""Set differences between archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import lane_of


def ship_plan(chunks: DataFrame, acks: DataFrame, blobs: bool = False) -> DataFrame:
    """Every chunk with its lane and what becomes of it: ship, or why not."""
    there = chunks.join(acks.select("sha256").distinct().withColumn("_a", F.lit(True)), "sha256", "left")
    lane = lane_of(F.col("table"))
    reason = F.when(F.col("quarantined"), "quarantined").when((lane == 1) & F.lit(not blobs), "blob-deferred").when(F.col("_a").isNotNull(), "already-acked").otherwise("ship")
    return there.select("file", "table", lane.alias("lane"), "seq_min", "bytes", "sha256", reason.alias("action"))


def ship_plans(chunks: DataFrame, acks: DataFrame, relays: list[str], blobs: bool = False) -> DataFrame:
    """``ship_plan`` for each relay, by what that relay acknowledged."""
    plans = [ship_plan(chunks, acks.where(F.col("relay") == r), blobs).withColumn("relay", F.lit(r)) for r in relays]
    return reduce(DataFrame.unionByName, plans)


def ship_order(plan: DataFrame) -> DataFrame:
    """What is to be shipped in the order of shipping: text before blobs, then by number."""
    return plan.where("action = 'ship'").orderBy("lane", "seq_min", "file")


def ship_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


def want(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What each side lacks of the other, by content hash."""
    pull = remote.join(local, "sha256", "left_anti").select("sha256", F.lit("pull").alias("direction"))
    return pull.unionByName(local.join(remote, "sha256", "left_anti").select("sha256", F.lit("push").alias("direction")))
