"""Continuous sealing and downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.normalize import normalize
from tidemark.plans.archive import Archive


def seal_stream(spark: SparkSession, hot_dir: str, archive: Archive, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Seal new files of JSON lines as they come; the marks of devices, not event time, decide what is late.

    A batch that runs again after a failure seals nothing twice: catalog and marks are one
    generation, and rows at or below a device's mark are skipped.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(hot_dir)
    seal = lambda batch, _: archive.seal(normalize(batch.withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != ""), "value").drop("value"))
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(seal).start()


def downsample_stream(points: DataFrame, bucket: str, delay: str, by: list[str]) -> DataFrame:
    """Tumbling aggregates of a stream with ``ts`` in milliseconds; buckets close ``delay`` after their end."""
    timed = points.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", bucket), *by).agg(
        F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min_by("value", F.struct("ts", "seq")).alias("first"), F.max_by("value", F.struct("ts", "seq")).alias("last")
    ).select(F.unix_millis("window.start").alias("t0"), F.unix_millis("window.end").alias("t1"), *by, "count", "min", "max", "sum", "avg", "first", "last")
