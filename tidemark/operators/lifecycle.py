"""Cold segments, garbage, retention, status and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default alert limits (fixed values): (warn, critical).
UNACKED, QUARANTINED, FREE_MB = (5, 20), (1, 3), (100, 50)


def members(cold: DataFrame) -> DataFrame:
    return cold.select(F.col("file").alias("segment"), F.explode("chunks").alias("file"))


def merge_pending(chunks: DataFrame, cold: DataFrame) -> DataFrame:
    """Sound chunks that no segment holds."""
    return chunks.where(~F.col("quarantined")).join(members(cold), "file", "left_anti")


def orphans(files: DataFrame, chunks: DataFrame, acks: DataFrame) -> DataFrame:
    """Files outside the catalog, and whether the relay has them, so that they may go."""
    outside = files.join(chunks, "file", "left_anti")
    return outside.join(acks.select("sha256").distinct().withColumn("_a", F.lit(True)), "sha256", "left").select("file", "sha256", F.col("_a").isNotNull().alias("deletable"))


def dead_dictionaries(files: DataFrame, live: DataFrame) -> DataFrame:
    return files.join(live.distinct(), "dict_id", "left_anti")


def forget_check(targets: DataFrame, chunks: DataFrame, acks: DataFrame) -> DataFrame:
    """One row: targets, those unknown, those unacked, and whether all may be forgotten."""
    known = targets.join(chunks.select("file", "sha256"), "file", "left").join(acks.select("sha256").distinct().withColumn("_a", F.lit(True)), "sha256", "left")
    counts = known.agg(F.count("*").alias("targets"), F.count_if(F.col("sha256").isNull()).alias("unknown"), F.count_if(F.col("sha256").isNotNull() & F.col("_a").isNull()).alias("unacked"))
    return counts.withColumn("allowed", (F.col("unknown") == 0) & (F.col("unacked") == 0))


def cold_liveness(cold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live and dead members of each segment, and whether to keep, repack or prune it."""
    joined = members(cold).join(chunks.select("file", F.lit(True).alias("_l")), "file", "left")
    counts = joined.groupBy("segment").agg(F.count_if(F.col("_l").isNotNull()).alias("live"), F.count_if(F.col("_l").isNull()).alias("dead"))
    return counts.withColumn("action", F.when(F.col("live") == 0, "prune").when(F.col("dead") > 0, "repack").otherwise("keep"))


def status(chunks: DataFrame, cold: DataFrame, acks: DataFrame | None, files: DataFrame) -> DataFrame:
    """One row of counts.  Without a relay every chunk counts as unacked."""
    main = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if("quarantined").alias("quarantined"))
    unacked = (chunks if acks is None else chunks.join(acks, "sha256", "left_anti")).agg(F.count("*").alias("unacked"))
    lost = files.join(chunks, "file", "left_anti").agg(F.count("*").alias("orphans"))
    segments = cold.agg(F.count("*").alias("segments"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("cold_bytes"))
    return main.join(F.broadcast(unacked)).join(F.broadcast(lost)).join(F.broadcast(segments))  # of one row each


def alerts(state: DataFrame) -> DataFrame:
    """``level`` (ok, warn, critical) and ``reasons`` from ``unacked``, ``quarantined`` and ``free_mb``."""
    rungs = [("unacked", lambda c, n: c >= n, UNACKED), ("quarantined", lambda c, n: c >= n, QUARANTINED), ("free_mb", lambda c, n: c < n, FREE_MB)]
    critical = [F.when(test(F.col(c), limits[1]), f"{c}:critical") for c, test, limits in rungs]
    warn = [F.when(test(F.col(c), limits[0]) & ~test(F.col(c), limits[1]), f"{c}:warn") for c, test, limits in rungs]
    reasons = F.array_compact(F.array(*[x for pair in zip(critical, warn, strict=True) for x in pair]))
    level = F.when(F.exists(reasons, lambda r: r.endswith("critical")), "critical").when(F.size(reasons) > 0, "warn").otherwise("ok")
    return state.withColumn("level", level).withColumn("reasons", F.array_join(reasons, ","))
