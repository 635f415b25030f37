"""Time series: buckets, anomalies, routing."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import bloom_positions


def downsample(points: DataFrame, bucket_ms: int, by: list[str], flag: str | None = None, position: str = "seq") -> DataFrame:
    """Count, extremes, sum, mean, first and last value, and whether any point is flagged, by bucket."""
    if bucket_ms <= 0:
        raise ValueError("bucket_ms must be positive")
    t0 = F.col("ts") - F.pmod(F.col("ts"), F.lit(bucket_ms))
    order = F.struct("ts", position)
    return (
        points.where(~F.isnan("value"))
        .groupBy(*by, t0.alias("t0"))
        .agg(
            F.count("*").alias("count"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.sum("value").alias("sum"),
            F.avg("value").alias("avg"),
            F.min_by("value", order).alias("first"),
            F.max_by("value", order).alias("last"),
            (F.bool_or(flag) if flag else F.lit(False)).alias("anomalous"),
        )
        .withColumn("t1", F.col("t0") + bucket_ms)
    )


def _with_halo(points: DataFrame, by: list[str], window: int, position: str, span_ms: int) -> DataFrame:
    """Points in stretches of time (``_part``), and before each stretch (``_halo``) the ``window`` points in front of it.

    A stretch has a point at least, so the last points of ``window`` stretches are enough.
    """
    at = points.withColumn("_part", F.floor(F.col("ts") / span_ms))
    latest = W.partitionBy(*by, "_part").orderBy(F.desc("ts"), F.desc(position))
    ends = at.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= window)
    tails = ends.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct("ts", position, "value"))).alias("_tail"))  # ``window`` points
    before = F.flatten(F.collect_list("_tail").over(W.partitionBy(*by).orderBy("_part").rowsBetween(-window, -1)))
    front = tails.withColumn("_front", before)
    ghosts = front.select(*by, "_part", F.explode(F.slice("_front", -F.greatest(F.least(F.size("_front"), F.lit(window)), F.lit(1)), F.lit(window))).alias("_g"))
    halo = ghosts.select(*by, "_part", "_g.*", F.lit(True).alias("_halo"))
    return at.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def flag_first_pass(points: DataFrame, by: list[str], window: int = 10, z: float = 3.0, position: str = "seq", span_ms: int = 86_400_000) -> DataFrame:
    """``flagged``: how far a value lies from the points before it, ``window`` at most; constant ones flag any other value.

    Only points of a stretch of ``span_ms`` are sorted together, with a halo from before it.
    """
    before = W.partitionBy(*by, "_part").orderBy("ts", position).rowsBetween(-window, -1)
    n, mean, std = F.count("value").over(before), F.avg("value").over(before), F.stddev_pop("value").over(before)
    far = F.when(std == 0, F.col("value") != mean).otherwise(F.abs(F.col("value") - mean) > z * std)
    flagged = _with_halo(points, by, window, position, span_ms).withColumn("flagged", F.coalesce((n >= min(3, window)) & far, F.lit(False)))
    return flagged.where("not _halo").select(*points.columns, "flagged")


def flag_two_passes(points: DataFrame, by: list[str], window: int = 10, z: float = 3.0, position: str = "seq") -> DataFrame:
    """First pass, then values far from the last ``window`` clean points, which neither pass flagged.

    A flagged point never enters the baseline, so the second pass is a fold along the
    series: one series is one sorted group.
    """
    least = min(3, window)
    first = flag_first_pass(points, by, window, z, position)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", position], kind="stable")
        clean: deque[float] = deque(maxlen=window)
        out = []
        for value, flagged in zip(group["value"], group["flagged"], strict=True):
            if not flagged and len(clean) >= least:
                mean = sum(clean) / len(clean)
                std = (sum((x - mean) ** 2 for x in clean) / len(clean)) ** 0.5
                flagged = value != mean if std == 0 else abs(value - mean) > z * std
            if not flagged:
                clean.append(value)
            out.append(bool(flagged))
        return group.assign(flagged=out)

    return first.groupBy(*by).applyInPandas(fold, first.schema)


def anomaly_filter(points: DataFrame, by: list[str]) -> DataFrame:
    """Bits of a Bloom filter over the ids of flagged points, for each group: 2048 at most."""
    bits = points.where("flagged").select(*by, F.explode_outer(bloom_positions(F.col("id"))).alias("bit"))
    return bits.groupBy(*by).agg(F.sort_array(F.collect_set("bit")).alias("bloom"))


def route(points: DataFrame, cold_before: int, anomaly_to_cold: bool = True) -> DataFrame:
    """``tier`` (hot or cold) and ``quarantined`` of each point; quarantined ones lie in the cold tier."""
    bad = F.col("flagged") if anomaly_to_cold else F.lit(False)
    return points.withColumn("tier", F.when((F.col("ts") < cold_before) | bad, "cold").otherwise("hot")).withColumn("quarantined", bad)


def buckets_to_rows(buckets: DataFrame, table: str, device: str, start_after: int = 0, span_ms: int = 86_400_000) -> DataFrame:
    """Archive rows of buckets, numbered on from ``start_after`` in the order of time."""
    from tidemark.operators.seal import running_total

    one = buckets.withColumn("_one", F.lit(1))
    numbered = running_total(one.withColumn("_k", F.lit(table)), ["_k"], "t0", "_one", span_ms, "n")
    body = F.to_json(F.struct("t0", "count", "min", "max", "first", "last", "anomalous"))
    return numbered.select(F.lit(device).alias("device_id"), (F.col("n") + start_after).alias("seq"), F.col("t0").alias("ts"), F.concat(F.lit("sensor-"), F.col("t0")).alias("id"), F.lit(table).alias("table"), body.alias("body"))


def series_hash(points: DataFrame, by: list[str], span: int = 1000) -> DataFrame:
    """A hash of each series: of hashes of its stretches of ``span`` sequence numbers, so that no series is one group."""
    line = F.concat_ws(",", F.col("ts").cast("string"), F.format_string("%.4f", "value"), "id")
    parts = points.groupBy(*by, F.floor(F.col("seq") / span).alias("part")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("h"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("sha256"))


