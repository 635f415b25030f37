"""Audits: sequence chains, hashes, photos, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.seal import running_total

def chain(chunks: DataFrame) -> DataFrame:
    """Where a chunk starts before the one in front of it ends (``break``), or leaves numbers out (``gap``, how many).

    One row for each chunk, not row, is sorted by table.
    """
    order = W.partitionBy("table").orderBy("seq_min", "file")
    sound = chunks.where(~F.col("quarantined") & (F.col("rows") > 0))
    beside = sound.select("table", "file", "seq_min", F.lag("file").over(order).alias("after"), F.lag("seq_max").over(order).alias("prev_max"))
    kind = F.when(F.col("seq_min") <= F.col("prev_max"), "break").when(F.col("seq_min") > F.col("prev_max") + 1, "gap")
    return beside.withColumn("kind", kind).where("kind is not null").select("table", "after", "file", "kind", F.when(F.col("kind") == "gap", F.col("seq_min") - F.col("prev_max") - 1).otherwise(0).alias("missing"))


def verify(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """OK, CORRUPT, MISSING or QUARANTINED for each chunk, against the hashes of what was found."""
    seen = found.select("file", F.col("sha256").alias("found_sha"), F.col("rows").alias("found_rows"))
    both = chunks.join(seen, "file", "left")
    wrong = (F.col("found_sha") != F.col("sha256")) | (F.col("found_rows") != F.col("rows"))
    status = F.when(F.col("quarantined"), "QUARANTINED").when(F.col("found_sha").isNull(), "MISSING").when(wrong, "CORRUPT").otherwise("OK")
    reason = F.concat_ws(",", F.when(F.col("found_sha") != F.col("sha256"), "sha256"), F.when(F.col("found_rows") != F.col("rows"), "rows"))
    return both.select("file", "table", status.alias("status"), reason.alias("reason"))


def verdict(statuses: DataFrame, links: DataFrame) -> DataFrame:
    """One row: whether all chunks are sound and no chain is broken; gaps don't count against it."""
    counts = statuses.agg(F.count("*").alias("chunks"), F.count_if(F.col("status") != "OK").alias("bad"))
    broken = links.agg(F.count_if(F.col("kind") == "break").alias("breaks"), F.count_if(F.col("kind") == "gap").alias("gaps"))
    return counts.join(F.broadcast(broken)).withColumn("ok", (F.col("bad") == 0) & (F.col("breaks") == 0))  # of one row each


def repair_plan(statuses: DataFrame, chunks: DataFrame, relay: DataFrame) -> DataFrame:
    """Chunks that aren't sound with whether the relay holds bytes of their hash."""
    wanted = statuses.where("status in ('CORRUPT', 'MISSING', 'QUARANTINED')").join(chunks.select("file", "sha256"), "file")
    return wanted.join(relay.select("sha256").distinct().withColumn("r", F.lit(True)), "sha256", "left").select("file", "status", F.col("r").isNotNull().alias("repairable"))


def photo_audit(refs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Referenced photos and files on disk, both ways: ok, size, missing or orphan."""
    r, f = refs.select("sha", "size").distinct(), sidecars.select("sha", F.col("size").alias("file_size")).distinct()
    both = r.join(f, "sha", "full")
    status = F.when(F.col("size").isNull(), "orphan").when(F.col("file_size").isNull(), "missing").when(F.col("size") != F.col("file_size"), "size").otherwise("ok")
    return both.select("sha", status.alias("status"))


def with_before(rows: DataFrame, by: list[str], columns: list[str], span: int) -> DataFrame:
    """Rows with ``before``: the columns of the row in front by number, null at the first.

    Only rows of a stretch of ``span`` numbers are sorted together; the last rows of
    stretches, one each, tell what comes before the next.
    """
    at = rows.withColumn("_part", F.floor(F.col("seq") / span))
    own = F.struct(*columns)
    edges = at.groupBy(*by, "_part").agg(F.max_by(own, "seq").alias("_last"))
    edges = edges.select(*by, "_part", F.lag("_last").over(W.partitionBy(*by).orderBy("_part")).alias("_edge"))
    within = F.lag(own).over(W.partitionBy(*by, "_part").orderBy("seq"))
    return at.withColumn("_within", within).join(edges, [*by, "_part"]).withColumn("before", F.coalesce("_within", "_edge")).drop("_part", "_within", "_edge")


def delta_encode(rows: DataFrame, by: list[str], span: int = 1 << 16) -> DataFrame:
    """Differences of numbers and times to the row before; 0 for the first."""
    d = lambda c: F.coalesce(F.col(c) - F.col(f"before.{c}"), F.lit(0)).alias(f"d_{c}")
    return with_before(rows, by, ["seq", "ts"], span).select(*rows.columns, d("seq"), d("ts"))


def runs(rows: DataFrame, by: list[str], column: str, span: int = 1 << 16) -> DataFrame:
    """Runs of equal values in the order of numbers: value, first number, length."""
    starts = F.col("before").isNull() | ~F.col(column).eqNullSafe(F.col(f"before.{column}"))
    marked = with_before(rows, by, ["seq", column], span).withColumn("_new", starts.cast("int")).drop("before")
    numbered = running_total(marked, by, "seq", "_new", span, "_run")
    return numbered.groupBy(*by, "_run").agg(F.first(column).alias(column), F.min("seq").alias("first_seq"), F.count("*").alias("length")).drop("_run")


def expand_runs(encoded: DataFrame, column: str) -> DataFrame:
    """The inverse of ``runs``: the value once for each row."""
    return encoded.select("*", F.posexplode(F.array_repeat(F.col(column), F.col("length").cast("int"))).alias("offset", "_v")).drop("_v")
