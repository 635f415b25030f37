"""Side stores: content-addressed objects, bundles, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLAIM_TTL_MS = 15 * 60 * 1000
#: Attempts of a claim that are dealt to one task, about, and cells by which claims are counted.
CROWD, CELLS = 100_000, 1 << 16


def put(objects: DataFrame, new: DataFrame, content: str = "content") -> DataFrame:
    """Objects with each new content stored once under its hash."""
    fresh = new.select(F.sha2(F.col(content), 256).alias("sha"), F.col(content).alias("content")).dropDuplicates(["sha"])
    return objects.unionByName(fresh.join(objects, "sha", "left_anti"))


def refcounts(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """How many owners each object has, and the first and last by name."""
    own = refs.select("sha", "owner").distinct().groupBy("sha").agg(F.count("*").alias("refs"), F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner"))
    return objects.select("sha").join(own, "sha", "left").select("sha", F.coalesce("refs", F.lit(0)).alias("refs"), "first_owner", "last_owner")


def link(refs: DataFrame, new: DataFrame, objects: DataFrame) -> DataFrame:
    """References (``sha``, ``owner``) with new ones to objects that are there; each counts once."""
    return refs.select("sha", "owner").unionByName(new.select("sha", "owner").join(objects, "sha", "left_semi")).distinct()


def unlink(refs: DataFrame, gone: DataFrame) -> DataFrame:
    return refs.select("sha", "owner").join(gone.select("sha", "owner"), ["sha", "owner"], "left_anti")


def get(objects: DataFrame, sha: str) -> bytes:
    """The content under a hash, checked."""
    row = objects.where(F.col("sha") == sha).select("content", F.sha2("content", 256).alias("found")).first()
    if row is None:
        raise FileNotFoundError(sha)
    if row["found"] != sha:
        raise ValueError(f"object {sha} is damaged")
    return bytes(row["content"])


def garbage(objects: DataFrame, refs: DataFrame) -> DataFrame:
    return objects.select("sha").join(refs, "sha", "left_anti")


def pack_bundles(parts: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """For each bundle its references by name (hash and size) as one hash, with their number and bytes.

    Names must be distinct in a bundle; one that is empty or a path is an error.
    """
    fine = F.coalesce((F.length(name) > 0) & ~F.col(name).contains("/") & ~F.col(name).contains("\\") & ~F.col(name).contains(".."), F.lit(False))
    checked = F.when(fine, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("bad name: "), F.coalesce(F.col(name), F.lit("null")))))
    ref = F.struct(checked.alias("name"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("bigint").alias("bytes"))
    packed = parts.groupBy(key).agg(F.sort_array(F.collect_list(ref)).alias("refs"))  # of one bundle
    line = lambda r: F.concat_ws(" ", r["name"], r["sha256"], r["bytes"].cast("string"))
    return packed.select(key, F.size("refs").alias("n_refs"), F.aggregate("refs", F.lit(0).cast("bigint"), lambda a, r: a + r["bytes"]).alias("bytes"), F.sha2(F.array_join(F.transform("refs", line), "\n"), 256).alias("sha256"))


def verify_bundles(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Every reference with what is wrong with its file: nothing, missing, size or hash."""
    both = refs.join(files.select("name", F.col("sha256").alias("f_sha"), F.col("bytes").alias("f_bytes")), "name", "left")
    wrong = F.when(F.col("f_sha").isNull(), "missing").when(F.col("bytes") != F.col("f_bytes"), "size").when(F.col("sha256") != F.col("f_sha"), "sha256").otherwise("ok")
    return both.select("name", wrong.alias("status"))


def _crowded(attempts: DataFrame, crowd: int) -> DataFrame:
    """Claims (null too) with more than ``crowd`` attempts: in how many ``_shares`` to deal these, and the ``_first`` in time.

    The driver gets one row for ``crowd`` attempts at most. Counts by cell tell which few claims are counted in full.
    """
    cell = F.pmod(F.xxhash64("claim"), F.lit(CELLS))
    full = attempts.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("_cell")
    near = attempts.withColumn("_cell", cell).join(F.broadcast(full), "_cell", "left_semi")
    counted = near.groupBy(F.col("claim").alias("_claim")).agg(F.count("*").alias("_n"), F.min(F.struct("used_at", "attempt")).alias("_first")).where(F.col("_n") > crowd)
    found = counted.select("_claim", F.ceil(F.col("_n") / crowd).alias("_shares"), "_first")
    return attempts.sparkSession.createDataFrame(found.collect(), found.schema)


def use_claims(claims: DataFrame, attempts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Outcome of each attempt: unknown, expired, ok for the first in time, double-use for later ones.

    Attempts of unknown or expired claims aren't counted. A claim that very many attempts name is dealt
    in shares, on both sides of the join; the first of a share is ok if it is the first of all, which is
    counted if any is.
    """
    crowded = F.broadcast(_crowded(attempts, crowd))
    same = F.col("claim").eqNullSafe(F.col("_claim"))
    share = F.coalesce(F.pmod(F.xxhash64("used_at", "attempt"), F.col("_shares")), F.lit(0)) + 1
    dealt = attempts.join(crowded, same, "left").select("attempt", "claim", "used_at", share.alias("_share"))
    shares = F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_shares", F.lit(1))))
    known = claims.select("claim", "expires_at").join(crowded, same, "left").select("claim", "expires_at", "_first", shares.alias("_share"))
    both = dealt.join(known, ["claim", "_share"], "left")
    fate = F.when(F.col("expires_at").isNull(), "unknown").when(F.col("used_at") > F.col("expires_at"), "expired")
    counted = both.withColumn("fate", fate)
    nth = F.row_number().over(W.partitionBy("claim", "_share", F.col("fate").isNull()).orderBy("used_at", "attempt"))
    first = (nth == 1) & (F.col("_first").isNull() | F.struct("used_at", "attempt").eqNullSafe(F.col("_first")))
    return counted.select("attempt", "claim", F.coalesce("fate", F.when(first, "ok").otherwise("double-use")).alias("outcome"))


def reconcile(outcomes: DataFrame, server: DataFrame) -> DataFrame:
    """Used claims against the server's: ``double`` used here, ``local`` only, ``remote`` only, ``clean``.  A double use is local too if the server lacks it."""
    used = outcomes.where("outcome in ('ok', 'double-use')").groupBy("claim").agg(F.bool_or(F.col("outcome") == "double-use").alias("double"))
    both = used.join(server.select("claim").distinct().withColumn("s", F.lit(True)), "claim", "full")
    here, there, double = F.col("double").isNotNull(), F.col("s").isNotNull(), F.coalesce("double", F.lit(False))
    kinds = F.array_compact(F.array(F.when(double, "double"), F.when(here & ~there, "local"), F.when(~here & there, "remote"), F.when(here & there & ~double, "clean")))
    return both.select("claim", F.explode(kinds).alias("kind"))
