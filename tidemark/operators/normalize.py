"""Schemaless records to archive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import base64_size, synthetic_id, to_int
from tidemark.model import SEQ_MAX

# Alias keys of each target, in order of priority.
SEQ_KEYS = ("seq", "no")
TS_KEYS = ("ts", "timestamp", "waktu", "now")
KIND_KEYS = ("type", "event", "kind")
ID_KEYS = ("id", "trxId", "trx_id", "trx", "key")
DEVICE_KEYS = ("device_id", "device")
BODY_KEYS = ("body", "payload", "msg", "data", "note", "details")
TOKEN_KEYS = {"value": ("value", "total"), "actor": ("actor",), "ref": ("ref", "event_id", "reverses"), "reason": ("reason",), "item": ("item",), "qty": ("qty",), "state": ("state",), "hides": ("hides",), "shows": ("shows",)}

ALIASES = sorted({*SEQ_KEYS, *TS_KEYS, *KIND_KEYS, *ID_KEYS, *DEVICE_KEYS, *BODY_KEYS, "table", *(k for ks in TOKEN_KEYS.values() for k in ks)})
_SCHEMA = ", ".join(f"`{k}` string" for k in ALIASES)


def _first(get, keys) -> Column:
    return F.coalesce(*[get(k) for k in keys])


def normalize(records: DataFrame, column: str = "value", fallback_table: str = "log", now_ms: int = 0) -> DataFrame:
    """JSON texts to rows, with ``malformed`` for those that are none; other columns stay.

    Values are taken by alias in order of priority; a key with a JSON null counts as
    absent.  An object under ``payload`` backs tokens that the record itself lacks.
    ``seq`` must be a whole number from 1 to the largest, ``ts`` one from 0 on;
    a missing ``ts`` becomes ``now_ms``, which is a parameter so that results repeat.
    Null and blank texts give malformed rows; blank lines are for the caller to skip.
    """
    text = F.regexp_replace(F.col(column), "^" + chr(0xFEFF), "")
    payload = F.when(F.col("_r.payload").startswith("{"), F.from_json("_r.payload", _SCHEMA))
    # each text is parsed once: a projection would be folded into every use of a parsed value, a generator isn't
    parsed = records.select("*", F.explode(F.array(F.from_json(text, _SCHEMA))).alias("_r")).select("*", F.explode(F.array(payload)).alias("_p"))
    own, inner = (lambda k: F.col(f"_r.`{k}`")), (lambda k: F.col(f"_p.`{k}`"))
    seq = to_int(_first(own, SEQ_KEYS))
    ts_text = _first(own, TS_KEYS)
    ts = F.when(ts_text.isNull(), F.lit(now_ms).cast("bigint")).otherwise(to_int(ts_text))
    kind = _first(own, KIND_KEYS)
    device = F.coalesce(_first(own, DEVICE_KEYS), F.lit("dev0"))
    table = F.coalesce(own("table"), kind, F.lit(fallback_table))
    plain = [F.when(F.col("_p").isNull(), own(k)) if k == "payload" else own(k) for k in BODY_KEYS]
    tokens = [F.concat(F.lit(f"{name}="), F.coalesce(_first(own, keys), _first(inner, keys))) for name, keys in TOKEN_KEYS.items()]
    body = F.coalesce(*plain, inner("note"), inner("details"))
    composed = F.concat_ws(" ", kind, *tokens)
    good = F.col("_r").isNotNull() & seq.between(1, SEQ_MAX) & (ts >= 0)
    rows = parsed.select(
        *records.columns,
        device.alias("device_id"),
        seq.alias("seq"),
        ts.alias("ts"),
        F.coalesce(_first(own, ID_KEYS), synthetic_id(table, device, seq)).alias("id"),
        table.alias("table"),
        F.coalesce(F.when(F.length(body) > 0, body), composed).alias("body"),
        (~F.coalesce(good, F.lit(False))).alias("malformed"),
    )
    return rows


def malformed_gate(normalized: DataFrame, limit: float = 0.01) -> DataFrame:
    """One row: records, malformed ones, and whether they are too many to go on."""
    counts = normalized.agg(F.count("*").alias("total"), F.count_if("malformed").alias("malformed"))
    return counts.withColumn("aborts", F.col("malformed") > F.col("total") * limit)


def photo_gate(rows: DataFrame, limit_bytes: int = 256 * 1024) -> DataFrame:
    """Rows whose base64 body decodes to more than the limit get a reference as body; ``photo_sha`` names the bytes."""
    long_enough = F.length("body") > -(-limit_bytes * 4 // 3)
    size = F.when(long_enough, base64_size(F.col("body")))
    sha = F.when(size > limit_bytes, F.sha2(F.try_to_binary(F.regexp_replace("body", r"\s", ""), F.lit("base64")), 256))
    ref = F.concat(F.lit("photo:sha256:"), F.col("photo_sha"), F.lit(":size="), F.col("photo_size").cast("string"))
    return rows.withColumn("photo_sha", sha).withColumn("photo_size", F.when(F.col("photo_sha").isNotNull(), size)).withColumn("body", F.coalesce(ref, "body"))


def photos(gated: DataFrame, original: str) -> DataFrame:
    """The bytes (``sha``, ``data``) that gated rows refer to, once each, from the column that has the body as it came."""
    large = gated.where("photo_sha is not null").select(F.col("photo_sha").alias("sha"), F.col(original).alias("text"))
    return large.dropDuplicates(["sha"]).select("sha", F.unbase64(F.regexp_replace("text", r"\s", "")).alias("data"))
