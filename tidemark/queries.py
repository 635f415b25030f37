"""Queries over the plain tables that apply the archive's operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.model import chunked, hot_view
from tidemark.operators import asof, catalog, integrity, lifecycle, lookup, normalize, seal, series, stores, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows of the archive, and chunks of 500 sequence numbers of a table, in SQL.
HOT = """WITH hot AS (SELECT 'dev-' || (user_id % 8) AS device_id, event_id + 1 AS seq, epoch_us(ts) // 1000 AS ts, 'u-' || user_id AS id,
 event_type AS "table", props AS body, value, 'trx-' || lpad(CAST(event_id + 1 AS VARCHAR), 8, '0') AS trx FROM events),
 filed AS (SELECT *, format('{}-{:08d}', "table", (seq - 1) // 500) AS file FROM hot),
 chunks AS (SELECT file, "table", min(seq) AS seq_min, max(seq) AS seq_max, min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS rows,
 CAST(sum(strlen(body) + strlen(trx) + strlen(device_id) + 48) AS BIGINT) AS bytes, min(trx) AS min_key, max(trx) AS max_key,
 strftime(make_timestamp(min(ts) * 1000), '%Y-%m') AS month, regexp_extract(file, '[0-9]+$')::BIGINT AS no FROM filed GROUP BY file, "table")
 """


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot(spark: SparkSession, sf_dir: str, id_kind: str = "entity") -> DataFrame:
    return hot_view(table(spark, sf_dir, "events"), id_kind)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog.chunk_entries(chunked(hot(spark, sf_dir, "event")))
    return entries.withColumn("no", F.regexp_extract("file", "[0-9]+$", 0).cast("bigint"))


def target(spark: SparkSession, sf_dir: str, column: str, share: float) -> int:
    """A whole number at a share of the range of ``ts`` or ``seq``."""
    low, high = hot(spark, sf_dir).agg(F.min(column), F.max(column)).first()
    return low + int((high - low) * share)


AT = "(SELECT min({c}) + CAST(floor((max({c}) - min({c})) * {s}) AS BIGINT) FROM hot)"
ROWS = 'device_id, seq, ts, id, "table", body'


@query(HOT + f"SELECT {ROWS}, \"table\" || chr(31) || device_id || chr(31) || seq AS syn_id FROM hot")
def hot_projection(spark, d):
    r = hot(spark, d)
    return r.select("device_id", "seq", "ts", "id", "table", "body", scalars.synthetic_id(F.col("table"), F.col("device_id"), F.col("seq")).alias("syn_id"))


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON texts in four dialects of keys, one in 97 of them with a bad number."""
    e = table(spark, d, "events")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ms = F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 1000) as bigint)")
    n = F.when(F.col("event_id") % 97 == 0, F.lit("-3")).otherwise((F.col("event_id") + 1).cast("string"))
    forms = [
        F.format_string('{"seq":%s,"ts":%d,"type":"%s","trx":"t-%d","value":%d,"actor":"u%d"}', n, ms, "event_type", "event_id", "user_id", "user_id"),
        F.format_string('{"no":"%s","timestamp":%d,"event":"%s","device":"dev-%d","ref":"r-%d","reason":"x y"}', n, ms, "event_type", F.col("user_id") % 8, "event_id"),
        F.format_string('{"seq":%s,"waktu":%d,"kind":"%s","payload":{"item":"i%d","qty":%d},"device_id":"dev-9"}', n, ms, "event_type", "user_id", "event_id"),
        F.format_string('{"seq":%s,"now":%d,"table":"notes","type":"%s","id":null,"key":"k-%d","msg":"hello %d"}', n, ms, "event_type", "event_id", "user_id"),
    ]
    pick = F.col("event_id") % 4
    text = F.coalesce(*[F.when(pick == i, f) for i, f in enumerate(forms)])
    return e.select("event_id", text.alias("value"))


RAW = """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 97 = 0 THEN '-3' ELSE CAST(event_id + 1 AS VARCHAR) END AS n FROM events),
 raw AS (SELECT event_id, CASE event_id % 4
 WHEN 0 THEN printf('{"seq":%s,"ts":%d,"type":"%s","trx":"t-%d","value":%d,"actor":"u%d"}', n, ms, event_type, event_id, user_id, user_id)
 WHEN 1 THEN printf('{"no":"%s","timestamp":%d,"event":"%s","device":"dev-%d","ref":"r-%d","reason":"x y"}', n, ms, event_type, user_id % 8, event_id)
 WHEN 2 THEN printf('{"seq":%s,"waktu":%d,"kind":"%s","payload":{"item":"i%d","qty":%d},"device_id":"dev-9"}', n, ms, event_type, user_id, event_id)
 ELSE printf('{"seq":%s,"now":%d,"table":"notes","type":"%s","id":null,"key":"k-%d","msg":"hello %d"}', n, ms, event_type, event_id, user_id) END AS v FROM e),
 p AS (SELECT event_id, json_extract_string(v, ['$.seq','$.no','$.ts','$.timestamp','$.waktu','$.now','$.type','$.event','$.kind','$.table','$.trx','$.key','$.device','$.device_id','$.value','$.actor','$.ref','$.reason','$.payload.item','$.payload.qty','$.msg']) AS x FROM raw),
 n AS (SELECT event_id, try_cast(coalesce(x[1], x[2]) AS BIGINT) AS seq, CAST(coalesce(x[3], x[4], x[5], x[6]) AS BIGINT) AS ts, coalesce(x[7], x[8], x[9]) AS kind,
 coalesce(x[10], x[7], x[8], x[9]) AS "table", coalesce(x[14], x[13], 'dev0') AS device_id, coalesce(x[11], x[12]) AS own_id, x[21] AS msg,
 concat_ws(' ', coalesce(x[7], x[8], x[9]), 'value=' || x[15], 'actor=' || x[16], 'ref=' || x[17], 'reason=' || x[18], 'item=' || x[19], 'qty=' || x[20]) AS composed FROM p) """


@query(RAW + """SELECT event_id, device_id, seq, ts, coalesce(own_id, "table" || chr(31) || device_id || chr(31) || seq) AS id, "table", coalesce(msg, composed) AS body FROM n WHERE seq BETWEEN 1 AND 99999999""")
def norm_alias_json(spark, d):
    return normalize.normalize(raw_records(spark, d)).where("not malformed").select("event_id", "device_id", "seq", "ts", "id", "table", "body")


@query(RAW + "SELECT count(*) AS total, count(*) FILTER (WHERE seq IS NULL OR seq < 1) AS malformed, count(*) FILTER (WHERE seq IS NULL OR seq < 1) > count(*) * 0.01 AS aborts FROM n")
def malformed_gate(spark, d):
    return normalize.malformed_gate(normalize.normalize(raw_records(spark, d)))


def _marks(r: DataFrame) -> DataFrame:
    return seal.advance_watermark(r.limit(0).select("device_id", F.col("seq").alias("high")), r.where("seq % 3 <> 0 and `table` <> 'purchase'"))


MARKS = """, marks AS (SELECT device_id, max(seq) AS high FROM hot WHERE seq % 3 <> 0 AND "table" <> 'purchase' AND seq <= (SELECT max(seq) // 2 FROM hot) GROUP BY 1)"""


def _half(r: DataFrame) -> DataFrame:
    return r.join(F.broadcast(r.agg(F.expr("max(seq) div 2").alias("h"))), F.col("seq") <= F.col("h"), "left_semi")


@query(HOT + MARKS + "SELECT h.device_id, h.seq, h.\"table\", h.seq <= coalesce(m.high, 0) AS skipped FROM hot h LEFT JOIN marks m USING (device_id)")
def watermark_filter(spark, d):
    r = hot(spark, d)
    return seal.after_watermark(r, _marks(_half(r))).select("device_id", "seq", "table", "skipped")


@query(HOT + MARKS + "SELECT device_id, max(high) AS high FROM (SELECT * FROM marks UNION ALL SELECT device_id, seq FROM hot WHERE seq % 5 = 0) GROUP BY 1")
def watermark_advance(spark, d):
    r = hot(spark, d)
    return seal.advance_watermark(_marks(_half(r)), r.where("seq % 5 = 0"))


def twice(r: DataFrame) -> DataFrame:
    """Rows, and again a third of them with another body, by input position."""
    again = r.where("seq % 3 = 0").withColumn("body", F.when(F.col("seq") % 2 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return r.withColumn("pos", F.col("seq")).unionByName(again.withColumn("pos", F.col("seq") + 100_000_000)).drop("value")


TWICE = """, two AS (SELECT device_id, seq, ts, id, "table", body, seq AS pos FROM hot UNION ALL
 SELECT device_id, seq, ts, id, "table", CASE WHEN seq % 2 = 0 THEN body || '!' ELSE body END, seq + 100000000 FROM hot WHERE seq % 3 = 0) """


@query(HOT + TWICE + f'SELECT {ROWS}, pos FROM two QUALIFY row_number() OVER (PARTITION BY "table", device_id, seq ORDER BY pos DESC) = 1')
def dedupe_keep_last(spark, d):
    return seal.keep_last(twice(hot(spark, d)))


@query(HOT + TWICE + """SELECT "table", count(*) FILTER (WHERE body <> prev) AS replaced FROM (SELECT *, lag(body) OVER (PARTITION BY "table", device_id, seq ORDER BY pos) AS prev FROM two) GROUP BY 1""")
def replaced_count(spark, d):
    return seal.replaced(twice(hot(spark, d)))


@query(HOT + f"SELECT {ROWS} FROM hot ORDER BY seq, device_id LIMIT 500")
def bounded_seal(spark, d):
    return seal.bounded(hot(spark, d).withColumn("pos", F.col("seq")), 500).select("device_id", "seq", "ts", "id", "table", "body")


@query(HOT + """SELECT "table", seq, row_bytes, (sum(row_bytes) OVER (PARTITION BY "table" ORDER BY seq) - row_bytes)::BIGINT // 16384 AS chunk_no FROM (SELECT "table", seq, (strlen(body) + strlen(id) + strlen(device_id) + 48)::BIGINT AS row_bytes FROM hot)""")
def pack_chunks(spark, d):
    return seal.pack(hot(spark, d), 16384, 1024).select("table", "seq", "row_bytes", "chunk_no")


_TEXTS = ", ".join(f"strlen(CAST({c} AS VARCHAR)) || ':' || {c}" for c in ("device_id", "seq", "ts", "trx", '"table"', "body"))
_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT)::HUGEINT) AS VARCHAR)" for i in range(4))


@query(HOT + f""", hashed AS (SELECT file, sha256(concat_ws(',', {_TEXTS})) AS h FROM filed), content AS (SELECT file, sha256(concat_ws(':', {_SUMS}, CAST(count(*) AS VARCHAR))) AS sha256 FROM hashed GROUP BY file)
 SELECT file, "table", seq_min, seq_max, ts_min, ts_max, rows, bytes, sha256, min_key, max_key, month FROM chunks JOIN content USING (file)""")
def chunk_catalog(spark, d):
    return chunks(spark, d).select("file", "sha256", "table", "seq_min", "seq_max", "ts_min", "ts_max", "rows", "bytes", "min_key", "max_key", "month")


@query(HOT + "SELECT file, min_key, max_key, seq_min, month FROM chunks WHERE no % 7 <> 3")
def sparse_index(spark, d):
    return catalog.sparse_index(chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3))


@query(HOT + "SELECT month, count(*) AS chunks, CAST(sum(rows) AS BIGINT) AS rows, min(min_key) AS min_key, max(max_key) AS max_key, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM chunks GROUP BY month")
def month_pointers(spark, d):
    return catalog.month_pointers(chunks(spark, d))


@query(HOT + f"SELECT device_id, seq, ts, trx AS id, \"table\", body FROM hot WHERE trx = 'trx-00000778'")
def find_point(spark, d):
    return lookup.find_first(hot(spark, d, "event"), "trx-00000778").select("device_id", "seq", "ts", "id", "table", "body")


@query(HOT + f"SELECT {ROWS} FROM hot WHERE \"table\" || chr(31) || device_id || chr(31) || seq = (SELECT min(\"table\" || chr(31) || device_id || chr(31) || seq) FROM hot WHERE seq = 778)")
def find_qualified(spark, d):
    r = hot(spark, d)
    one = r.where("seq = 778").select(scalars.synthetic_id(F.col("table"), F.col("device_id"), F.col("seq"))).first()
    return lookup.find_first(r, one[0]).select("device_id", "seq", "ts", "id", "table", "body")


@query(HOT + "SELECT file, no % 7 <> 3 AND min_key <= 'trx-00000778' AND max_key >= 'trx-00000778' AS hit FROM chunks")
def prune_candidates(spark, d):
    return lookup.candidates(chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3), "trx-00000778").select("file", "hit")


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def _bloom_bits(key: str) -> str:
    return f"xor({_fnv(f"i || ':' || {key}")}, {_fnv(f'reverse({key})')}) % 2048"


@query(HOT + f""", bits AS (SELECT DISTINCT file, {_bloom_bits('trx')} AS bit FROM filed, range(3) AS r(i)), probe AS (SELECT DISTINCT {_bloom_bits("'trx-00000778'")} AS bit FROM range(3) AS r(i)),
 held AS (SELECT file, count(*) AS n FROM bits JOIN probe USING (bit) GROUP BY file)
 SELECT file, 'trx-00000778' BETWEEN min_key AND max_key AS in_range, coalesce(n, 0) = (SELECT count(*) FROM probe) AS in_filter FROM chunks LEFT JOIN held USING (file)""")
def bloom_probe(spark, d):
    """What the key range and the filter of each chunk say of a key, false positives too."""
    found = catalog.chunk_entries(chunked(hot(spark, d, "event")), bloom=True)
    ranged = lookup.candidates(found.withColumnRenamed("bloom", "_bloom"), "trx-00000778").withColumnRenamed("hit", "in_range")
    wide = ranged.withColumn("min_key", F.lit("")).withColumn("max_key", F.lit("z")).withColumnRenamed("_bloom", "bloom")
    return lookup.candidates(wide, "trx-00000778").select("file", "in_range", F.col("hit").alias("in_filter"))


def _asof_sql(column: str, share: float, window: float | None = None) -> str:
    at = AT.format(c=column, s=share)
    floor = "" if window is None else f" AND {column} > {at} - " + AT.format(c=column, s=window).replace(f"min({column}) + ", "", 1)
    return HOT + f"SELECT {ROWS} FROM hot WHERE {column} <= {at}{floor} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, ts DESC) = 1"


def _width(spark, d, column, share):
    low, high = hot(spark, d).agg(F.min(column), F.max(column)).first()
    return int((high - low) * share)


@query(_asof_sql("ts", 0.5))
def asof_ts(spark, d):
    return asof.as_of(hot(spark, d).drop("value"), ts=target(spark, d, "ts", 0.5))


@query(_asof_sql("seq", 0.25))
def asof_seq(spark, d):
    return asof.as_of(hot(spark, d).drop("value"), seq=target(spark, d, "seq", 0.25))


@query(_asof_sql("ts", 0.5, 0.02))
def asof_ts_window(spark, d):
    return asof.as_of(hot(spark, d).drop("value"), ts=target(spark, d, "ts", 0.5), window_ms=_width(spark, d, "ts", 0.02))


@query(_asof_sql("seq", 0.75, 0.1))
def asof_seq_window(spark, d):
    return asof.as_of(hot(spark, d).drop("value"), seq=target(spark, d, "seq", 0.75), window_seq=_width(spark, d, "seq", 0.1))


@query(HOT + f"SELECT count(*) FILTER (WHERE k AND no % 5 <> 1) AS consulted, count(*) FILTER (WHERE NOT k) AS pruned, count(*) FILTER (WHERE k AND no % 5 = 1) AS skipped_missing FROM (SELECT *, ts_min <= {AT.format(c='ts', s=0.5)} AND no % 7 <> 3 AS k FROM chunks)")
def asof_proof(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    return asof.proof(c, c.where("no % 5 <> 1"), ts=target(spark, d, "ts", 0.5))


BUCKETS = """count(*) AS count, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, first(value ORDER BY ts, seq) AS first, last(value ORDER BY ts, seq) AS last"""


def _rounded(b: DataFrame) -> DataFrame:
    return b.withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 6))


@query(HOT + f'SELECT "table", ts - ts % 3600000 AS t0, {BUCKETS}, false AS anomalous, ts - ts % 3600000 + 3600000 AS t1 FROM hot GROUP BY "table", ts - ts % 3600000')
def downsample_1h(spark, d):
    return _rounded(series.downsample(hot(spark, d), 3_600_000, ["table"]))


PASS1 = """, scored AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM hot WINDOW w AS (PARTITION BY "table", device_id ORDER BY ts, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 flagged AS (SELECT *, coalesce(n >= 3 AND CASE WHEN s = 0 THEN value <> m ELSE abs(value - m) > 3 * s END, false) AS flagged FROM scored) """
SERIES = ["table", "device_id"]


@query(HOT + PASS1 + f'SELECT "table", ts - ts % 86400000 AS t0, {BUCKETS}, bool_or(flagged) AS anomalous, ts - ts % 86400000 + 86400000 AS t1 FROM flagged GROUP BY "table", ts - ts % 86400000')
def downsample_flagged(spark, d):
    return _rounded(series.downsample(series.flag_first_pass(hot(spark, d), SERIES), 86_400_000, ["table"], "flagged"))


@query(HOT + PASS1 + "SELECT device_id, \"table\", seq, value, flagged FROM flagged")
def zscore_pass1(spark, d):
    return series.flag_first_pass(hot(spark, d), SERIES).select("device_id", "table", "seq", "value", "flagged")


TWO = PASS1.rstrip() + """, lists AS (SELECT "table", device_id, list({'seq': seq, 'v': value, 'f': flagged} ORDER BY ts, seq) AS l FROM flagged GROUP BY 1, 2),
 folded AS (SELECT "table", device_id, list_reduce(list_transform(l, lambda e: {'clean': CAST([] AS DOUBLE[]), 'out': [{'seq': e.seq, 'v': e.v, 'f': e.f}]}), lambda a, e:
 {'clean': CASE WHEN (e.out[1].f OR (len(a.clean) >= 3 AND CASE WHEN list_stddev_pop(a.clean) = 0 THEN e.out[1].v <> list_avg(a.clean) ELSE abs(e.out[1].v - list_avg(a.clean)) > 3 * list_stddev_pop(a.clean) END)) THEN a.clean ELSE (list_append(a.clean, e.out[1].v))[-10:] END,
 'out': list_append(a.out, {'seq': e.out[1].seq, 'v': e.out[1].v, 'f': e.out[1].f OR (len(a.clean) >= 3 AND CASE WHEN list_stddev_pop(a.clean) = 0 THEN e.out[1].v <> list_avg(a.clean) ELSE abs(e.out[1].v - list_avg(a.clean)) > 3 * list_stddev_pop(a.clean) END)})},
 {'clean': CAST([] AS DOUBLE[]), 'out': CAST([] AS STRUCT(seq BIGINT, v DOUBLE, f BOOLEAN)[])}) AS r FROM lists),
 final AS (SELECT "table", device_id, unnest(r.out) AS o FROM folded) """


@query(HOT + TWO + 'SELECT "table", device_id, o.seq AS seq, o.f AS flagged FROM final')
def anomaly_two_pass(spark, d):
    return series.flag_two_passes(hot(spark, d), SERIES).select("table", "device_id", "seq", "flagged")


@query(HOT + PASS1 + f"SELECT device_id, \"table\", seq, CASE WHEN ts < {AT.format(c='ts', s=0.5)} OR flagged THEN 'cold' ELSE 'hot' END AS tier, flagged AS quarantined FROM flagged")
def route_hot_cold_quarantine(spark, d):
    return series.route(series.flag_first_pass(hot(spark, d), SERIES), target(spark, d, "ts", 0.5)).select("device_id", "table", "seq", "tier", "quarantined")


@query(HOT + "SELECT 'sensor' AS device_id, row_number() OVER (ORDER BY t0) + 100 AS seq, t0 AS ts, 'sensor-' || t0 AS id, 'series' AS \"table\" FROM (SELECT DISTINCT ts - ts % 3600000 AS t0 FROM hot)")
def buckets_to_rows(spark, d):
    return series.buckets_to_rows(series.downsample(hot(spark, d), 3_600_000, []), "series", "sensor", 100).drop("body")


def _damaged(spark, d) -> DataFrame:
    """Chunks with some left out and some that start inside the one before."""
    c = chunks(spark, d).where("no % 6 <> 2")
    return c.withColumn("seq_min", F.when(F.col("no") % 10 == 4, F.col("seq_min") - 600).otherwise(F.col("seq_min")))


@query(HOT + """, dam AS (SELECT file, "table", CASE WHEN no % 10 = 4 THEN seq_min - 600 ELSE seq_min END AS seq_min, seq_max FROM chunks WHERE no % 6 <> 2),
 l AS (SELECT *, lag(file) OVER w AS after, lag(seq_max) OVER w AS pm FROM dam WINDOW w AS (PARTITION BY "table" ORDER BY seq_min, file))
 SELECT "table", after, file, CASE WHEN seq_min <= pm THEN 'break' ELSE 'gap' END AS kind, CASE WHEN seq_min > pm THEN seq_min - pm - 1 ELSE 0 END AS missing FROM l WHERE pm IS NOT NULL AND seq_min <> pm + 1""")
def chain_breaks_gaps(spark, d):
    return integrity.chain(_damaged(spark, d))


@query(HOT + """SELECT device_id, seq, coalesce(seq - lag(seq) OVER w, 0) AS d_seq, coalesce(ts - lag(ts) OVER w, 0) AS d_ts FROM hot WINDOW w AS (PARTITION BY device_id ORDER BY seq)""")
def delta_encode(spark, d):
    return integrity.delta_encode(hot(spark, d), ["device_id"], 4096).select("device_id", "seq", "d_seq", "d_ts")


RUNS = """, i AS (SELECT *, sum(CASE WHEN "table" IS DISTINCT FROM p OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY seq) AS run FROM (SELECT *, lag("table") OVER (PARTITION BY device_id ORDER BY seq) AS p FROM hot)) """


@query(HOT + RUNS + 'SELECT device_id, any_value("table") AS "table", min(seq) AS first_seq, count(*) AS length FROM i GROUP BY device_id, run')
def rle_runs(spark, d):
    return integrity.runs(hot(spark, d), ["device_id"], "table", 4096)


@query(HOT + RUNS + 'SELECT device_id, "table", min(seq) OVER (PARTITION BY device_id, run) AS first_seq, CAST(row_number() OVER (PARTITION BY device_id, run ORDER BY seq) - 1 AS INT) AS "offset" FROM i')
def rle_expand(spark, d):
    return integrity.expand_runs(integrity.runs(hot(spark, d), ["device_id"], "table", 4096), "table").select("device_id", "table", "first_seq", "offset")


def _acks(c: DataFrame) -> DataFrame:
    return c.where("no % 3 = 0").select("sha256")


@query(HOT + """SELECT relay, file, "table", CASE WHEN "table" = 'photo' THEN 1 ELSE 0 END AS lane, seq_min, bytes, CASE WHEN no % 7 = 3 THEN 'quarantined' WHEN "table" = 'photo' THEN 'blob-deferred' WHEN no % modulus = 0 THEN 'already-acked' ELSE 'ship' END AS action
 FROM chunks, (VALUES ('north', 3), ('south', 2)) AS r(relay, modulus)""")
def relay_acks(spark, d):
    """What each of two relays is to get: what one acknowledged counts for it alone."""
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    acks = c.where("no % 3 = 0").select("sha256", F.lit("north").alias("relay")).unionByName(c.where("no % 2 = 0").select("sha256", F.lit("south").alias("relay")))
    return sync.ship_plans(c, acks, ["north", "south"]).select("relay", "file", "table", "lane", "seq_min", "bytes", "action")


PLAN = """, plan AS (SELECT file, "table", CASE WHEN "table" = 'photo' THEN 1 ELSE 0 END AS lane, seq_min, bytes, CASE WHEN no % 7 = 3 THEN 'quarantined' WHEN "table" = 'photo' THEN 'blob-deferred' WHEN no % 3 = 0 THEN 'already-acked' ELSE 'ship' END AS action
 FROM (SELECT * REPLACE (CASE WHEN "table" = 'view' THEN 'photo' ELSE "table" END AS "table") FROM chunks)) """


def _plan(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3).withColumn("table", F.when(F.col("table") == "view", "photo").otherwise(F.col("table")))
    return sync.ship_plan(c, _acks(c))


@query(HOT + PLAN + "SELECT * FROM plan")
def ship_plan(spark, d):
    return _plan(spark, d).drop("sha256")


@query(HOT + PLAN + "SELECT action, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY action")
def ship_reasons(spark, d):
    return sync.ship_totals(_plan(spark, d))


@query(HOT + "SELECT file, CASE WHEN no % 4 = 0 THEN 'pull' ELSE 'push' END AS direction FROM chunks WHERE no % 4 = 0 OR no % 5 = 0 AND no % 4 <> 0")
def peer_want(spark, d):
    c = chunks(spark, d)
    wanted = sync.want(c.where("no % 4 <> 0"), c.where("no % 5 <> 0 or no % 4 = 0"))
    return wanted.join(c.select("sha256", "file"), "sha256").select("file", "direction")


@query(HOT + "SELECT file, CASE WHEN no % 2 = 0 THEN rows ELSE rows + 1 END AS rows FROM chunks WHERE no % 2 = 0 OR no % 3 = 0")
def append_entries(spark, d):
    c = chunks(spark, d).select("file", "rows", "no")
    return catalog.append_entries(c.where("no % 2 = 0"), c.where("no % 3 = 0").withColumn("rows", F.col("rows") + 1)).select("file", "rows")


@query(HOT + "SELECT file, no % 3 = 0 AS deletable FROM chunks WHERE no % 4 = 1")
def gc_orphans(spark, d):
    c = chunks(spark, d)
    return lifecycle.orphans(c.select("file", "sha256"), c.where("no % 4 <> 1").select("file"), _acks(c)).drop("sha256")


@query("""WITH r AS (SELECT DISTINCT sha256(text) AS sha, strlen(text) AS size FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT DISTINCT sha256(text) AS sha, strlen(text) + CASE WHEN doc_id % 11 = 5 THEN 1 ELSE 0 END AS fs FROM documents d WHERE doc_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id < d.doc_id))
 SELECT coalesce(r.sha, f.sha) AS sha, CASE WHEN r.sha IS NULL THEN 'orphan' WHEN f.sha IS NULL THEN 'missing' WHEN size <> fs THEN 'size' ELSE 'ok' END AS status FROM r FULL JOIN f ON r.sha = f.sha""")
def photo_ref_audit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("size"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    files = first.where("doc_id % 5 <> 0").withColumn("size", F.col("size") + (F.col("doc_id") % 11 == 5).cast("int"))
    return integrity.photo_audit(docs.where("doc_id % 3 <> 0"), files)


def _cold(c: DataFrame) -> DataFrame:
    return c.groupBy(F.concat(F.lit("seg-"), F.expr("no div 3").cast("string")).alias("file")).agg(F.collect_list("file").alias("chunks"), F.sum("bytes").alias("bytes"))


@query(HOT + "SELECT 'seg-' || (no // 3) AS segment, count(*) FILTER (WHERE no % 4 <> 1 AND no // 3 <> 2) AS live, count(*) FILTER (WHERE no % 4 = 1 OR no // 3 = 2) AS dead, CASE WHEN count(*) FILTER (WHERE no % 4 <> 1 AND no // 3 <> 2) = 0 THEN 'prune' WHEN count(*) FILTER (WHERE no % 4 = 1 OR no // 3 = 2) > 0 THEN 'repack' ELSE 'keep' END AS action FROM chunks GROUP BY no // 3")
def cold_liveness(spark, d):
    c = chunks(spark, d)
    return lifecycle.cold_liveness(_cold(c), c.where("no % 4 <> 1 and no div 3 <> 2"))


@query(HOT + "SELECT file, rows FROM chunks WHERE no // 3 > 2 AND no % 7 <> 3")
def merge_pending(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    return lifecycle.merge_pending(c, _cold(c.where("no div 3 <= 2"))).select("file", "rows")


@query(HOT + "SELECT count(*) + 1 AS targets, 1::BIGINT AS \"unknown\", count(*) FILTER (WHERE no % 3 <> 0) AS unacked, false AS allowed FROM chunks WHERE no % 2 = 0")
def forget_check(spark, d):
    c = chunks(spark, d)
    targets = c.where("no % 2 = 0").select("file").unionByName(spark.range(1).select(F.lit("nowhere").alias("file")))
    return lifecycle.forget_check(targets, c, _acks(c))


STATUS = "SELECT count(*) FILTER (WHERE no % 4 <> 1) AS chunks, CAST(sum(rows) FILTER (WHERE no % 4 <> 1) AS BIGINT) AS rows, CAST(sum(bytes) FILTER (WHERE no % 4 <> 1) AS BIGINT) AS bytes, count(*) FILTER (WHERE no % 4 <> 1 AND no % 7 = 3) AS quarantined, count(*) FILTER (WHERE no % 4 <> 1 AND no % 3 <> 0) AS unacked, count(*) FILTER (WHERE no % 4 = 1) AS orphans, count(DISTINCT no // 3) AS segments, CAST(sum(bytes) AS BIGINT) AS cold_bytes FROM chunks"


def _status(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    return lifecycle.status(c.where("no % 4 <> 1"), _cold(c), _acks(c), c.select("file"))


@query(HOT + STATUS)
def status_meter(spark, d):
    return _status(spark, d)


@query(HOT + f"SELECT unacked, quarantined, 80 AS free_mb, CASE WHEN unacked >= 20 OR quarantined >= 3 THEN 'critical' ELSE 'warn' END AS level, concat_ws(',', CASE WHEN unacked >= 20 THEN 'unacked:critical' WHEN unacked >= 5 THEN 'unacked:warn' END, CASE WHEN quarantined >= 3 THEN 'quarantined:critical' WHEN quarantined >= 1 THEN 'quarantined:warn' END, 'free_mb:warn') AS reasons FROM ({STATUS})")
def alert_level(spark, d):
    return lifecycle.alerts(_status(spark, d).select("unacked", "quarantined", F.lit(80).alias("free_mb")))


VERIFY = ", v AS (SELECT file, \"table\", CASE WHEN no % 5 <> 1 AND no % 4 = 2 THEN 'sha256' ELSE '' END AS reason, CASE WHEN no % 7 = 3 THEN 'QUARANTINED' WHEN no % 5 = 1 THEN 'MISSING' WHEN no % 4 = 2 THEN 'CORRUPT' ELSE 'OK' END AS status FROM chunks) "


def _statuses(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    found = c.where("no % 5 <> 1").withColumn("sha256", F.when(F.col("no") % 4 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return c, integrity.verify(c, found)


@query(HOT + VERIFY + "SELECT * FROM v")
def verify_status(spark, d):
    return _statuses(spark, d)[1]


@query(HOT + VERIFY + "SELECT v.file, v.status, no % 3 = 0 AS repairable FROM v JOIN chunks USING (file) WHERE status <> 'OK'")
def repair_plan(spark, d):
    c, s = _statuses(spark, d)
    return integrity.repair_plan(s, c, _acks(c))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 'photo:sha256:' || sha256(text) || ':size=' || octet_length(encode(text)) ELSE to_base64(encode(text)) END AS body, CASE WHEN octet_length(encode(text)) > 2000 THEN octet_length(encode(text)) END::BIGINT AS photo_size FROM documents""")
def photo_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("body"))
    return normalize.photo_gate(docs, 2000).select("doc_id", "body", F.col("photo_size").cast("bigint").alias("photo_size"))


@query("SELECT DISTINCT sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS data_sha FROM documents WHERE octet_length(encode(text)) > 2000")
def photo_store(spark, d):
    """Bytes kept beside the rows, with the hash of what is kept."""
    bodies = table(spark, d, "documents").select(F.base64(F.encode("text", "UTF-8")).alias("original"))
    kept = normalize.photos(normalize.photo_gate(bodies.withColumn("body", F.col("original")), 2000), "original")
    return kept.select("sha", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("data_sha"))


@query("""SELECT p_partkey, name, regexp_full_match(name, '[A-Za-z0-9_][A-Za-z0-9_.-]*\\.chk') AND NOT contains(name, '..') AS ok, regexp_full_match(sha, '[0-9a-f]{64}') AS sha_ok FROM (SELECT p_partkey,
 replace(p_name, ' ', CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '_' END) || CASE p_partkey % 4 WHEN 0 THEN '.chk' WHEN 1 THEN '/a.chk' WHEN 2 THEN '..chk' ELSE '.txt' END AS name, CASE WHEN p_partkey % 3 = 0 THEN upper(sha256(p_name)) ELSE sha256(p_name) END AS sha FROM part)""")
def name_gates(spark, d):
    part = table(spark, d, "part")
    end = F.element_at(F.array(*map(F.lit, [".chk", "/a.chk", "..chk", ".txt"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))), end)
    sha = F.sha2("p_name", 256)
    named = part.select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.upper(sha)).otherwise(sha).alias("sha"))
    return named.select("p_partkey", "name", scalars.valid_chunk_name(F.col("name")).alias("ok"), scalars.valid_sha(F.col("sha")).alias("sha_ok"))


@query("SELECT p_partkey, p_name || '/thumbs' AS name, 1 AS lane FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '(?i)blob|photo|image|thumb') THEN 1 ELSE 0 END FROM part WHERE p_size <= 25")
def blob_lane(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("/thumbs"))).otherwise(F.col("p_name")).alias("name"))
    return named.withColumn("lane", scalars.lane_of(F.col("name")))


@query(HOT + """, s AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY seq, device_id) AS rn FROM hot QUALIFY rn <= 10000), g AS (SELECT "table", body, count(*) AS n, min(rn) AS first FROM s GROUP BY 1, 2)
 SELECT "table", body, n, CAST(sum(strlen(body) + 1) OVER (PARTITION BY "table" ORDER BY n DESC, first) AS BIGINT) AS upto FROM g QUALIFY upto <= 512""")
def dict_rank(spark, d):
    return catalog.dictionary_ranking(hot(spark, d), 512)


def _objects(spark, d):
    docs = table(spark, d, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return docs, stores.put(docs.limit(0).select(F.lit("").alias("sha"), "content"), docs)


@query("SELECT sha256(text) AS sha, min(strlen(text)) AS bytes FROM documents GROUP BY 1")
def cas_dedupe(spark, d):
    return _objects(spark, d)[1].select("sha", F.octet_length("content").cast("bigint").alias("bytes"))


@query("SELECT sha256(text) AS sha, count(DISTINCT source) FILTER (WHERE doc_id % 4 <> 0) AS refs, min(source) FILTER (WHERE doc_id % 4 <> 0) AS first_owner, max(source) FILTER (WHERE doc_id % 4 <> 0) AS last_owner FROM documents GROUP BY 1")
def cas_refcount(spark, d):
    docs, objects = _objects(spark, d)
    return stores.refcounts(objects, docs.where("doc_id % 4 <> 0").select(F.sha2("content", 256).alias("sha"), F.col("source").alias("owner")))


@query("SELECT sha256(text) AS sha FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE doc_id % 4 <> 0) = 0")
def cas_gc(spark, d):
    docs, objects = _objects(spark, d)
    return stores.garbage(objects, docs.where("doc_id % 4 <> 0").select(F.sha2("content", 256).alias("sha")))


@query("""SELECT conv_id, count(*)::INT AS n_refs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sha256(string_agg(format('{:05d}', turn) || ' ' || sha256(text) || ' ' || strlen(text), chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1""")
def bundle_pack(spark, d):
    return stores.pack_bundles(table(spark, d, "conversations").withColumn("name", F.format_string("%05d", "turn")), "conv_id", "name", "text")


#: Returned lines alone are uses for ``claim_reconcile``, so that some claims have none.
RETURNED = "l_returnflag <> 'N'"
CLAIMS = """WITH c AS (SELECT 't-' || substr(sha256((o_orderkey % 1000) || ':' || epoch_ms(o_orderdate) || ':' || o_custkey || '-' || o_orderkey), 1, 20) AS claim, o_orderkey, epoch_ms(o_orderdate) + 900000 AS expires_at, epoch_ms(o_orderdate) AS issued FROM orders),
 a AS (SELECT l_orderkey * 10 + l_linenumber AS attempt, CASE WHEN l_linenumber = 5 THEN 't-none' ELSE claim END AS claim, issued + l_linenumber * 200000 + l_orderkey % 7 AS used_at FROM lineitem JOIN c ON l_orderkey = o_orderkey WHERE {uses}),
 j AS (SELECT a.*, CASE WHEN c.claim IS NULL THEN 'unknown' WHEN used_at > expires_at THEN 'expired' END AS fate FROM a LEFT JOIN c USING (claim)),
 o AS (SELECT attempt, claim, coalesce(fate, CASE WHEN row_number() OVER (PARTITION BY claim, fate IS NULL ORDER BY used_at, attempt) = 1 THEN 'ok' ELSE 'double-use' END) AS outcome FROM j) """


def _claims(spark, d, uses="true"):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ms = F.expr("cast(floor(unix_micros(cast(o_orderdate as timestamp)) / 1000) as bigint)")
    orders = table(spark, d, "orders").withColumn("issued", ms)
    nonce = F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    claims = orders.select("o_orderkey", scalars.claim_id(F.col("o_orderkey") % 1000, F.col("issued"), nonce).alias("claim"), (F.col("issued") + stores.CLAIM_TTL_MS).alias("expires_at"), "issued")
    lines = table(spark, d, "lineitem").where(uses).join(claims, F.col("l_orderkey") == F.col("o_orderkey"))
    attempts = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.when(F.col("l_linenumber") == 5, "t-none").otherwise(F.col("claim")).alias("claim"), (F.col("issued") + F.col("l_linenumber") * 200000 + F.col("l_orderkey") % 7).alias("used_at"))
    return claims, attempts


@query(CLAIMS.format(uses="true") + "SELECT o_orderkey, claim, expires_at FROM c")
def claim_ids(spark, d):
    return _claims(spark, d)[0].select("o_orderkey", "claim", "expires_at")


@query(CLAIMS.format(uses="true") + "SELECT * FROM o")
def claim_use(spark, d):
    return stores.use_claims(*_claims(spark, d))


@query(CLAIMS.format(uses=RETURNED) + """, u AS (SELECT claim, bool_or(outcome = 'double-use') AS double FROM o WHERE outcome IN ('ok', 'double-use') GROUP BY 1), s AS (SELECT claim, true AS s FROM c WHERE o_orderkey % 4 <> 0), f AS (SELECT claim, double, s FROM u FULL JOIN s USING (claim))
 SELECT claim, 'double' AS kind FROM f WHERE double UNION ALL SELECT claim, 'local' FROM f WHERE double IS NOT NULL AND s IS NULL UNION ALL SELECT claim, 'remote' FROM f WHERE double IS NULL UNION ALL SELECT claim, 'clean' FROM f WHERE NOT double AND s""")
def claim_reconcile(spark, d):
    claims, attempts = _claims(spark, d, RETURNED)
    return stores.reconcile(stores.use_claims(claims, attempts), claims.where("o_orderkey % 4 <> 0"))


@query("""SELECT event_id, event_type, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(event_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS table_id FROM events""")
def fnv_table_id(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", scalars.fnv1a32(F.col("event_type")).alias("table_id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_bucket(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ms = F.expr("cast(floor(unix_micros(cast(o_orderdate as timestamp)) / 1000) as bigint)")
    return table(spark, d, "orders").select("o_orderkey", scalars.month_of(ms).alias("month"))


@query(HOT + """, p AS (SELECT "table", (seq // 1000) AS part, sha256(string_agg(ts || ',' || printf('%.4f', value) || ',' || id, chr(10) ORDER BY seq)) AS h FROM hot GROUP BY 1, 2) SELECT "table", sha256(string_agg(h, chr(10) ORDER BY part)) AS sha256 FROM p GROUP BY 1""")
def series_hash(spark, d):
    return series.series_hash(hot(spark, d), ["table"])


@query(HOT + """SELECT 'seg-' || (no // 3) AS segment, file FROM chunks WHERE no % 7 <> 3 AND 'trx-00000778' BETWEEN min_key AND max_key""")
def cold_candidates(spark, d):
    c = chunks(spark, d).withColumn("quarantined", F.col("no") % 7 == 3)
    return lookup.segments_for(_cold_by_number(c), lookup.candidates(c, "trx-00000778"))


def _cold_by_number(c: DataFrame) -> DataFrame:
    """Segments of three numbers each."""
    return c.groupBy(F.concat(F.lit("seg-"), F.expr("no div 3")).alias("file")).agg(F.collect_list("file").alias("chunks"), F.sum("bytes").alias("bytes"))


@query(HOT + PLAN + "SELECT * FROM plan WHERE action = 'ship' ORDER BY lane, seq_min, file")
def ship_order(spark, d):
    return sync.ship_order(_plan(spark, d)).drop("sha256")


@query(HOT + "SELECT DISTINCT no % 9 AS dict_id FROM chunks WHERE no % 9 NOT IN (SELECT no % 9 FROM chunks WHERE no % 2 = 0 AND no < 9)")
def dead_dictionaries(spark, d):
    held = chunks(spark, d).select((F.col("no") % 9).alias("dict_id"), "no")
    return lifecycle.dead_dictionaries(held.select("dict_id").distinct(), held.where("no % 2 = 0 and no < 9").select("dict_id"))


@query(HOT + VERIFY + """, broken AS (SELECT count(*) FILTER (WHERE seq_min <= pm) AS breaks, count(*) FILTER (WHERE seq_min > pm + 1) AS gaps FROM (SELECT *, lag(seq_max) OVER (PARTITION BY "table" ORDER BY seq_min, file) AS pm FROM chunks WHERE no % 7 <> 3))
 SELECT chunks, bad, breaks, gaps, bad = 0 AND breaks = 0 AS ok FROM (SELECT count(*) AS chunks, count(*) FILTER (WHERE status <> 'OK') AS bad FROM v), broken""")
def verify_verdict(spark, d):
    c, statuses = _statuses(spark, d)
    return integrity.verdict(statuses, integrity.chain(c))


@query(HOT + """, now AS (SELECT month, count(*) AS chunks, CAST(sum(rows) AS BIGINT) AS rows, min(min_key) AS min_key, max(max_key) AS max_key, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM chunks WHERE no % 2 = 0 GROUP BY month),
 old AS (SELECT month, count(*) AS chunks, CAST(sum(rows) AS BIGINT) AS rows, min(min_key) AS min_key, max(max_key) AS max_key, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM (SELECT * REPLACE ('x' || month AS month) FROM chunks WHERE no % 2 = 1 UNION ALL SELECT * FROM chunks WHERE no % 2 = 1) GROUP BY month)
 SELECT * FROM now UNION ALL SELECT * FROM old WHERE month NOT IN (SELECT month FROM now)""")
def months_additive(spark, d):
    c = chunks(spark, d)
    odd = c.where("no % 2 = 1")
    old = catalog.month_pointers(odd.withColumn("month", F.concat(F.lit("x"), "month")).unionByName(odd))
    return catalog.month_pointers(c.where("no % 2 = 0"), old)


@query(HOT + """SELECT month FROM chunks GROUP BY month HAVING 'trx-00000778' BETWEEN min(min_key) AND max(max_key)""")
def shard_prune(spark, d):
    return lookup.months_for(catalog.month_pointers(chunks(spark, d)), "trx-00000778")


@query("SELECT doc_id, octet_length(encode(text)) > 2000 AS is_ref FROM documents")
def photo_refs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("body"))
    return normalize.photo_gate(docs, 2000).select("doc_id", scalars.is_photo_ref(F.col("body")).alias("is_ref"))


@query("""SELECT p_partkey, CASE WHEN length(regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g')) > 0 THEN substr(regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g'), 1, 32) ELSE 'log' END || '-' || lpad(CAST(p_size AS VARCHAR), 8, '0') || '-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '-' || substr(sha256(p_name), 1, 8) AS name FROM part""")
def chunk_names(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.chunk_name(F.col("p_name"), F.col("p_size"), F.col("p_partkey"), F.sha2("p_name", 256)).alias("name"))


@query(HOT + PASS1 + f", bits AS (SELECT DISTINCT device_id, CAST({_bloom_bits('id')} AS INT) AS bit FROM flagged, range(3) AS r(i) WHERE flagged) SELECT device_id, bit FROM bits")
def anomaly_filter(spark, d):
    found = series.anomaly_filter(series.flag_first_pass(hot(spark, d), SERIES), ["device_id"])
    return found.select("device_id", F.explode("bloom").alias("bit"))


@query("""WITH o AS (SELECT sha256(text) AS sha, source AS owner, doc_id FROM documents) SELECT DISTINCT sha, owner FROM o WHERE doc_id % 4 <> 0 EXCEPT SELECT sha, owner FROM o WHERE doc_id % 6 = 1""")
def cas_links(spark, d):
    docs, objects = _objects(spark, d)
    refs = docs.select("doc_id", F.sha2("content", 256).alias("sha"), F.col("source").alias("owner"))
    linked = stores.link(refs.limit(0), refs.where("doc_id % 4 <> 0"), objects)
    return stores.unlink(linked, refs.where("doc_id % 6 = 1"))


@query("""SELECT conv_id || '-' || turn AS name, CASE WHEN turn % 5 = 1 THEN 'missing' WHEN turn % 5 = 2 THEN 'size' WHEN turn % 5 = 3 THEN 'sha256' ELSE 'ok' END AS status FROM conversations""")
def bundle_verify(spark, d):
    refs = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("name"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), "turn")
    found = refs.where("turn % 5 <> 1").withColumn("bytes", F.when(F.col("turn") % 5 == 2, F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(F.col("turn") % 5 == 3, F.lit("0")).otherwise(F.col("sha256")))
    return stores.verify_bundles(refs, found)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship: state of all entities half way through the feed."""
    return asof_ts(spark, sf_dir)
