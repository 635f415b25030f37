"""Small cases with known results."""

import base64
import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.checksums import crc32c, crc32c_bytes
from tidemark.model import ROW
from tidemark.operators import asof, catalog, integrity, normalize, seal, series, stores
from tidemark.plans.archive import Archive, Conflict
from tidemark.sources.hot import read_hot

VERSIONS = [("a", 1, 1000, "a-v1"), ("b", 2, 2000, "b-v1"), ("c", 3, 3000, "c-v1"), ("b", 4, 4000, "b-v2"), ("d", 5, 5000, "d-v1"), ("a", 6, 6000, "a-v2")]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame([("dev", s, t, i, "log", b) for i, s, t, b in VERSIONS], ROW)


@pytest.mark.parametrize(
    ("at", "want"),
    [
        ({"ts": 2500}, ["a-v1", "b-v1"]),
        ({"ts": 4500}, ["a-v1", "b-v2", "c-v1"]),
        ({"ts": 6500}, ["a-v2", "b-v2", "c-v1", "d-v1"]),
        ({"seq": 2}, ["a-v1", "b-v1"]),
        ({"ts": 6500, "window_ms": 2000}, ["a-v2", "d-v1"]),
        ({"seq": 6, "window_seq": 2}, ["a-v2", "d-v1"]),
    ],
)
def test_as_of(versions, at, want):
    assert sorted(r["body"] for r in asof.as_of(versions, **at).collect()) == want


@pytest.mark.parametrize("at", [{}, {"ts": 1, "seq": 1}, {"ts": 1, "window_seq": 1}, {"seq": 1, "window_ms": 1}, {"ts": 1, "window_ms": -1}])
def test_as_of_arguments(at):
    with pytest.raises(ValueError):
        asof.bounds(**at)


def points(spark, values, step=1000):
    return spark.createDataFrame([(i * step, float(v), i) for i, v in enumerate(values)], "ts long, value double, seq long")


def test_downsample(spark):
    got = sorted(series.downsample(points(spark, range(1, 11)), 5000, []).collect(), key=lambda r: r["t0"])
    assert [(r["count"], r["min"], r["max"], r["avg"], r["first"], r["last"]) for r in got] == [(5, 1, 5, 3, 1, 5), (5, 6, 10, 8, 6, 10)]


def test_two_passes(spark):
    flags = lambda vs: [r["seq"] for r in series.flag_two_passes(points(spark, vs).withColumn("k", F.lit(1)), ["k"], 8).collect() if r["flagged"]]
    assert flags([20] * 12 + [200]) == [12]
    assert sorted(flags([20] * 12 + [10000, 200])) == [12, 13]


RECORDS = [
    ({"seq": 1, "ts": 5, "type": "entry", "trx": "trx-3", "value": 55000, "actor": "u"}, ("entry", "trx-3", "entry value=55000 actor=u")),
    ({"seq": "5", "ts": "7", "event": "undo", "ref": "trx-5", "reason": "r"}, ("undo", "undo\x1fdev0\x1f5", "undo ref=trx-5 reason=r")),
    ({"seq": 2, "ts": 5, "type": "tally.add", "payload": {"item": "widget", "qty": 5}}, ("tally.add", "tally.add\x1fdev0\x1f2", "tally.add item=widget qty=5")),
    ({"seq": 3, "ts": 5, "body": "x", "id": "i"}, ("log", "i", "x")),
    *[({"seq": s, "ts": 5}, None) for s in ("", 1.5, -3, 0, 100_000_000)],
    *[({"seq": 1, "ts": t}, None) for t in ("", -1, 1.5)],
    ({"ts": 5}, None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(99, "no json"), (98, None)], "n int, value string")
    got = {r["n"]: None if r["malformed"] else (r["table"], r["id"], r["body"]) for r in normalize.normalize(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(RECORDS)} | {98: None, 99: None}


def test_chain(spark):
    chunk = "table string, file string, seq_min long, seq_max long, rows long, quarantined boolean"
    gap = spark.createDataFrame([("t", "a", 1, 1500, 1500, False), ("t", "b", 2500, 3999, 1500, False)], chunk)
    assert [(r["kind"], r["missing"]) for r in integrity.chain(gap).collect()] == [("gap", 999)]
    over = spark.createDataFrame([("t", "a", 1, 10, 10, False), ("t", "b", 5, 20, 16, False)], chunk)
    assert [r["kind"] for r in integrity.chain(over).collect()] == ["break"]


def test_claims(spark):
    claims = spark.createDataFrame([("a", 100), ("b", 100), ("e", 1)], "claim string, expires_at long")
    tries = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "b", 6), (4, "e", 9), (5, "z", 1)], "attempt long, claim string, used_at long")
    out = stores.use_claims(claims, tries)
    assert {r["attempt"]: r["outcome"] for r in out.collect()} == {1: "ok", 2: "ok", 3: "double-use", 4: "expired", 5: "unknown"}
    server = spark.createDataFrame([("a",), ("x",)], "claim string")
    assert sorted((r["claim"], r["kind"]) for r in stores.reconcile(out, server).collect()) == [("a", "clean"), ("b", "double"), ("b", "local"), ("x", "remote")]


def test_crowded_claims(spark, monkeypatch):
    """Claims that very many attempts name, unknown, null, known or with several rows, are dealt in shares without another result."""
    claims = spark.createDataFrame([("hot", 500), ("cold", 500), ("late", -1), ("two", 3), ("two", 30), ("few", 9)], "claim string, expires_at long")
    names = ["hot"] * 400 + ["none"] * 300 + [None] * 200 + ["late"] * 200 + ["two"] * 90 + ["few"] * 3
    rows = [(i // 2, name, None if i % 97 == 5 and name == "hot" else i * 7 % 600) for i, name in enumerate(names)]
    tries = spark.createDataFrame(rows + rows, "attempt long, claim string, used_at long")
    key = lambda r: tuple(str(x) for x in r)
    plain = sorted(stores.use_claims(claims, tries, crowd=10**9).collect(), key=key)
    dealt = stores.use_claims(claims, tries, crowd=20)
    assert sorted(dealt.collect(), key=key) == plain
    assert sorted(r["claim"] for r in dealt.where("outcome = 'ok'").collect()) == sorted(r["claim"] for r in plain if r["outcome"] == "ok")
    assert {r["_claim"]: r["_shares"] for r in stores._crowded(tries, 20).collect()} == {"hot": 40, "none": 30, None: 20, "late": 20, "two": 9}
    monkeypatch.setattr(stores, "CELLS", 1)  # all claims in one cell
    assert sorted(stores.use_claims(claims, tries, crowd=20).collect(), key=key) == plain
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(r["count"] for r in dealt.where("claim = 'none'").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 400  # no task has all 600 attempts of the unknown claim


def test_crc32c(spark):
    assert crc32c_bytes(b"123456789") == 0xE3069283
    assert spark.createDataFrame([(b"123456789",)], "x binary").select(crc32c("x")).first()[0] == 0xE3069283


def test_keep_last_and_bounds(spark):
    df = spark.createDataFrame([("d", 1, "t", "x", 1), ("d", 1, "t", "y", 2), ("e", 1, "t", "z", 3), ("d", 2, "t", "w", 4)], "device_id string, seq long, table string, body string, pos long")
    assert sorted(r["body"] for r in seal.keep_last(df).collect()) == ["w", "y", "z"]
    assert sorted(r["body"] for r in seal.bounded(df, 1).collect()) == ["x", "y"]


def test_archive(spark, tmp_path):
    feed = tmp_path / "feed.jsonl"
    feed.write_text("\n".join(json.dumps({"device_id": f"device-0{1 + i % 2}", "seq": 1 + i // 2, "ts": 1_700_000_000_000 + i * 86_400_000, "id": f"k{i:03d}", "type": "sale", "body": f"b{i}"}) for i in range(60)) + "\n\n")
    a = Archive(spark, str(tmp_path / "a"))
    assert a.seal(read_hot(spark, str(feed))) == {"sealed": 60, "skipped": 0, "malformed": 0}
    assert a.seal(read_hot(spark, str(feed)))["skipped"] == 60
    assert a.find("k017").first()["body"] == "b17"
    assert a.as_of(ts=1_700_000_000_000 + 9 * 86_400_000).count() == 10
    statuses, faults = a.verify()
    assert {r["status"] for r in statuses.collect()} == {"OK"}
    relay = Archive(spark, str(tmp_path / "r"))
    n = a.chunks.count()
    assert a.ship(relay) == {"ship": n} and a.ship(relay) == {"already-acked": n}
    assert relay.rows().count() == 60
    assert a.merge() == n and a.merge() == 0
    assert a.find_cold("k003").first()["body"] == "b3"
    one = a.chunks.first()["file"]
    a.forget([one])
    assert a.chunks.count() == n - 1
    with pytest.raises(PermissionError):
        Archive(spark, a.root, read_only=True).merge()
    back = Archive(spark, str(tmp_path / "b"))
    assert a.restore(back) == {"chunks": n, "rows": 60} and a.restore(back) == {"chunks": 0, "rows": 0}


def feed_rows(spark, n, device="d", first=1, body="b", table="log"):
    rows = [(device, i, 1_700_000_000_000 + i, f"{device}-{i:04d}", table, body if len(body) > 9 else f"{body}{i}", False, i) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "device_id string, seq long, ts long, id string, table string, body string, malformed boolean, pos long")


@pytest.fixture()
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "a"))


def other(archive, name):
    return Archive(archive.spark, archive.root[:-1] + name)


def test_photos_are_stored(spark, archive):
    data = bytes(range(256)) * 1200
    text = base64.encodebytes(data).decode()
    assert archive.seal(feed_rows(spark, 2, body=text, table="photo"))["sealed"] == 2
    archive.seal(feed_rows(spark, 1, device="e", body=text))
    refs = {r["body"] for r in archive.rows().collect()}
    assert len(refs) == 1 and archive.photos().count() == 1
    ref = refs.pop()
    assert archive.photo(ref) == data and [r["status"] for r in archive.photo_audit().collect()] == ["ok"]
    relay = other(archive, "r")
    archive.ship(relay, blobs=True)
    assert relay.photo(ref) == data
    archive._delete("photos")
    with pytest.raises(FileNotFoundError):
        archive.photo(ref)
    archive.repair(relay)
    assert archive.photo(ref) == data
    with pytest.raises(ValueError):
        archive.photo("photo:sha256:x")


def test_replay_after_a_lost_commit(spark, archive, monkeypatch):
    rows = feed_rows(spark, 10)
    with monkeypatch.context() as m:
        m.setattr(Archive, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            archive.seal(rows)
    assert archive.rows().count() == 0
    assert archive.seal(rows)["sealed"] == 10 and archive.seal(rows) == {"sealed": 0, "skipped": 10, "malformed": 0}
    assert archive.rows().count() == 10
    found = archive.sweep(apply=True)  # nobody took the lost rows: they stay
    assert found["deletable"] == [] and len(found["kept"]) == 1 and archive._read("warm").count() == 20
    relay = other(archive, "r")
    archive.ship(relay)
    assert len(archive.sweep(apply=True)["deletable"]) == 1 and archive._read("warm").count() == archive.rows().count() == 10


def test_each_relay_gets_all(spark, archive):
    archive.seal(feed_rows(spark, 5))
    archive.seal(feed_rows(spark, 5, first=6))
    for name in ("r", "s"):
        relay = other(archive, name)
        assert archive.ship(relay) == {"ship": 2} and archive.ship(relay) == {"already-acked": 2} and relay.rows().count() == 10
    assert archive.acks.count() == 4 and archive.acks.select("relay").distinct().count() == 2


def test_repair_replaces(spark, archive):
    archive.seal(feed_rows(spark, 5))
    relay = other(archive, "r")
    archive.ship(relay)
    file = archive.chunks.first()["file"]
    folder = "warm/" + "/".join(f"{c}={v}" for c, v in zip(("batch", "lane", "month", "part"), file.split("/"), strict=True))
    for damage in ("changed", "lost", "flagged", "lost"):
        if damage == "flagged":
            archive.quarantine([file])
        else:
            archive._delete(folder)
        if damage == "changed":
            wrong = feed_rows(spark, 5, body="x")
            for c, v in zip(("batch", "lane", "month", "part"), file.split("/"), strict=True):
                wrong = wrong.withColumn(c, F.lit(v))
            archive._write(wrong, "warm")
        assert [r["status"] for r in archive.verify()[0].collect()] == [{"changed": "CORRUPT", "lost": "MISSING", "flagged": "QUARANTINED"}[damage]]
        assert archive.repair(relay) == {"repaired": 1, "left": 0}
        assert [r["status"] for r in archive.verify()[0].collect()] == ["OK"]
        assert sorted(r["body"] for r in archive.rows().collect()) == [f"b{i}" for i in range(1, 6)]


def test_migrate_keeps_what_was_decided(spark, archive):
    for i in range(3):
        archive.seal(feed_rows(spark, 4, first=1 + 4 * i))
    archive.ship(other(archive, "r"))
    files = sorted(r["file"] for r in archive.chunks.collect())
    archive.forget(files[:1])
    archive.quarantine(files[1:2])
    assert archive.migrate()["chunks"] == 2
    assert {r["file"]: r["quarantined"] for r in archive.chunks.collect()} == {files[1]: True, files[2]: False}
    archive._delete("manifest")
    assert archive.migrate()["chunks"] == 3 and archive.seal(feed_rows(spark, 12))["sealed"] == 0


def test_restore_below_a_mark(spark, archive):
    archive.seal(feed_rows(spark, 10))
    archive.merge()
    back = other(archive, "b")
    back.seal(feed_rows(spark, 1, first=50))
    assert archive.restore(back) == {"chunks": 1, "rows": 10} and back.rows().count() == 11
    assert back.find("d-0003").first()["body"] == "b3"


def test_one_writer_wins(spark, archive):
    archive.seal(feed_rows(spark, 3))
    before = archive._generation()
    archive.quarantine([])
    with pytest.raises(Conflict):
        archive._commit(before, catalog=archive.chunks)
    assert archive.rows().count() == 3


def test_unreadable_manifest(spark, archive):
    archive.seal(feed_rows(spark, 3))
    fs, p = archive._fs(f"{archive.root}/manifest/00000002.json")
    fs.create(p, False).close()  # a writer that was lost
    assert archive.rows().count() == 3 and archive.seal(feed_rows(spark, 2, first=4))["sealed"] == 2
    assert archive.rows().count() == 5


def test_sql_surface(spark, archive):
    archive.seal(feed_rows(spark, 5))
    archive.register("arc")
    assert [r["body"] for r in spark.sql("select body from arc_find('d-0002')").collect()] == ["b2"]
    assert spark.sql("select * from arc_find('none')").isEmpty() and spark.sql("select sum(rows) from arc_chunks").first()[0] == 5


def test_reserve(spark, archive, monkeypatch):
    from tidemark.plans import archive as module

    monkeypatch.setattr(module, "RESERVE", 1 << 60)
    with pytest.raises(OSError):
        archive.seal(feed_rows(spark, 1))


def test_objects_and_names(spark):
    objects = stores.put(spark.createDataFrame([], "sha string, content binary"), spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary"))
    sha = objects.where("content = X'78'").first()["sha"]
    assert objects.count() == 2 and stores.get(objects, sha) == b"x"
    with pytest.raises(FileNotFoundError):
        stores.get(objects, "0")
    for bad in ("", "a/b", "..", None):
        with pytest.raises(Exception, match="bad name"):
            stores.pack_bundles(spark.createDataFrame([(1, bad, "t")], "k int, n string, t string"), "k", "n", "t").collect()


def test_fnv_of_utf16(spark):
    def fnv(text):
        h = 2166136261
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "abc", "é日", "a\U0001f600b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.fnv1a32(F.col("t"))).collect()
    assert [r[0] for r in got] == [fnv(t) for t in texts]


def test_bloom_positions(spark):
    """All hashes of a key in one pass, and one pass over the rows for ranges and filters."""

    def fnv(text):
        h, units = 2166136261, text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "a", "trx-00000778", "é日x", "a\U0001f600b\U0001f601"]
    keys = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = keys.select("t", scalars.bloom_positions(F.col("t")).alias("p"))
    want = {t: [(fnv(f"{i}:{t}") ^ fnv(t[::-1])) % 2048 for i in range(3)] for t in texts} | {None: None}
    assert {r["t"]: r["p"] for r in got.collect()} == want
    assert got._jdf.queryExecution().toString().split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("aggregate(") == 1
    held = keys.where("t is not null").select(F.array(*[F.lit(b) for b in want["a"]]).alias("bits"), "t").select("t", scalars.bloom_may_contain(F.col("bits"), F.col("t")).alias("may"))
    assert {r["t"]: r["may"] for r in held.collect()} == {t: set(want[t]) <= set(want["a"]) for t in texts}
    rows = [("d", i, 1, k, "t", "b", f) for i, (k, f) in enumerate([("k1", "f1"), ("k2", "f1"), (None, "f2")])]
    entries = catalog.chunk_entries(spark.createDataFrame(rows, "device_id string, seq long, ts long, id string, table string, body string, file string"), bloom=True)
    assert {r["file"]: r["bloom"] for r in entries.collect()} == {"f1": sorted({(fnv(f"{i}:{k}") ^ fnv(k[::-1])) % 2048 for i in range(3) for k in ("k1", "k2")}), "f2": []}


def test_chunks_are_bounded(spark, archive):
    assert archive.seal(feed_rows(spark, 200), target_bytes=2000)["sealed"] == 200
    got = archive.chunks.collect()
    assert len(got) > 5 and max(r["bytes"] for r in got) < 2200 and sum(r["rows"] for r in got) == 200
    assert archive.find("d-0150").first()["body"] == "b150" and archive.find("nothing").isEmpty()
    size = max(f.stat().st_size for f in Path(archive.root, "warm").rglob("*.parquet"))
    assert size < 100_000  # Bloom filters of the chunk's own size


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "f.db") as db:
        db.execute("create table tx (device_id text, no integer, waktu integer, trx text, kind text, payload text)")
        db.executemany("insert into tx values (?, ?, ?, ?, ?, ?)", [("d", i, 1000 + i, f"t{i}", "sale", "p") for i in range(1, 51)])
    got = read_hot(spark, str(tmp_path / "f.db"))
    assert got.where("not malformed").count() == 50


def test_streaming(spark, tmp_path):
    from tidemark.streaming.feeds import seal_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text("\n".join(json.dumps({"seq": i, "ts": 1000 + i, "body": "x"}) for i in range(1, 21)))
    a = Archive(spark, str(tmp_path / "s"))
    for _ in range(2):
        seal_stream(spark, str(tmp_path / "in"), a, str(tmp_path / "cp")).awaitTermination()
    assert a.rows().count() == 20
