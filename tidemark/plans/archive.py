"""An archive on shared storage: Parquet chunks by table and month, and a manifest in generations."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import PHOTO_REF, month_of, sanitize_table
from tidemark.model import CATALOG_VERSION, ROW_COLUMNS
from tidemark.operators import asof, catalog, integrity, lifecycle, lookup, normalize, seal, sync

#: Tables of the archive's state.  A chunk is a folder ``batch/lane/month/part`` under ``warm/``.
STATE = {
    "catalog": "file string, table string, seq_min bigint, seq_max bigint, ts_min bigint, ts_max bigint, rows bigint, bytes bigint, sha256 string, min_key string, max_key string, month string, quarantined boolean",
    "marks": "device_id string, high bigint",
    "cold": "file string, chunks array<string>, bytes bigint",
    "acks": "sha256 string, relay string",
}
CATALOG = [c.split()[0] for c in STATE["catalog"].split(", ")]
PLACE = ["batch", "lane", "month", "part"]
WARM = "device_id string, seq bigint, ts bigint, id string, table string, body string"
PHOTOS = "sha string, data binary"
#: Bytes of rows in a chunk, about; and the most files that a filter names one by one.
TARGET_BYTES, MOST_FILES = 64 << 20, 1000


#: Free bytes below which nothing is written.
RESERVE = 50 << 20


class Conflict(RuntimeError):
    """Another writer committed the generation that this one was about to."""


class Archive:
    """Seal, query and keep an archive.

    Rows lie under ``warm/`` as zstd Parquet by batch, table, month and part, sorted by
    number, with a Bloom filter on ``id``; large photos lie under ``photos/``.  What
    counts is in the manifest of the newest generation, which names the tables of the
    state.  A write puts its files and tables first and the manifest last, in one file,
    so it counts as a whole or not at all; two writers of one generation conflict, and the second
    fails.  A manifest that can't be read gives way to the one before it.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    # files and state

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/{folder}")
        fs.delete(p, True)

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """The newest generation's number, and the folders of its tables; an older one's if that can't be read."""
        newest = 0
        for name in reversed([n for n in self._names("manifest") if n.endswith(".json")]):
            newest = max(newest, int(name[:-5]))
            fs, p = self._fs(f"{self.root}/manifest/{name}")
            stream = fs.open(p)
            try:
                found = json.loads(bytes(stream.readAllBytes()).decode())
                if all(fs.exists(self._fs(f"{self.root}/{f}/_SUCCESS")[1]) for f in found["tables"].values()):
                    return newest, found["tables"]
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
            finally:
                stream.close()
        return newest, {}

    def _state(self, kind: str) -> DataFrame:
        folder = self._manifest()[1].get(kind)
        return self.spark.read.schema(STATE[kind]).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], STATE[kind])

    def _commit(self, based_on: int, **tables: DataFrame) -> None:
        """Write the tables, then the manifest that makes them and the unchanged ones count, if none came in between."""
        self._writable()
        n, named = self._manifest()
        if n != based_on:
            raise Conflict(f"generation {n} was committed after {based_on}")
        for kind, df in tables.items():
            folder = f"state/{n + 1:08d}-{kind}-{uuid.uuid4().hex[:8]}"
            df.select(*[c.split()[0] for c in STATE[kind].split(", ")]).write.parquet(f"{self.root}/{folder}")
            named = named | {kind: folder}
        fs, p = self._fs(f"{self.root}/manifest/{n + 1:08d}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"generation {n + 1} is there already") from e
        stream.write(bytearray(json.dumps({"version": CATALOG_VERSION, "tables": named}).encode()))
        stream.close()

    def _generation(self) -> int:
        return self._manifest()[0]

    def _writable(self) -> None:
        """Refuse writing to a read-only archive, and where so little is free that a write may end half done."""
        if self.read_only:
            raise PermissionError("archive opened read-only")
        fs, p = self._fs(self.root)
        while not fs.exists(p):
            p = p.getParent()
        free = fs.getStatus(p).getRemaining()
        if free < RESERVE:
            raise OSError(f"{free} bytes are free, {RESERVE} must stay in reserve")

    @property
    def chunks(self) -> DataFrame:
        return self._state("catalog")

    @property
    def cold(self) -> DataFrame:
        return self._state("cold")

    @property
    def acks(self) -> DataFrame:
        """Content hashes that relays have taken, and which relay."""
        return self._state("acks")

    @property
    def watermark(self) -> DataFrame:
        return self._state("marks")

    # rows and photos

    def _read(self, folder: str) -> DataFrame:
        """Rows under a folder with the ``file`` they lie in, whether the catalog has it or not."""
        fs, p = self._fs(f"{self.root}/{folder}")
        if not fs.exists(p) or not fs.listStatus(p):
            return self.spark.createDataFrame([], f"{WARM}, file string, {', '.join(f'{c} string' for c in PLACE)}")
        stored = self.spark.read.schema(f"{WARM}, {', '.join(f'{c} string' for c in PLACE)}").parquet(f"{self.root}/{folder}")
        return stored.withColumn("file", F.concat_ws("/", *PLACE)).select(*ROW_COLUMNS, "file", *PLACE)

    def _write(self, placed: DataFrame, folder: str) -> None:
        """Rows with their places, a file for each chunk."""
        (
            placed.select(*ROW_COLUMNS, *PLACE)
            .repartition(*PLACE)
            .sortWithinPartitions(*PLACE, "seq")
            .write.option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy(*PLACE)
            .mode("append")
            .parquet(f"{self.root}/{folder}")
        )

    @staticmethod
    def _in(rows: DataFrame, files: list[str]) -> DataFrame:
        """Rows of these chunks; the places are partitions, so other files aren't read."""
        kept = rows.where(F.struct(*PLACE).isin(*[F.struct(*map(F.lit, f.split("/"))) for f in files])) if 0 < len(files) <= MOST_FILES else rows
        return kept.where(F.col("file").isin(files)) if len(files) <= MOST_FILES else kept.join(rows.sparkSession.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")

    def rows(self) -> DataFrame:
        """Rows of all sound chunks in the catalog, with ``file`` and ``month``; other files aren't read as rows."""
        return self._read("warm").join(self.chunks.where(~F.col("quarantined")).select("file"), "file", "left_semi")

    def photos(self) -> DataFrame:
        """Bytes of photos by content hash, in folders by its first two digits (``prefix``)."""
        fs, p = self._fs(f"{self.root}/photos")
        schema = f"{PHOTOS}, prefix string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/photos") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def photo(self, reference: str) -> bytes:
        """The bytes that a reference names, checked for size and hash."""
        sha, size = self.spark.range(1).select(F.regexp_extract(F.lit(reference), PHOTO_REF, 1), F.regexp_extract(F.lit(reference), PHOTO_REF, 2)).first()
        if not sha:
            raise ValueError(f"{reference[:100]!r} is no reference to a photo")
        row = self.photos().where((F.col("sha") == sha) & (F.col("prefix") == sha[:2])).first()
        if row is None:
            raise FileNotFoundError(sha)
        data = bytes(row["data"])
        if len(data) != int(size) or hashlib.sha256(data).hexdigest() != sha:
            raise ValueError(f"photo {sha} is damaged")
        return data

    def photo_audit(self) -> DataFrame:
        """Referenced and stored photos: ok, size, missing or orphan."""
        refs = self.rows().select(F.regexp_extract("body", PHOTO_REF, 1).alias("sha"), F.regexp_extract("body", PHOTO_REF, 2).alias("size")).where("sha <> ''")
        return integrity.photo_audit(refs.select("sha", F.col("size").cast("bigint").alias("size")), self.photos().select("sha", F.octet_length("data").cast("bigint").alias("size")))

    def _add_photos(self, found: DataFrame) -> None:
        new = found.select("sha", "data").join(self.photos().select("sha"), "sha", "left_anti")
        new.withColumn("prefix", F.substring("sha", 1, 2)).write.partitionBy("prefix").mode("append").parquet(f"{self.root}/photos")

    # ingest

    def seal(self, normalized: DataFrame, max_rows: int | None = None, photo_limit: int = 256 * 1024, target_bytes: int = TARGET_BYTES) -> dict[str, int]:
        """Take in rows above the marks of their devices, the last of each key, in chunks of about ``target_bytes``.

        Photos are written first, then rows, then one generation with catalog and marks.
        Sealing the same rows again after a failure anywhere doubles none: what no
        manifest names doesn't count.
        """
        self._writable()
        gate = normalize.malformed_gate(normalized).first()
        if gate["aborts"]:
            raise ValueError(f"{gate['malformed']} of {gate['total']} records are malformed")
        based_on = self._generation()
        rows = normalized.where(~F.col("malformed")).select(*ROW_COLUMNS, "pos")
        marked = seal.after_watermark(rows, self.watermark)
        fresh = seal.keep_last(marked.where("not skipped").drop("skipped"))
        fresh = seal.bounded(fresh, max_rows) if max_rows else fresh
        counts = marked.agg(F.count("*").alias("n"), F.count_if("skipped").alias("s")).first()
        done = {"sealed": 0, "skipped": counts["s"], "malformed": gate["malformed"]}
        if counts["n"] == counts["s"]:
            return done
        batch = f"{based_on + 1:08d}-{uuid.uuid4().hex[:8]}"
        gated = normalize.photo_gate(fresh.withColumn("original", F.col("body")), photo_limit)
        self._add_photos(normalize.photos(gated, "original"))
        placed = gated.select(*ROW_COLUMNS).withColumn("month", month_of(F.col("ts"))).withColumn("batch", F.lit(batch)).withColumn("lane", sanitize_table(F.col("table")))
        packed = seal.pack(placed, target_bytes, by=["lane", "month"])
        self._write(packed.withColumn("part", F.col("chunk_no").cast("string")), "warm")
        new = self._read("warm").where(F.col("batch") == batch)
        entries = catalog.chunk_entries(new.select(*ROW_COLUMNS, "file"))
        self._commit(based_on, catalog=catalog.append_entries(self.chunks, entries.select(*CATALOG)), marks=seal.advance_watermark(self.watermark, new))
        return done | {"sealed": new.count()}

    # queries

    def find(self, key: str) -> DataFrame:
        """The first row with that id; only chunks whose keys can hold it are read."""
        if "\x1f" in key:
            return lookup.find_first(self.rows(), key).select(*ROW_COLUMNS)
        files = [r["file"] for r in lookup.candidates(self.chunks, key).where("hit").select("file").collect()]
        return lookup.find_first(self._in(self._read("warm"), files), key).select(*ROW_COLUMNS)

    def register(self, name: str) -> None:
        """Views ``name_rows`` and ``name_chunks``, and a table function ``name_find(key)``, for SQL of this session."""
        self.rows().select(*ROW_COLUMNS, "file").createOrReplaceTempView(f"{name}_rows")
        self.chunks.createOrReplaceTempView(f"{name}_chunks")
        columns = ", ".join(f"`{f.split()[0]}` {f.split()[1]}" for f in WARM.split(", "))
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_find(key STRING) RETURNS TABLE ({columns}) "
            f"RETURN SELECT {', '.join(f'`{c}`' for c in ROW_COLUMNS)} FROM {name}_rows WHERE id = key ORDER BY seq, device_id, `table` LIMIT 1"
        )

    def as_of(self, **at: int) -> DataFrame:
        """State as of a time or number; of rows with equal number and time that of the first chunk wins."""
        starts = asof.prune(self.chunks, **at).where("kept").select("file", F.col("seq_min").alias("chunk_seq_min"))
        return asof.as_of(self._read("warm").join(starts, "file").select(*ROW_COLUMNS, "chunk_seq_min"), **at).select(*ROW_COLUMNS)

    def _present(self) -> DataFrame:
        """Chunks that have a folder; read from the listing, not from rows."""
        out = []
        for batch in self._names("warm"):
            for lane in self._names(f"warm/{batch}") if "=" in batch else []:
                for month in self._names(f"warm/{batch}/{lane}"):
                    out += [("/".join(x.split("=", 1)[1] for x in (batch, lane, month, part)),) for part in self._names(f"warm/{batch}/{lane}/{month}") if "=" in part]
        return self.spark.createDataFrame(out, "file string")

    def proof(self, **at: int) -> DataFrame:
        return asof.proof(self.chunks, self._present(), **at)

    def status(self) -> DataFrame:
        return lifecycle.status(self.chunks, self.cold, self.acks.select("sha256").distinct(), self._present())

    def verify(self) -> tuple[DataFrame, DataFrame]:
        """Statuses of chunks and faults of chains."""
        found = catalog.chunk_entries(self._read("warm").join(self.chunks.select("file"), "file", "left_semi"))
        return integrity.verify(self.chunks, found), integrity.chain(self.chunks)

    def alerts(self, free_mb: int) -> DataFrame:
        return lifecycle.alerts(self.status().withColumn("free_mb", F.lit(free_mb)))

    # cold segments

    def merge(self) -> int:
        """Copy chunks that no segment holds into a new cold segment."""
        self._writable()
        based_on = self._generation()
        pending = lifecycle.merge_pending(self.chunks, self.cold)
        n = pending.count()
        if n:
            name = f"segment={based_on + 1:08d}-{uuid.uuid4().hex[:8]}"
            held = self._read("warm").join(pending.select("file"), "file", "left_semi")
            held.select(*ROW_COLUMNS, *PLACE).write.option("compression", "zstd").partitionBy(*PLACE).parquet(f"{self.root}/segments/{name}")
            entry = pending.agg(F.lit(name).alias("file"), F.sort_array(F.collect_list("file")).alias("chunks"), F.sum("bytes").alias("bytes"))
            self._commit(based_on, cold=self.cold.unionByName(entry))
        return n

    def _segments(self) -> DataFrame:
        """Rows of the segments that count, with the chunk they came from."""
        names = [r["file"] for r in self.cold.select("file").collect()]  # a row for each segment
        if not names:
            return self._read("warm").limit(0)
        stored = self.spark.read.schema(f"{WARM}, {', '.join(f'{c} string' for c in ('segment', *PLACE))}").option("basePath", f"{self.root}/segments").parquet(*[f"{self.root}/segments/{n}" for n in names])
        return stored.withColumn("file", F.concat_ws("/", *PLACE)).select(*ROW_COLUMNS, "file", *PLACE)

    def find_cold(self, key: str) -> DataFrame:
        """The first row with that id in the segments; chunks whose keys rule it out aren't read."""
        rows = self._segments()
        if "\x1f" not in key:
            known = self.chunks.withColumn("quarantined", F.lit(False))  # damage of the warm copy says nothing of this one
            files = [r["file"] for r in lookup.candidates(known, key).where("not hit").select("file").collect()]
            rows = rows.where(~F.col("file").isin(files)) if 0 < len(files) <= MOST_FILES else rows
        return lookup.find_first(rows, key).select(*ROW_COLUMNS)

    def restore(self, target: Archive) -> dict[str, int]:
        """Put the chunks of all segments into another archive, where it lacks them; marks there rise to match."""
        return target._take_chunks(self._segments(), None)

    # other archives

    def _take_chunks(self, rows: DataFrame, entries: DataFrame | None) -> dict[str, int]:
        """Add chunks whose content this archive lacks, under their names; an entry counts by the rows that came."""
        self._writable()
        based_on = self._generation()
        there = catalog.chunk_entries(rows)
        if entries is not None:  # only what is as the sender's catalog says
            there = there.join(entries.select("file", "sha256"), ["file", "sha256"], "left_semi")
        new = there.join(self.chunks.select("sha256"), "sha256", "left_anti").join(self.chunks.select("file"), "file", "left_anti").select(*CATALOG).collect()
        files = [r["file"] for r in new]
        if files:
            self._drop_chunks(files)  # left by a run that failed
            self._write(self._in(rows, files), "warm")
            taken = self.spark.createDataFrame(new, STATE["catalog"])
            self._commit(based_on, catalog=catalog.append_entries(self.chunks, taken), marks=seal.advance_watermark(self.watermark, self._in(rows, files)))
        return {"chunks": len(files), "rows": sum(r["rows"] for r in new)}

    def _drop_chunks(self, files: list[str]) -> None:
        for f in files:
            self._delete("warm/" + "/".join(f"{c}={v}" for c, v in zip(PLACE, f.split("/"), strict=True)))

    def ship(self, relay: Archive, blobs: bool = False) -> dict[str, int]:
        """Send sound chunks whose content the relay lacks, with their photos, and note what that relay holds."""
        self._writable()
        based_on = self._generation()
        plan = sync.ship_plan(self.chunks, relay.chunks.where(~F.col("quarantined")).select("sha256"), blobs)
        totals = {r["action"]: r["chunks"] for r in sync.ship_totals(plan).collect()}
        todo = [r["file"] for r in plan.where("action = 'ship'").select("file").collect()]
        if todo:
            rows = self._in(self._read("warm"), todo)
            refs = rows.select(F.regexp_extract("body", PHOTO_REF, 1).alias("sha")).where("sha <> ''").distinct()
            relay._add_photos(self.photos().join(refs, "sha", "left_semi"))
            relay._take_chunks(rows, self.chunks)
        held = self.chunks.join(relay.chunks.where(~F.col("quarantined")).select("sha256"), "sha256", "left_semi")
        now = held.select("sha256", F.lit(relay.root).alias("relay"))
        new = now.join(self.acks, ["sha256", "relay"], "left_anti").distinct()
        if not new.isEmpty():
            self._commit(based_on, acks=self.acks.unionByName(new))
        return totals

    def repair(self, relay: Archive) -> dict[str, int]:
        """Replace chunks that aren't sound by those of the same content on the relay; photos that are lost come back too."""
        self._writable()
        based_on = self._generation()
        bad = self.verify()[0].where("status <> 'OK'").join(self.chunks.select("file", "sha256"), "file").collect()  # the chunks that are damaged
        source = relay._read("warm").join(relay.chunks.where(~F.col("quarantined")).select("file"), "file", "left_semi")
        found = catalog.chunk_entries(source).where(F.col("sha256").isin([r["sha256"] for r in bad]))
        sound = {r["sha256"]: r["file"] for r in found.collect()}
        pairs = {r["file"]: sound[r["sha256"]] for r in bad if r["sha256"] in sound}
        for file, name in pairs.items():
            self._drop_chunks([file])
            copy = self._in(source, [name])
            for c, v in zip(PLACE, file.split("/"), strict=True):
                copy = copy.withColumn(c, F.lit(v))
            self._write(copy, "warm")
        lost = self.photo_audit().where("status in ('missing', 'size')").select("sha")
        self._add_photos(relay.photos().join(lost, "sha", "left_semi"))
        if pairs:
            mended = F.col("file").isin(list(pairs))
            self._commit(based_on, catalog=self.chunks.withColumn("quarantined", F.col("quarantined") & ~mended))
        return {"repaired": len(pairs), "left": len(bad) - len(pairs)}

    # upkeep

    def forget(self, files: list[str]) -> None:
        """Drop acknowledged chunks from the catalog, all or none; ``sweep`` deletes their files."""
        self._writable()
        based_on = self._generation()
        targets = self.spark.createDataFrame([(f,) for f in files], "file string")
        if not lifecycle.forget_check(targets, self.chunks, self.acks).first()["allowed"]:
            raise ValueError("not all chunks are known and acknowledged")
        self._commit(based_on, catalog=self.chunks.join(targets, "file", "left_anti"))

    def quarantine(self, files: list[str]) -> None:
        self._commit(self._generation(), catalog=self.chunks.withColumn("quarantined", F.col("quarantined") | F.col("file").isin(files)))

    def sweep(self, apply: bool = False, relay: Archive | None = None) -> dict[str, list[str]]:
        """Chunks on disk outside the catalog: those whose content a relay took may go, others stay.

        Without a relay the noted acknowledgements decide, with one what it holds now.
        """
        lost = self._read("warm").join(self.chunks.select("file"), "file", "left_anti")
        acks = self.acks if relay is None else relay.chunks.where(~F.col("quarantined"))
        found = lifecycle.orphans(catalog.chunk_entries(lost).select("file", "sha256"), self.chunks.select("file"), acks.select("sha256")).collect()
        out = {"deletable": sorted(r["file"] for r in found if r["deletable"]), "kept": sorted(r["file"] for r in found if not r["deletable"])}
        if apply:
            self._writable()
            self._drop_chunks(out["deletable"])
        return out

    def migrate(self) -> dict[str, int]:
        """Rebuild the statistics of the catalog from the rows on disk; without a catalog, all of it.

        Chunks outside the catalog stay outside, and flags stay.
        """
        based_on, named = self._manifest()
        found = catalog.chunk_entries(self._read("warm"))
        if "catalog" in named:
            flags = self.chunks.select("file", F.col("quarantined").alias("flag"))
            fresh = found.join(flags, "file").withColumn("quarantined", F.col("flag")).select(*CATALOG)
            found = fresh.unionByName(self.chunks.join(fresh.select("file"), "file", "left_anti"))
        self._commit(based_on, catalog=found, marks=seal.advance_watermark(self.watermark, self._read("warm").join(found.select("file"), "file", "left_semi")))
        return {"version": CATALOG_VERSION, "chunks": self.chunks.count()}
