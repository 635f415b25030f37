"""Removal of long byte strings that occur more than once in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, reference, release_memory, slices, small_batches
from tidemark.llm.words import BASE, BYTE_KEYS, INVERSE, mix, powers
from tidemark.session import materialize

#: Low bits of a key that hold a place in a block of windows.
PLACE_BITS = 25
#: Windows of a block; blocks overlap, so that each holds all anchors of its windows.
BLOCK = 1 << 22
#: Suffixes that a round of refinement moves together, by round; the last round tells single ones apart.
WIDTHS = (32, 4, 1)
RUNS = "array<struct<start:int,n:int,at:int,anchor:bigint,hull:binary>>"
_RUN = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("anchor", pa.int64()), ("hull", pa.binary())])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and where each begins (and the end)."""
    column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers(BASE, len(data)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal strings wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def _name(data: memoryview | bytes) -> bytes:
    """Names of intervals: strings have one name only if they are equal (128 bits of BLAKE2b)."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` keys, by runs of doubling width."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _anchors(sums: np.ndarray, length: int) -> np.ndarray:
    """Where the anchor of each window of ``length`` bytes begins.

    Keys hold places within a block: those of a whole text of any size would not fit beside the hash.
    """
    half = length // 2
    width = length - half + 1
    if BLOCK + width > 1 << PLACE_BITS:
        raise ValueError(f"windows of {length} bytes are too long")
    mask = np.uint64((1 << PLACE_BITS) - 1)
    n = len(sums) - length
    chosen = np.zeros(n, np.int64)
    for low in range(0, n, BLOCK):
        high = min(low + BLOCK, n)
        at = np.arange(low, high + width - 1)
        keys = (_hashes(sums, at, at + half) & ~mask) | (at - low).astype(np.uint64)
        chosen[low:high] = (_least(keys, width) & mask).astype(np.int64) + low
    return chosen


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of ``length`` bytes of each text, in runs that share an anchor.

    The anchor of a window is the string of half its length in it with the least hash,
    the leftmost of equal ones; equal windows have equal anchors.  For each run: its
    first window's start, how many windows, where the anchor starts, and the anchor's hash.
    """
    half = length // 2
    out = []
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return [none] * (len(offsets) - 1)
    sums = _sums(data)
    chosen = _anchors(sums, length)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a < length:
            out.append(none)
            continue
        own = chosen[a : b - length + 1]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(own)]]))
        anchor = own[starts]
        out.append((starts, sizes, anchor - a, _hashes(sums, anchor, anchor + half)))
    return out


def _profiles(docs: DataFrame, length: int) -> DataFrame:
    """The window runs of every text that has windows, with the name of all bytes that a run's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = _bytes_of(batch.column("text"))
            runs = window_runs(data, offsets, length)
            view = memoryview(data)
            hulls = [_name(view[a + s : a + s + n - 1 + length]) for a, r in zip(offsets.tolist(), runs, strict=False) for s, n in zip(r[0].tolist(), r[1].tolist(), strict=True)]
            flat = [np.concatenate(x) for x in zip(*runs, strict=True)]
            cols = [pa.array(x.astype(np.int32)) for x in flat[:3]] + [pa.array(flat[3].view(np.int64)), pa.array(hulls, pa.binary())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]), pa.int32()), pa.StructArray.from_arrays(cols, fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), lists], names=["doc_id", "same", "runs"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, f"doc_id long, same binary, runs {RUNS}")


def _stretches(texts: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of each run in ``needed`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for node, text, needed in zip(*(batch.column(c) for c in ("node", "text", "needed")), strict=True):
                data = text.as_py().encode()
                parts += [(node.as_py(), r["start"], r["n"], r["at"], r["weight"], data[r["start"] : r["start"] + r["n"] - 1 + length]) for r in needed.as_py()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=["node", "start", "n", "at", "weight", "data"])
            release_memory()

    return texts.mapInArrow(run, "node long, start int, n int, at int, weight int, data binary")


def _blocks(stretches: DataFrame, width: int, length: int) -> DataFrame:
    """Blocks of at most ``width`` suffixes of what is ``open``, with the names of their cores and hulls.

    A suffix stands ``d`` bytes before its anchor, and blocks are cut where ``d`` is a
    multiple of ``width``, alike at all places of an anchor.  The core is what all
    suffixes of a full block share, the hull what its suffixes here cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for rid, node, start, at, data, opened in zip(*(batch.column(c).to_pylist() for c in ("rid", "node", "start", "at", "data", "open")), strict=True):
                view, anchor = memoryview(data), at - start
                for part in opened:
                    for first in range(part["lo"] // width * width, part["hi"] + 1, width):
                        lo, hi = max(first, part["lo"]), min(first + width - 1, part["hi"])
                        hull = _name(view[anchor - hi : anchor - lo + length])
                        core = hull if width == 1 else _name(view[anchor - first : anchor - first + max(0, length - width + 1)])
                        parts.append((rid, node, at, lo, hi, part["weight"], core, hull))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            cols = list(zip(*parts, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rid", "node", "at", "lo", "hi", "weight", "core", "hull"])
            release_memory()

    return stretches.mapInArrow(run, "rid long, node long, at int, lo int, hi int, weight int, core binary, hull binary")


def covered_spans(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the windows of ``length`` bytes in runs of ``sizes`` consecutive starts."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        a, b = int(starts[k]), int(starts[k] + sizes[k] - 1 + length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _counted(named: DataFrame, by: str, *home: str) -> tuple[DataFrame, DataFrame]:
    """How often each hull is found under each core (or anchor) ``by``, at which place first; and how often each ``by`` that is found twice, and its rarest hull."""
    hulls = materialize(named.groupBy(by, "hull").agg(F.sum("weight").alias("found"), F.min(F.struct(*home)).alias("home")), "hulls")
    return hulls, materialize(hulls.groupBy(by).agg(F.sum("found").alias("under"), F.min("found").alias("rarest")).where("under > 1"), "totals")


def repeated_windows(nodes: DataFrame, own: DataFrame, length: int) -> DataFrame:
    """Runs (``node``, ``start``, ``n``) of suffixes of texts that aren't copied, whose first ``length`` bytes start elsewhere too.

    ``nodes`` has the distinct texts with ``same``, ``ref``, ``copies`` and ``runs``.
    """
    weight = F.least("copies", F.lit(2)).cast("int").alias("weight")
    runs = nodes.select("node", weight, F.explode("runs").alias("r")).select("node", "weight", "r.*")
    twice = materialize(runs.groupBy("anchor").agg(F.sum("weight").alias("under")).where("under > 1").select("anchor"), "twice")
    shared = materialize(runs.join(twice, "anchor"), "shared")
    hulls, anchors = _counted(shared, "anchor", "node", "start", "n", "at")
    needed = materialize(hulls.join(anchors.where("rarest = 1").select("anchor"), "anchor").select("home.*", F.least("found", F.lit(2)).cast("int").alias("weight")), "needed")
    out = materialize(shared.where("weight = 1").join(hulls.where("found > 1").select("anchor", "hull"), ["anchor", "hull"]).select("node", "start", "n"), "repeated")
    free(twice, shared, hulls, anchors)

    places = needed.groupBy("node").agg(F.collect_list(F.struct("start", "n", "at", "weight")).alias("needed")).join(nodes.select("node", "same", "ref"), "node")
    texts = own.withColumn("ref", reference("doc_id")).join(places, ["same", "ref"]).dropDuplicates(["same", "ref"]).select("node", "text", "needed")
    stretches = materialize(_stretches(texts, length).withColumn("rid", F.monotonically_increasing_id()), "stretches")
    free(needed)

    whole = F.array(F.struct((F.col("at") - F.col("start") - F.col("n") + 1).alias("lo"), (F.col("at") - F.col("start")).alias("hi"), "weight"))
    state = stretches.select("rid", "node", "start", "at", "data", whole.alias("open"))
    for width in WIDTHS:
        blocks = materialize(_blocks(state, width, length), "blocks")
        hulls, cores = _counted(blocks, "core", "rid", "lo")
        facts = materialize(hulls.join(cores, "core"), "facts")
        judged = materialize(blocks.join(facts, ["core", "hull"]).drop("core", "hull"), "judged")
        free(blocks, hulls, cores, facts)
        found = judged.where("weight = 1 and found > 1").select("node", (F.col("at") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("n"))
        out = out.unionByName(found)
        on = judged.where("rarest = 1 and (found = 1 or (home.rid = rid and home.lo = lo))")
        lists = on.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", F.least("found", F.lit(2)).cast("int").alias("weight"))).alias("open"))
        state = stretches.join(lists, "rid").select("rid", "node", "start", "at", "data", "open")
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from every text, as UTF-8 bytes, what lies in a string of ``length`` bytes that starts elsewhere too.

    Elsewhere is any other place, in the same text as well; strings are judged on the
    texts as given.  One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256``.

    The suffixes of all texts are parted into intervals of common prefixes, which are
    refined in rounds, and an interval holds suffixes of all shards.  Every suffix has
    an anchor, a string of half the ``length`` within its first ``length`` bytes, that is
    chosen by content (``window_runs``), so the refinement starts from the intervals of
    anchors.  Suffixes that stand before one anchor move together, as a row of the
    table, until they part.  A row leaves the table when it is alone (what its suffixes
    have in common is found once) or settled (all it covers is found twice), and once
    every row of its interval is settled.  What remains is cut into smaller blocks
    (``WIDTHS``), whose intervals are extended by what precedes and follows the anchor.
    Rounds exchange the intervals' names; a name is a digest of 128 bits, and only equal
    bytes have equal names.

    All counts are sums by name with partial sums before the shuffle; of equal rows one
    goes on.  Joins give the counts back by name; both sides are tables and the result is
    written at once, so that adaptive execution may split a name with very many rows.

    Null and empty texts, and those shorter than ``length``, keep all.  A repeated text
    of that length or longer loses all.  Rows with a null id are judged and counted as
    any other, and keep it.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 250)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("same", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    groups = _profiles(own, length).groupBy("same").agg(F.min("doc_id").alias("ref"), F.count("*").alias("copies"), F.first("runs").alias("runs"))
    nodes = materialize(groups.withColumn("ref", reference("ref")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spans = repeated_windows(nodes, own, length).groupBy("node").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    marks = materialize(nodes.select("node", "same", "copies").join(spans, "node", "left").where("copies > 1 or spans is not null").drop("node"), "marks")
    free(nodes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copies, runs in zip(*(batch.column(c) for c in ("text", "copies", "spans")), strict=True):
                data, kept, at = text.as_py().encode(), hashlib.sha256(), 0
                if (copies.as_py() or 1) > 1:
                    gone = [(0, len(data))]
                elif runs.is_valid:
                    gone = covered_spans(*(x.to_numpy() for x in runs.values.flatten()), length)
                else:
                    gone = []
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return own.join(marks, "same", "left").select("doc_id", "text", "copies", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
