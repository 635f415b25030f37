"""Near-duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import few_files, reference, release_memory, slices, small_batches
from tidemark.llm.components import components
from tidemark.llm.words import mix, shingles, words_of
from tidemark.session import discard, materialize

#: 32 bands of 4 registers: two texts at a similarity of 0.8 share none with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Candidates agree in so many registers at least, compared by 4 bits of each: two texts at a
#: similarity of 0.8 agree in fewer with a probability of 5e-5, at 0.85 of 2e-8.
AGREE = 86
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WRAP = (1 << 64) - 1


def bag_minhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Signatures of multisets of hashes, and the distinct hashes with their multiplicities.

    An element of weight w stands for the range (0, w] of a Poisson process with points
    in time; each point belongs to a random register, which keeps its least time.  Two
    registers agree with a probability equal to the weighted Jaccard similarity.  The
    range is parted at powers of two, so weights share the processes of all whole parts,
    and points in the last part count if they lie below w.  Times of a process grow,
    so it is dropped once it passes the largest register of its multiset.
    """
    bags = [np.unique(s, return_counts=True) for s in sets]
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(k) for k, _ in bags], np.int64)
    if not sizes.sum():
        return out, bags
    doc = np.repeat(np.arange(len(sets)), sizes)
    key = np.concatenate([k for k, _ in bags])
    weight = np.concatenate([c for _, c in bags])
    parts = [(doc, key, weight, np.zeros(len(doc), np.int64), np.ones(len(doc)))]
    low = 1
    while (more := weight > low).any():  # the part (low, 2 low]
        doc, key, weight = doc[more], key[more], weight[more]
        parts.append((doc, mix(key + np.uint64(low * int(GOLDEN) & _WRAP)), weight, np.full(len(doc), low), np.full(len(doc), float(low))))
        low *= 2
    doc, state, weight, base, rate = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    flat = out.reshape(-1)
    largest = np.full(len(sets), np.inf)
    one = 1.0 / (1 << 53)
    while len(doc):
        state = state + GOLDEN
        bits = mix(state)
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * one) / rate
        live = time < largest[doc]
        doc, state, weight, base, rate, time, bits = (x[live] for x in (doc, state, weight, base, rate, time, bits))
        more = mix(bits ^ GOLDEN)
        register = (more % np.uint64(m)).astype(np.int64)
        within = base == 0
        if not within.all():
            place = base + 1 + ((more >> np.uint64(32)).astype(np.float64) / (1 << 32) * base).astype(np.int64)
            within = within | (place <= weight)
        cell = doc[within] * m + register[within]
        np.minimum.at(flat, cell, time[within])
        largest = out.max(axis=1)
    return out, bags


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band is part of the key."""
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), bits.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * GOLDEN + bits[:, :, r])
    return keys.view(np.int64)


def packed_registers(signatures: np.ndarray) -> np.ndarray:
    """4 bits of each register of each signature: a word holds one of the bits of 64 registers."""
    bits = mix(signatures.view(np.uint64)).reshape(len(signatures), -1, 64)
    at = np.arange(64, dtype=np.uint64)
    words = [np.bitwise_or.reduce((bits >> np.uint64(63 - j) & np.uint64(1)) << at, axis=2) for j in range(4)]
    return np.stack(words, axis=2).reshape(len(signatures), -1).view(np.int64)


def _agreeing(a: str, b: str) -> Column:
    """In how many registers the packed columns ``a`` and ``b`` agree."""
    differing = F.lit(0)
    for i in range(0, BANDS * ROWS // 16, 4):
        x = [F.get(a, F.lit(i + j)).bitwiseXOR(F.get(b, F.lit(i + j))) for j in range(4)]
        differing += F.bit_count(x[0].bitwiseOR(x[1]).bitwiseOR(x[2]).bitwiseOR(x[3]))
    return F.lit(BANDS * ROWS) - differing


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """For every text the hash of its bytes, the keys of its bands and its packed registers (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            sets = shingles(words_of(batch.column("text")), k)
            signatures = bag_minhash(sets)[0]
            listed = [pa.array([list(x) if len(s) else None for x, s in zip(rows, sets, strict=True)], pa.list_(pa.int64())) for rows in (band_keys(signatures), packed_registers(signatures))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), *listed], names=["doc_id", "same", "bands", "registers"])

    return docs.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("same"), "text").mapInArrow(run, "doc_id long, same binary, bands array<bigint>, registers array<bigint>")


def _bags(texts: DataFrame, k: int) -> DataFrame:
    """Sorted distinct shingle hashes of each node, and their multiplicities, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            bags = [np.unique(s, return_counts=True) for s in shingles(words_of(batch.column("text")), k)]
            cols = [pa.array([h.tobytes() for h, _ in bags], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in bags], pa.binary()), pa.array([int(c.sum()) for _, c in bags], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *cols], names=["node", "hashes", "counts", "size"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary, counts binary, size long")


def _shared_weight(bags: DataFrame) -> DataFrame:
    """``size`` of each node's multiset and ``shared``, the part of it in shingles that another node has too.

    Two nodes have no more than the lesser ``shared`` in common, which bounds their similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one batch out for each in: many small ones cost the JVM memory outside its heap
            hashes = [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column("hashes")]
            counts = [np.frombuffer(c.as_buffer(), np.uint32) for c in batch.column("counts")]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts).astype(np.int64))], names=["node", "hash", "n"])
            del hashes, counts, nodes
            release_memory()

    entries = bags.select("node", "hashes", "counts").mapInArrow(run, "node long, hash long, n long")
    alone = entries.groupBy("hash").agg(F.count("*").alias("nodes"), F.min("node").alias("node"), F.sum("n").alias("n")).where("nodes = 1")
    own = alone.groupBy("node").agg(F.sum("n").alias("own"))
    return bags.select("node", "size").join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum()) + int(b[1].sum()) - least
    return least / most if most else 0.0


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose multisets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, g, d = (batch.column(x).to_pylist() for x in ("hashes", "counts", "hashes2", "counts2"))
            bag = lambda x, y: (np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32))
            keep = pa.array([weighted_jaccard(bag(h[i], c[i]), bag(g[i], d[i])) >= similarity for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)
            release_memory()

    other = bags.select(F.col("node").alias("v"), F.col("hashes").alias("hashes2"), F.col("counts").alias("counts2"))
    both = pairs.join(bags.drop("size").withColumnRenamed("node", "u"), "u").join(other, "v")
    return both.select("u", "v", "hashes", "counts", "hashes2", "counts2").mapInArrow(run, "u long, v long")


def _classes(docs: DataFrame, similarity: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``near_duplicates`` gives, and ``least_same``, the least hash of a text of the class.

    Two texts are linked if the multisets of their ``k``-word shingles have a weighted
    Jaccard similarity of at least ``similarity``; classes are the components of links.

    Equal texts become one node first.  Nodes that share a band of their BagMinHash
    signatures meet in a bucket.  What a node shares with any other at all bounds its
    similarity to each (``_shared_weight``): nodes and pairs whose bound is too low are
    done.  In each round the first few nodes of a bucket are compared with its others,
    unless one class holds both already, and then leave the bucket; the number grows
    eightfold by round.  Nodes that share most come first, as the text does that others
    are edited from, so a bucket of any size is one class after a few comparisons for
    each node; yet every pair in it is compared, or bounded, or known to be of one
    class.  A pair is met in the first of its common bands only, if
    it agrees in ``AGREE`` registers at least.  Comparison is exact, on multisets of 64-bit
    shingle hashes.

    """
    small_batches(docs.sparkSession, 250)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(_signed(own, k), "signed")
    groups = signed.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("copy_id"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    nodes = materialize(few_files(groups.withColumn("node", F.monotonically_increasing_id())), "nodes")

    entries = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = materialize(few_files(entries.join(shared, "key").select("key", "node")), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "same", reference("copy_id").alias("ref"))
    texts = own.where("text is not null").withColumn("same", F.unhex(F.md5(F.encode("text", "UTF-8")))).withColumn("ref", reference("doc_id")).join(wanted, ["ref", "same"]).dropDuplicates(["ref", "same"])
    bags = materialize(_bags(texts, k), "bags")

    weights = materialize(few_files(_shared_weight(bags)), "weights")
    least = similarity / (1 + similarity)  # of both sizes together must be in common
    signatures = nodes.select("node", "bands", "registers")
    linkable = weights.where(F.col("shared") >= similarity * F.col("size") - 1e-9).join(signatures, "node")
    start = materialize(few_files(buckets.join(linkable, "node")), "buckets")
    discard(buckets, weights)
    buckets = start

    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    edges = None
    width = 1
    columns = ["key", "node", "size", "shared", "bands", "registers"]
    while True:
        labelled = buckets.join(labels, "node", "left").select(*columns, F.coalesce("label", "node").alias("label"))
        open_keys = materialize(few_files(labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")), "keys")
        left = materialize(few_files(labelled.join(open_keys, "key").select(*columns, "label")), "buckets")
        discard(buckets, open_keys)
        order = W.partitionBy("key").orderBy(F.desc(F.col("shared") / F.col("size")), "node")
        # each task sends no more than ``width`` nodes of a bucket on to the window
        first = materialize(few_files(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)), "hubs")
        placed = materialize(few_files(left.join(first.select("key", "node", "place"), ["key", "node"], "left")), "buckets")
        discard(left)
        hubs = first.select(*[F.col(c).alias(f"{c}2") for c in (*columns, "label", "place")])
        enough = F.least("shared", "shared2") >= least * (F.col("size") + F.col("size2")) - 1e-9
        here = F.get(F.array_intersect("bands", "bands2"), F.lit(0)) == F.col("key")
        behind = F.expr("place is null or place > place2")
        met = placed.join(hubs, (F.col("key") == F.col("key2")) & behind & (F.col("label") != F.col("label2")) & enough & (_agreeing("registers", "registers2") >= AGREE) & here)
        pairs = met.select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct()
        found = materialize(few_files(_verified(pairs, bags, similarity)), "links")
        buckets = materialize(few_files(placed.where("place is null").select(*columns)), "buckets")
        discard(placed, first)
        edges = found if edges is None else edges.unionByName(found)
        if not found.isEmpty():
            labels = materialize(few_files(components(edges)), "labels")
        if buckets.isEmpty():
            break
        width *= 8
    discard(buckets, bags)
    member = nodes.join(labels, "node", "left").select("same", "copy_id", F.coalesce("label", "node").alias("label"))
    # both sides of each join are tables, so that adaptive execution may split a large class or a text with many copies
    classes = materialize(few_files(member.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("same").alias("least_same"))), "classes")
    by_text = materialize(few_files(member.join(classes, "label").select("same", "copy_id", "class_id", "least_same")), "members")
    out = signed.select("doc_id", "same").join(by_text, "same", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), "same", "least_same")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` (least id of the class), ``copy_id`` (least id with the same text) and ``same`` for every row.

    See ``_classes`` for how they are found.  A text of fewer words is one shingle.  Texts
    without words are linked to equal ones only, null texts to none.  Rows with one id
    stand for themselves by their texts.  Rows with a null id are linked as any other, but
    name a class or text only where none of its rows has an id; then ``class_id`` or
    ``copy_id`` is null.  An empty table gives no rows.
    """
    return _classes(docs, similarity, k, id_col, text_col).drop("least_same")


def keep_one(docs: DataFrame, similarity: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the least id of each class, and once where it is repeated.

    Of a class without ids the text of the least hash is kept.  Null texts are no copies
    and all stay, whatever their id.
    """
    near = materialize(_classes(docs, similarity, k, id_col, text_col), "near")  # a join by text alone, which may be split
    first = F.when(F.col("same").isNull(), True).when(F.col("class_id").isNull(), F.col("same") == F.col("least_same")).otherwise(F.expr("doc_id = class_id and doc_id = copy_id"))
    kept = near.where(first).select(reference("doc_id").alias("id"), "same").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.unhex(F.md5(F.encode(text_col, "UTF-8"))).alias("same2"))
    joined = rows.join(kept, "id").where(F.col("same").eqNullSafe(F.col("same2")))
    apart = F.when(F.col("same").isNull(), F.monotonically_increasing_id())  # null texts are no copies
    return joined.withColumn("apart", apart).dropDuplicates(["id", "same", "apart"]).select("row.*")
