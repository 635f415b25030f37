"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, let, release_memory, small_batches

#: Buckets of the literal rank map; a byte string's bucket is its CRC-32 modulo this.
BUCKETS = 1 << 16
NO_RANK = (1 << 31) - 1
#: Longer words are merged with a heap in the Arrow stage: the fold takes time with the square of the length.
FOLD_BYTES = 48
#: Characters of text whose words get one list.
CHUNK_CHARS = 32 << 20
#: Parts by hash of each list; words of one part come together from all lists.
DEALS = 1 << 12
#: Distinct words that make one row for the fold, at least; four times as many at most.
ROW_WORDS = 1 << 16

INTS = "array<int>"


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of buckets with a few (bytes, rank) entries each.

    A map literal would be searched from its start at each lookup; this one is indexed.
    """
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token) % BUCKETS].append({"k": base64.b64encode(token).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k:binary,r:int>>>")


def _encoder(table: Column) -> Callable[[Column], Column]:
    """A function from a column of one word's bytes to its ids."""

    def rank(key: Column) -> Column:
        bucket = F.get(table, F.crc32(key).bitwiseAND(BUCKETS - 1).cast("int"))
        return F.coalesce(F.get(F.filter(bucket, lambda e: e["k"] == key), F.lit(0))["r"], F.lit(NO_RANK))

    def part(data: Column, with_next: Column) -> Column:
        return F.struct(data.alias("part"), with_next.alias("rank"))

    def step(parts: Column) -> Column:
        """Merge the first of the adjacent pairs with the least rank; the ranks before and at it change.

        A null part before the first and the end of the array have no rank with a neighbour.
        """

        def at(p: Column) -> Column:  # the place of the pair, from 1
            def put(merged: Column) -> Column:
                left = let(F.get(parts, p - 2)["part"], lambda x: part(x, rank(F.concat(x, merged))))
                right = part(merged, rank(F.concat(merged, F.get(parts, p + 1)["part"])))
                return F.concat(F.slice(parts, F.lit(1), p - 2), F.array(left, right), F.slice(parts, p + 2, F.lit(2 * FOLD_BYTES)))

            pair = F.concat(F.get(parts, p - 1)["part"], F.get(parts, p)["part"])
            return F.when(F.get(parts, p - 1)["rank"] == NO_RANK, parts).otherwise(let(pair, put))

        return let(F.array_position(parts["rank"], F.array_min(parts["rank"])).cast("int"), at)

    def fold(word: Column) -> Column:
        def folded(n: Column) -> Column:
            byte = lambda i: F.substring(word, i, F.lit(1))
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: part(byte(i), rank(F.substring(word, i, F.lit(2)))))
            first = F.concat(F.array(part(F.lit(None).cast("binary"), F.lit(NO_RANK))), pairs, F.array(part(byte(n), F.lit(NO_RANK))))
            return F.aggregate(F.sequence(F.lit(2), n), first, lambda s, _: step(s), lambda s: F.transform(F.slice(s["part"], F.lit(2), F.lit(2 * FOLD_BYTES)), rank))

        return let(F.octet_length(word), folded)

    def encode(word: Column) -> Column:
        whole = lambda r: F.when(r != NO_RANK, F.array(r)).when(F.octet_length(word) < 2, F.array().cast(INTS)).otherwise(fold(word))
        return let(rank(word), whole)

    return encode


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word in an array of binaries; an empty word has none."""
    return let(rank_map(ranks), lambda table: F.transform(words, _encoder(table)))


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts there
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    alive = [True] * n
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Indexed(dict):
    """Word -> index in the order of first asking."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).astype(np.int32), offsets.astype(np.int64)


def _gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Concatenation of the given rows of a ragged array."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(offsets[rows] - ends + sizes, sizes)]


def _packed(numbers: np.ndarray) -> list[bytes]:
    """Integers as compressed planes of their bytes; planes of small numbers take little."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4)
    return [zstandard.compress(planes[:, i].tobytes(), 1) for i in range(4)]


def _unpacked(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes], axis=1).reshape(-1).view("<i4")


def _lists(texts: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row per chunk of text: its documents' words as places in a list of distinct words, and the list in parts by hash.

    The list has the words part by part, and at its end the long ones, whose ids stand
    beside.  Documents refer to words by frequency, and ``places`` tells where those are in the list.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = regex.compile(pattern).findall, read_ranks(ranks_path)
        part = TaskContext.get().partitionId()
        made = 0

        def row(index: _Indexed, ids: list, refs: list[np.ndarray]) -> pa.RecordBatch:
            words = [w.encode() for w in index]
            deal = np.fromiter((zlib.crc32(w) % DEALS if len(w) <= FOLD_BYTES else DEALS for w in words), np.int32, len(words))
            order = np.argsort(deal, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            words, deal = [words[i] for i in order.tolist()], deal[order]
            bounds = np.searchsorted(deal, np.arange(DEALS + 1)).tolist()
            deals = [
                {"deal": d, "sizes": bytes(map(len, words[a:b])), "data": b"".join(words[a:b])}
                for d, (a, b) in enumerate(pairwise(bounds))
                if a < b
            ]
            every = np.concatenate([*refs, place[:0]])
            frequent = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[frequent] = np.arange(len(words), dtype=np.int32)
            long = [merge_with_heap(w, ranks) for w in words[bounds[-1] :]]
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([part << 32 | made], pa.int64()),
                    "doc_id": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(r) for r in refs]], pa.list_(pa.int32())),
                    "refs": pa.array([_packed(rank[every])], pa.list_(pa.binary())),
                    "places": pa.array([_packed(place[frequent])], pa.list_(pa.binary())),
                    "long": pa.array([long], pa.list_(pa.list_(pa.int32()))),
                    "deals": pa.array([deals], pa.list_(pa.struct([("deal", pa.int32()), ("sizes", pa.binary()), ("data", pa.binary())]))),
                }
            )

        index, ids, refs, held = _Indexed(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                refs.append(np.fromiter(map(index.__getitem__, find(text)), np.int32))
                ids.append(doc_id)
                held += len(text)
                if held >= CHUNK_CHARS:
                    yield row(index, ids, refs)
                    index, ids, refs, held, made = _Indexed(), [], [], 0, made + 1
                    release_memory()
        if ids:
            yield row(index, ids, refs)

    return texts.mapInArrow(split, "chunk long, doc_id array<bigint>, sizes array<int>, refs array<binary>, places array<binary>, long array<array<int>>, deals array<struct<deal:int,sizes:binary,data:binary>>")


def _folded(lists: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Ids of the words in each part of each chunk's list; every word of the corpus is folded once."""
    width = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, asked, last = _Indexed(), [], None

        def row() -> pa.RecordBatch:
            chunk, deal, refs = zip(*asked, strict=True)
            cols = [pa.array([list(index)], pa.list_(pa.binary())), pa.array([chunk], pa.list_(pa.int64())), pa.array([deal], pa.list_(pa.int32())), pa.array([refs], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["words", "chunk", "deal", "refs"])

        for batch in batches:
            for chunk, deal, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "deal", "sizes", "data")), strict=True):
                if len(index) >= (ROW_WORDS if deal != last else 4 * ROW_WORDS):
                    yield row()
                    index, asked = _Indexed(), []
                last = deal
                ends = accumulate(sizes, initial=0)
                asked.append((chunk, deal, np.fromiter((index[data[a:b]] for a, b in pairwise(ends)), np.int32, len(sizes)).tobytes()))
        if asked:
            yield row()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat, offsets = _flat(batch.column("ids").slice(k, 1).flatten())
                rows = [np.frombuffer(r.as_buffer(), np.int32) for r in batch.column("refs")[k].values]
                counts = np.diff(offsets).astype(np.uint8)
                cols = [pa.array([counts[r].tobytes() for r in rows], pa.binary()), pa.array([_gather(flat, offsets, r).astype(width).tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("chunk")[k].values, batch.column("deal")[k].values, *cols], names=["chunk", "deal", "counts", "ids"])
            release_memory()

    asked = lists.select("chunk", F.explode("deals").alias("d")).select("chunk", "d.*").repartition("deal").sortWithinPartitions("deal")
    rows = asked.mapInArrow(gather, "words array<binary>, chunk array<bigint>, deal array<int>, refs array<binary>")
    return rows.select(encode_words(F.col("words"), ranks).alias("ids"), "chunk", "deal", "refs").mapInArrow(give, "chunk long, deal int, counts binary, ids binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, without special tokens; with ``digests`` counts and hashes in their place.

    Texts are cut into words by ``pattern``, and each ``CHUNK_CHARS`` of text become a
    list of distinct words and the places of its documents' words in it.  Parts of the
    lists by a hash of the word come together, and the merges are folded over the
    distinct words of the corpus with higher-order functions and a literal rank map.
    The ids go back to the chunks that asked, which are a bucketed table and don't move,
    and are put in the order of the words.  A part of a list is one packed row, so a word that is everywhere is a row
    for each chunk.  Words over ``FOLD_BYTES`` are merged with a heap.

    A null text is as an empty one: no ids.  Repeated rows give repeated rows, and an
    empty table gives none.
    """
    ranks = read_ranks(ranks_path)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lists = bucketed(_lists(texts, ranks_path, pattern), "lists", "chunk")
    width = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])
        table = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        bounds = np.zeros(pieces[-1][1] + 2, np.int64)
        bounds[np.array([r for _, r in pieces]) + 1] = [len(p) for p, _ in pieces]
        bounds = np.cumsum(bounds)
        for batch in batches:
            for k in range(batch.num_rows):
                parts = sorted(batch.column("parts")[k].as_py() or [], key=lambda p: p["deal"])
                late = batch.column("long")[k].as_py()
                flat = np.frombuffer(b"".join(p["ids"] for p in parts), width).astype(np.int32)
                flat = np.concatenate([flat, np.array([x for i in late for x in i], np.int32)])
                counts = np.concatenate([np.frombuffer(b"".join(p["counts"] for p in parts), np.uint8).astype(np.int64), np.array([len(i) for i in late], np.int64)])
                every = np.concatenate([[0], np.cumsum(counts)])
                refs = _unpacked(batch.column("places")[k].as_py())[_unpacked(batch.column("refs")[k].as_py())]
                del parts, counts
                out, at = [], 0
                for n in batch.column("sizes")[k].as_py():
                    ids = _gather(flat, every, refs[at : at + n])
                    at += n
                    if digests:
                        decoded = _gather(table, bounds, ids)
                        out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()))
                    else:
                        out.append(ids)
                doc_ids = batch.column("doc_id")[k].values
                if digests:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])
            release_memory()

    parts = _folded(lists, ranks).groupBy("chunk").agg(F.collect_list(F.struct("deal", "counts", "ids")).alias("parts"))  # of one chunk
    whole = lists.drop("deals").join(parts.hint("merge"), "chunk", "left")
    return whole.mapInArrow(join, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every row's ids: the binary pieces of the ids, concatenated.  Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {r: p for p, r in read_ranks(ranks_path).items()}
        for batch in batches:
            data = [b"".join(map(pieces.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, data binary")
