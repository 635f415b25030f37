"""Best-fit packing of tokenised documents into sequences, improved by swaps."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import materialize

#: Rows numbered by one sort when places among pieces of one length are dealt.
RANK_ROWS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies in JSON write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def encoder(path: str):
    """A function from texts to id lists for a ``tokenizers`` file.

    Where the file is plain byte-level BPE whose merges have ids in their order, the
    same ids come several times faster from ranks of byte strings; else the file's
    own tokenizer runs.  Strings of special tokens in a text get their ids, as the library
    gives them.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges") or []]
    vocab, letters = model.get("vocab") or {}, byte_letters()
    added = spec.get("added_tokens") or []
    special = {t["content"]: t["id"] for t in added}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges", "byte_fallback"))
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if plain:
        import public_tokenizers
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [fast.encode(t, allowed_special="all") if any(x in t for x in special) else fast.encode_ordinary(t) for t in texts]
    own = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, and before them one of the rest."""
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, min(size if s or not first else first, n - s)) for s in starts]


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of every document: its ids and ``end_id``, cut where they pass ``size``.  A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                data = np.array([*ids, end_id], "<u4")
                out += [(doc_id, i, s, n, zlib.crc32(data[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(data), size))]
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class _Spaces:
    """Groups of bins by their free space."""

    def __init__(self):
        self.groups: dict[int, dict[tuple[int, ...], None]] = {}
        self.spaces: list[int] = []

    def add(self, space: int, items: tuple[int, ...]) -> None:
        if space not in self.groups:
            self.groups[space] = {}
            insort(self.spaces, space)
        self.groups[space][items] = None

    def drop(self, space: int, items: tuple[int, ...]) -> None:
        del self.groups[space][items]
        if not self.groups[space]:
            del self.groups[space]
            del self.spaces[bisect_left(self.spaces, space)]

    def tightest(self, length: int) -> tuple[int, ...] | None:
        """A group with the least space that ``length`` fits into."""
        k = bisect_left(self.spaces, length)
        return next(reversed(self.groups[self.spaces[k]])) if k < len(self.spaces) else None


class Bins:
    """Groups of equal bins: a bin's lengths, longest first, and how many bins there are.

    Underfull groups are indexed by their space and by each length they hold (0 for
    all), and ``most`` has the largest space beside each length.
    """

    def __init__(self, size: int):
        self.size, self.exchanges = size, 0
        self.groups: dict[tuple[int, ...], int] = {}
        self.holding: dict[int, _Spaces] = {}
        self.most = np.full(size + 1, -1, np.int64)

    def add(self, items: tuple[int, ...], n: int) -> None:
        if not n or not items:
            return
        self.groups[items] = self.groups.get(items, 0) + n
        space = self.size - sum(items)
        if space and self.groups[items] == n:
            for length in {0, *items}:
                self.holding.setdefault(length, _Spaces()).add(space, items)
                self.most[length] = self.holding[length].spaces[-1]

    def take(self, items: tuple[int, ...], n: int) -> None:
        self.groups[items] -= n
        if not self.groups[items]:
            del self.groups[items]
            space = self.size - sum(items)
            for length in {0, *items} if space else ():
                held = self.holding[length]
                held.drop(space, items)
                self.most[length] = held.spaces[-1] if held.spaces else -1

    def tightest(self, length: int, beside: int = 0) -> tuple[int, ...] | None:
        held = self.holding.get(beside)
        return held and held.tightest(length)

    def count(self) -> int:
        return sum(self.groups.values())

    def least(self) -> int:
        """No packing of these lengths has fewer bins."""
        return -(-sum(sum(i) * n for i, n in self.groups.items()) // self.size)


def best_fit(counts: dict[int, int], size: int, order: Iterable[int] | None = None) -> Bins:
    """Best fit over a histogram of lengths in the given order (else the longest first): equal bins are filled together."""
    bins = Bins(size)
    for length in order or sorted(counts, reverse=True):
        left = counts[length]
        while left:
            target = bins.tightest(length)
            space = size if target is None else size - sum(target)
            each = min(space // length, left)
            n = left // each if target is None else min(left // each, bins.groups[target])
            if target is not None:
                bins.take(target, n)
            bins.add(tuple(sorted((target or ()) + (length,) * each, reverse=True)), n)
            left -= n * each
    return bins


def _swap(items: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    rest = Counter(items)
    rest.subtract(out)
    rest.update(into)
    return tuple(sorted(rest.elements(), reverse=True))


def _exchange(bins: Bins, source: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
    """The best exchange of ``source`` with another underfull bin: which, what goes there, and what comes back (0: nothing).

    One or two documents go and one or none comes back, such that the other bin gains
    and ends fuller than ``source`` was, which makes the sum of squared fills grow.
    """
    fill, best, found = sum(source), 0, None
    pairs = {a + b: (a, b) for i, a in enumerate(source) for b in source[i + 1 :]}
    for total, gone in sorted(({a: (a,) for a in source} | pairs).items(), reverse=True):
        back = np.arange(min(total, bins.size))
        for b in np.flatnonzero(bins.most[: len(back)] >= total - back)[:4].tolist():  # what gains most; fuller bins may come later
            other = bins.tightest(total - b, b)
            worth = (total - b) * (sum(other) + total - b - fill)
            if worth > best:
                best, found = worth, (other, gone, b)
    return found


def local_search(bins: Bins) -> Bins:
    """Empty bins by exchanges between underfull ones, until none is left that helps or no fewer bins are possible.

    Bins give from the least filled on: a document moves to another bin, or is exchanged
    for one, or two for one (``_exchange``).  Equal bins do so together.  Each exchange
    raises the sum of squared fills, so the search ends; a bin without documents is gone.
    """
    least, count = bins.least(), bins.count()
    changed = True
    while changed and count > least:
        changed = False
        for source in [x for s in reversed(bins.holding[0].spaces) for x in bins.holding[0].groups[s]] if 0 in bins.holding else []:
            while source in bins.groups and count > least:
                bins.take(source, 1)
                found = _exchange(bins, source)
                bins.add(source, 1)
                if not found:
                    break
                other, gone, b = found
                n = 1 if other == source else min(bins.groups[source], bins.groups[other])
                back = (b,) if b else ()
                bins.take(source, n)
                bins.take(other, n)
                rest = _swap(source, gone, back)
                bins.add(rest, n)
                bins.add(_swap(other, back, gone), n)
                bins.exchanges += n
                changed = True
                if not rest:
                    count -= n
                elif source not in bins.groups:
                    source = rest
    return bins


def pack_lengths(counts: dict[int, int], size: int) -> Bins:
    """Bins for a histogram of lengths: swaps from best fit over unsorted lengths, and, where that leaves more than the least, from sorted ones too."""
    scrambled = sorted(counts, key=lambda n: n * 0x9E3779B1 % (1 << 32))
    bins = local_search(best_fit(counts, size, scrambled))
    if bins.count() > bins.least():
        bins = min(local_search(best_fit(counts, size)), bins, key=Bins.count)
    return bins


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document, ended by ``end_id``, into sequences of at most ``size`` tokens.

    Only documents longer than ``size`` are cut (see ``token_pieces``).  What is packed
    is the histogram of piece lengths, at most ``size`` rows, so the driver's work does
    not grow with the corpus and yet the packing is one for all of it: best fit over
    lengths in no order starts it, and ``local_search`` exchanges pieces between underfull bins.
    The k-th piece of a length takes the k-th place of that length.  Places are counted
    in groups of about ``RANK_ROWS`` rows with offsets, so a length that a third of all
    pieces have is no single task.

    Null and empty texts are documents of the end token alone; repeated rows are packed
    each on their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, size, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    bins = pack_lengths(counts, size)

    places: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    dealt = Counter()
    sequence = 0
    for items, n in bins.groups.items():
        offset = 0
        for length in items:
            places[length].append((dealt[length], sequence, offset))
            dealt[length] += n
            offset += length
        sequence += n
    assert dealt == Counter(counts)
    rows = [(length, *p) for length in sorted(places) for p in places[length]]
    # (length, rank) as one number, by which a piece finds its group of bins
    firsts = np.array([(r[0] << 44) + r[1] for r in rows] or [0], np.int64)
    sequences, offsets = (np.array([r[i] for r in rows] or [0], np.int64) for i in (2, 3))
    shared = spark.sparkContext.broadcast((firsts, sequences, offsets))  # a few entries for each of `size` lengths

    groups = ",".join(str(-(-counts.get(n, 0) // RANK_ROWS) or 1) for n in range(1, size + 1))
    n_groups = F.element_at(F.expr(f"array({groups})"), F.col("length").cast("int"))
    dealt_out = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_groups).cast("int"))
    sizes = dealt_out.groupBy("length", "group").count()
    before = sizes.select("length", "group", (F.sum("count").over(W.partitionBy("length").orderBy("group")) - F.col("count")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt_out.withColumn("within", within).join(before, ["length", "group"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, sequences, offsets = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = (length << 44) + rank
            at = np.searchsorted(firsts, key, "right") - 1
            got = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*got, pa.array(sequences[at] + key - firsts[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"{PIECES}, sequence_id long, offset long")
