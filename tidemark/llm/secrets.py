"""Secrets in plain text and under nested encodings."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the greedy run either has 16 characters or fails
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A quoted string of bytes: URL quoting leaves letters, digits and some marks bare.
QUOTED = re.compile(r"(?<![!-$&-~])[!-$&-~]*+(?:%[0-9A-Fa-f]{2}[!-$&-~]*+)++")
#: Full-width forms of ASCII, and characters without width.
WIDE = re.compile("[%c-%c]|[%c-%c%c%c%c]" % (0xFF01, 0xFF5E, 0x200B, 0x200D, 0x2060, 0xFEFF, 0xAD))
ESCAPES = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|quot|apos|lt|gt|equals|colon);|" + WIDE.pattern)
ESCAPE_HINTS = ("\\u", "\\U", "\\x", "%u", "&#", "&amp;", "&quot;", "&apos;", "&lt;", "&gt;", "&equals;", "&colon;")
UNKNOWN = chr(0xFFFD)
#: What bytes that aren't UTF-8 are decoded to at first.
BAD = re.compile("[%c-%c]" % (0xDC80, 0xDCFF))
#: 16 letters or more without a break, or letters that go on over line breaks.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++|(?<=[A-Za-z0-9+/_-]{16}))={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
STANDARD = str.maketrans("-_", "+/")
#: The shortest finding is ``token=`` with 8 characters; decoding makes no text longer.
LEAST = 14
#: Unpacked bytes that are scanned as one text, at most, and how far the next ones overlap them: a finding in a
#: longer stream, or a layer nested in it, is seen whole if it is no longer than the overlap.
WINDOW, OVERLAP = 16 << 20, 4 << 20
#: First bytes of gzip, zlib, zstd, bzip2 and xz streams.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\x00")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind:string,start:long,end:long,depth:int>>"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    + [("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])))]
)


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, those too short dropped after they are consumed."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text, with the span of the original text that each of its characters came from.

    ``part`` says that the text may be cut off at its ends: it is a line of a longer stretch.
    """

    __slots__ = ("depth", "ends", "part", "starts", "text")

    def __init__(self, text: str, starts, ends, depth: int, part: bool = False):
        self.text, self.starts, self.ends, self.depth, self.part = text, starts, ends, depth, part

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts[start], self.ends[end - 1]) if start < end else (0, 0)


def _pieces(data: memoryview) -> Iterator[tuple[bytes, int]]:
    """Contents of the stream that ``data`` starts with, in pieces of ``WINDOW`` bytes at most, and where in ``data`` it ends (0 until then, -1 if it is cut off)."""
    if data[:1] == b"\x28":
        if zstandard.frame_content_size(data) > WINDOW:  # its end isn't told by a reader of pieces
            with zstandard.ZstdDecompressor().stream_reader(data) as reader:
                while raw := reader.read(WINDOW):
                    yield raw, 0
            yield b"", -1
            return
        decoder = zstandard.ZstdDecompressor().decompressobj()
        yield decoder.decompress(data), 0
    elif data[:1] in (b"\x1f", b"x"):
        decoder = zlib.decompressobj(47 if data[:1] == b"\x1f" else 15)
        raw = decoder.decompress(data, WINDOW)
        while raw:
            yield raw, 0
            raw = b"" if decoder.eof else decoder.decompress(decoder.unconsumed_tail, WINDOW)
    else:
        decoder = bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor()
        raw = decoder.decompress(data, WINDOW)
        while raw:
            yield raw, 0
            raw = b"" if decoder.eof or decoder.needs_input else decoder.decompress(b"", WINDOW)
    yield b"", len(data) - len(decoder.unused_data) if decoder.eof else -1


def _contents(data: memoryview, ends: list[int]) -> Iterator[bytes]:
    """Contents of a stream and of gzip members that follow it, in pieces; ``ends`` gets where each whole one ends."""
    start, some = 0, False
    try:
        while start < len(data) and (not some or data[:3] == b"\x1f\x8b\x08" == data[start : start + 3]):
            for raw, stop in _pieces(data[start:]):
                if raw:
                    some = True
                    yield raw
            if stop < 0:
                return
            start += stop
            ends.append(start)
    except (zlib.error, zstandard.ZstdError, OSError, ValueError, EOFError, lzma.LZMAError):
        return


def _streams(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and contents of every gzip, zlib, zstd, bzip2 or xz stream in ``data``, also where it is cut off.

    Contents over ``WINDOW`` bytes come in pieces that overlap, so memory is bounded
    whatever a stream unpacks to; such a stream is unpacked once more to find its end.
    """
    view, at = memoryview(data), 0
    while m := MAGIC.search(data, at):
        at = m.start() + 1
        ends: list[int] = []
        pieces = _contents(view[m.start() :], ends)
        head, size = [], 0
        for raw in pieces:
            head.append(raw)
            size += len(raw)
            if size > WINDOW:
                break
        if not size:
            continue
        for _ in pieces:  # only where there is more
            pass
        stop = m.start() + ends[-1] if ends else len(data)
        at = stop if ends else at
        if size <= WINDOW:
            yield m.start(), stop, b"".join(head)
            continue
        del head
        kept = b""
        for raw in _contents(view[m.start() :], []):
            kept += raw
            while len(kept) > WINDOW:
                yield m.start(), stop, kept[:WINDOW]
                kept = kept[WINDOW - OVERLAP :]
        if len(kept) > OVERLAP:
            yield m.start(), stop, kept


def _unpacked(raw: bytes, at: tuple[int, int], layer: Layer, part: bool = False) -> Layer:
    """The text inside a compressed stream; every character maps to the whole stream, as no finer span exists."""
    return Layer(raw.decode("utf-8", "replace"), _Constant(at[0]), _Constant(at[1]), layer.depth + 1, part or layer.part)


class _Constant:
    """A sequence of one value."""

    __slots__ = ("value",)

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, i: int) -> int:
        return self.value


class _Counting:
    """The sequence ``i + shift``."""

    __slots__ = ("shift",)

    def __init__(self, shift: int):
        self.shift = shift

    def __getitem__(self, i: int) -> int:
        return i + self.shift


class _Chosen:
    """The items of a sequence at ``places``."""

    __slots__ = ("places", "sequence")

    def __init__(self, sequence, places: np.ndarray):
        self.sequence, self.places = sequence, places

    def __getitem__(self, i: int) -> int:
        return self.sequence[int(self.places[i])]


def _rewritten(layer: Layer, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """``layer`` with each stretch (start, end) replaced by characters that carry spans within the layer."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for start, end, new in [*pieces, (len(layer.text), len(layer.text), [])]:
        chars.append(layer.text[at:start])
        starts.extend(layer.starts[i] for i in range(at, start))
        ends.extend(layer.ends[i] for i in range(at, start))
        for c, s, e in new:
            chars.append(c)
            starts.append(layer.starts[s])
            ends.append(layer.ends[e - 1])
        at = end
    return Layer("".join(chars), starts, ends, layer.depth + 1, layer.part)


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    for m in QUOTED.finditer(layer.text):
        for quoted in {m[0], m[0].replace("+", "\x20")}:  # forms write a space as +
            data = PERCENT.sub(lambda p: bytes.fromhex(p[0].replace("%", "")).decode("latin-1"), quoted).encode("latin-1")
            if not MAGIC.search(data):
                continue
            sizes = np.array([len(p) for p in re.findall("%[0-9A-Fa-f]{2}|.", quoted)])
            places = m.start() + np.concatenate([[0], np.cumsum(sizes)])
            for start, end, raw in _streams(data):
                yield _unpacked(raw, layer.span(int(places[start]), int(places[end])), layer)
    pieces = []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        text, ends = _characters(data)
        places = [m.start(), *(m.start() + 3 * ends).tolist()]
        pieces.append((m.start(), m.end(), list(zip(text, places, places[1:], strict=False))))
    if pieces:
        yield _rewritten(layer, pieces)


def _unescape(s: str) -> str:
    if s[0] == "&":
        return {"&equals;": "=", "&colon;": ":"}.get(s) or html.unescape(s)
    if len(s) == 1:
        return chr(ord(s) - 0xFEE0) if 0xFF01 <= ord(s) <= 0xFF5E else ""
    if len(s) == 12:
        return bytes.fromhex(s[2:6] + s[8:12]).decode("utf-16-be")
    code = int(s[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else UNKNOWN


def _unicode(layer: Layer) -> Iterator[Layer]:
    if not (any(h in layer.text for h in ESCAPE_HINTS) or WIDE.search(layer.text)):
        return
    pieces = [(m.start(), m.end(), [(c, m.start(), m.end()) for c in _unescape(m[0])]) for m in ESCAPES.finditer(layer.text)]
    if pieces:
        yield _rewritten(layer, pieces)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Stretches of base64 joined over line breaks, and long lines of them alone, from each of their first four letters."""
    for m in BASE64.finditer(layer.text):
        lines = [x.span() for x in LETTERS.finditer(layer.text, *m.span())]
        yield from _decoded(layer, lines, m.end(), False)
        if len(lines) > 1:
            for line in lines:
                if line[1] - line[0] >= 16:
                    yield from _decoded(layer, [line], line[1], True)


def _decoded(layer: Layer, lines: list[tuple[int, int]], stop: int, part: bool) -> Iterator[Layer]:
    """Layers in the base64 letters of ``lines``, whose padding ends at ``stop``; they are scanned whatever they hold."""
    letters = "".join(layer.text[a:b] for a, b in lines).translate(STANDARD)
    if len(letters) < 16:
        return
    places = None
    for shift in range(4):
        body = letters[shift : len(letters) - ((len(letters) - shift) % 4 == 1)]  # without a letter of the text behind it
        data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
        packed = MAGIC.search(data)
        if not packed and len(data) < LEAST:
            continue
        if places is None:
            places = np.concatenate([np.arange(a, b) for a, b in lines])
        for start, end, raw in _streams(data) if packed else ():
            last = stop if end == len(data) else int(places[shift + -(-end * 8 // 6) - 1]) + 1
            yield _unpacked(raw, layer.span(int(places[shift + start * 8 // 6]), last), layer, part)
        if len(data) >= LEAST:
            text, ends = _characters(data)
            starts = np.concatenate([[0], ends[:-1]])
            yield Layer(text, _Chosen(layer.starts, places[shift + starts * 8 // 6]), _Chosen(layer.ends, places[shift - (-ends * 8 // 6) - 1]), layer.depth + 1, part or layer.part)


def _characters(data: bytes) -> tuple[str, np.ndarray]:
    """Text of UTF-8 bytes, each bad byte as one unknown character, and where each character ends in them."""
    if data.isascii():
        return data.decode("ascii"), np.arange(1, len(data) + 1)
    text = data.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = (codes >= 0xDC80) & (codes <= 0xDCFF)
    ends = np.cumsum(np.where(bad, 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
    return BAD.sub(UNKNOWN, text), ends


def _inside(layer: Layer) -> Iterator[Layer]:
    """The layers one step inside a layer."""
    return (x for x in chain(_url(layer), _unicode(layer), _base64(layer)) if x.text and x.text != layer.text)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Findings in the plain text, and all findings with the depth of the layer that shows them.

    A worklist holds layers still to scan.  Each is scanned as a text of its own and
    then unwrapped one step in every way that applies; a layer whose text and place
    were seen before is not entered again, so unwrapping ends.  A finding at an end of
    a line of base64 gives way to one of the joined lines that goes on from it.
    """
    base = find_plain(text)
    depth_of = {f: 0 for f in base}
    cut_off = {}
    work, seen = [iter([Layer(text, _Counting(0), _Counting(1), 0)])], set()
    while work:  # layers are made one at a time
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.depth:
            mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.starts[0], layer.ends[len(layer.text) - 1])
            if mark in seen:
                continue
            seen.add(mark)
            for kind, start, end in find_plain(layer.text):
                at_end = layer.part and (start == 0 or end == len(layer.text))
                (cut_off if at_end else depth_of).setdefault((kind, *layer.span(start, end)), layer.depth)
        work.append(_inside(layer))
    if cut_off:
        reach = {}
        for kind, start, end in depth_of:
            reach[kind, start] = max(end, reach.get((kind, start), 0))
        digits = sorted((start, end) for kind, start, end in depth_of if kind == "hex")
        upto = list(accumulate((end for _, end in digits), max))
        for f, depth in cut_off.items():
            before = bisect(digits, f[1], key=lambda d: d[0]) if f[0] == "hex" else 0
            if max(reach.get(f[:2], 0), upto[before - 1] if before else 0) < f[2]:
                depth_of.setdefault(f, depth)
    order = lambda f: (f[1], KINDS.index(f[0]), f[2])
    return sorted(base, key=order), [(*f, depth_of[f]) for f in sorted(depth_of, key=order)]


def joined(found: list[tuple]) -> str:
    return ",".join(f"{f[0]}:{f[1]}:{f[2]}" for f in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: counts of the plain ones, and all spans in code points of the original.

    One narrow pass without a shuffle.  URL, Unicode, base64 and compressed layers
    are unwrapped again and again (see ``scan``); a finding inside a layer is mapped
    back to the original characters that encode it.  Findings with one kind and span
    count once.  A null text is as an empty one and gives a row without findings;
    repeated rows give repeated rows; an empty table gives none.  A text is held
    whole in one task, together with its layers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, every = scan(text or "")
                kinds = [f[0] for f in base]
                rows.append(
                    {
                        "doc_id": doc_id,
                        **{f"n_{k}": kinds.count(k) for k in KINDS},
                        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                        "spans": joined(every),
                        "findings": [{"kind": k, "start": s, "end": e, "depth": d} for k, s, e, d in every],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mask``, and ``n_chars``, if there, counted anew.

    Overlapping spans become one mask.  Texts without findings, null and empty texts
    stay as they are, and so do all other columns.
    """

    def cleaned(text: str | None) -> str | None:
        every = scan(text)[1] if text else []
        if not every:
            return text
        out, at, end = [], 0, -1
        for _, s, e, _ in sorted(every, key=lambda f: f[1]):
            if s >= end:
                out += [text[at:s], mask]
            end = max(end, e)
            at = end
        return "".join([*out, text[at:]])

    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            texts = pa.array([cleaned(x) for x in batch.column(where).to_pylist()], batch.column(where).type)
            yield batch.set_column(where, batch.schema.field(where), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
