"""Scalar functions of the archive as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import ID_SEPARATOR

FNV_BASIS, FNV_PRIME, WORD = 2166136261, 16777619, 0xFFFFFFFF
#: Fixed pattern of references to photos kept outside the row.
PHOTO_REF = r"^photo:sha256:([0-9a-f]{64}):size=([0-9]+)$"
#: Fixed pattern of the names of chunk files.
CHUNK_NAME = r"^[A-Za-z0-9_][A-Za-z0-9_.-]*\.chk$"
#: Tables whose names say that they hold blobs.
BLOB_TABLE = r"(?i)blob|photo|image|thumb"


def to_int(text: Column) -> Column:
    """A whole number from text as JavaScript's Number reads it, else null: blanks, fractions and infinities are none."""
    number = F.trim(text).try_cast("double")
    good = (F.length(F.trim(text)) > 0) & (number == F.floor(number)) & (F.abs(number) < 9007199254740992.0)
    return F.when(good, number.cast("bigint"))


def synthetic_id(table: Column, device: Column, seq: Column) -> Column:
    return F.concat_ws(ID_SEPARATOR, table, device, seq.cast("string"))


def sanitize_table(name: Column) -> Column:
    """A table's name for file names: other characters become underscores, 32 at most."""
    clean = F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, 32)
    return F.when(F.length(clean) > 0, clean).otherwise("log")


def month_of(ts: Column) -> Column:
    """UTC month of epoch milliseconds; times not after 1970 fall into its first month."""
    return F.when(ts > 0, F.date_format(F.timestamp_millis(ts), "yyyy-MM")).otherwise("1970-01")


def lane_of(table: Column) -> Column:
    """0 for text, 1 for blobs, which ship after it."""
    return F.when(table.rlike(BLOB_TABLE), 1).otherwise(0)


def is_photo_ref(body: Column) -> Column:
    return F.coalesce(body.rlike(PHOTO_REF), F.lit(False))


def valid_sha(text: Column) -> Column:
    """Whether a text is a content hash in hexadecimal."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def valid_chunk_name(name: Column) -> Column:
    """Whether a name is a chunk's file name and no path."""
    return F.coalesce(name.rlike(CHUNK_NAME) & ~name.contains("/") & ~name.contains("\\") & ~name.contains(".."), F.lit(False))


def _fnv_step(h: Column, code: Column) -> Column:
    """FNV-1a of one more code point: of its UTF-16 units."""
    mix = lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(WORD))
    high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    return F.when(code <= 0xFFFF, mix(h, code)).otherwise(mix(mix(h, high), low))


def fnv1a32(text: Column, basis: int = FNV_BASIS) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when(F.char_length(text) == 0, F.lit(basis).cast("bigint")).otherwise(F.aggregate(codes, F.lit(basis).cast("bigint"), _fnv_step))


BLOOM_BITS, BLOOM_HASHES = 2048, 3


def bloom_positions(key: Column) -> Column:
    """Bits that a key sets in a filter of fixed size, as an array: double hashing with FNV of the key (after a number) and of its reverse.

    All hashes are taken in one pass over the key, each from its state behind the number.
    """
    starts = [FNV_BASIS] * (BLOOM_HASHES + 1)  # the last one is of the reverse
    for i in range(BLOOM_HASHES):
        for c in f"{i}:":
            starts[i] = ((starts[i] ^ ord(c)) * FNV_PRIME) & WORD
    names = [f"h{i}" for i in range(len(starts))]
    start = F.struct(*[F.lit(s).cast("bigint").alias(n) for n, s in zip(names, starts, strict=True)])
    chars = F.split(key, "")
    both = F.zip_with(chars, F.reverse(chars), lambda f, r: F.struct(F.ascii(f).cast("bigint").alias("f"), F.ascii(r).cast("bigint").alias("r")))
    step = lambda s, c: F.struct(*[_fnv_step(s[n], c["r" if n == names[-1] else "f"]).alias(n) for n in names])
    bits = lambda s: F.array(*[(s[n].bitwiseXOR(s[names[-1]]) % BLOOM_BITS).cast("int") for n in names[:-1]])
    return F.when(F.char_length(key) == 0, bits(start)).otherwise(F.aggregate(both, start, step, bits))


def bloom_may_contain(bits: Column, key: Column) -> Column:
    """Whether a filter (sorted array of set bits) can hold the key; an unknown or empty filter can hold any."""
    hit = F.forall(bloom_positions(key), lambda p: F.array_contains(bits, p))
    return F.coalesce(F.size(bits) <= 0, F.lit(True)) | F.coalesce(hit, F.lit(True))


def chunk_name(table: Column, seq_min: Column, seq_max: Column, sha: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    return F.concat_ws("-", sanitize_table(table), pad(seq_min), pad(seq_max), F.substring(sha, 1, 8))


def claim_id(value: Column, issued_at: Column, nonce: Column) -> Column:
    return F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws(":", value.cast("string"), issued_at.cast("string"), nonce), 256), 1, 20))


def base64_size(text: Column) -> Column:
    """Bytes that a text decodes to if it is strict base64, else null."""
    bare = F.regexp_replace(text, r"\s", "")
    data = F.try_to_binary(bare, F.lit("base64"))
    return F.when((F.length(bare) % 4 == 0) & bare.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.octet_length(data))
