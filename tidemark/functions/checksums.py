"""Checksums and ratios that Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import zlib

import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32c_table() -> list[int]:
    """The table of the Castagnoli polynomial, reflected."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0x82F63B78 if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = crc32c_table()


def crc32c_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of each binary; null for null."""
    return data.map(lambda x: None if x is None else crc32c_bytes(bytes(x))).astype("Int64")


@F.pandas_udf(T.DoubleType())
def zstd_ratio(text: pd.Series) -> pd.Series:
    """How many times smaller zstd makes each text."""
    pack = zstandard.ZstdCompressor(level=3)
    return text.map(lambda x: None if not x else len(x.encode()) / max(1, len(pack.compress(x.encode()))))


@F.pandas_udf(T.DoubleType())
def deflate_ratio(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if not x else len(x.encode()) / max(1, len(zlib.compress(x.encode()))))
