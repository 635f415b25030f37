"""Hot feeds: JSON lines and SQLite files."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.normalize import normalize


def read_jsonl(spark: SparkSession, path: str, fallback_table: str = "log", now_ms: int = 0) -> DataFrame:
    """Rows of JSON lines, with ``malformed`` and the position ``pos`` of the line; blank lines are no records."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return normalize(lines, "value", fallback_table, now_ms).drop("value")


def is_sqlite(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(15) == b"SQLite format 3"


def choose_table(names: list[str], wanted: str = "log") -> str:
    """The wanted table, else ``tx``, ``log``, or the first."""
    for name in ([wanted] if wanted != "log" else []) + ["tx", "log"]:
        if name in names:
            return name
    if not names:
        raise ValueError("the database has no table")
    return names[0]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsPerTask", "100000"))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by rootpage")]
            self.table = choose_table(names, options.get("table", "log"))
            self.low, self.high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"').fetchone()

    def partitions(self):
        return [_Range(a, min(a + self.rows - 1, self.high)) for a in range(self.low, self.high + 1, self.rows)] or [_Range(0, -1)]

    def read(self, part):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            db.row_factory = sqlite3.Row
            for row in db.execute(f'select rowid as __pos, * from "{self.table}" where rowid between ? and ?', (part.low, part.high)):
                record = {k: row[k] for k in row.keys() if k != "__pos" and not isinstance(row[k], bytes)}
                yield row["__pos"], json.dumps(record)


class SqliteSource(DataSource):
    """Rows of a SQLite table as JSON texts, dealt by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_feed"

    def schema(self) -> str:
        return "pos long, value string"

    def reader(self, schema):
        return _SqliteReader(self.options)


def read_sqlite(spark: SparkSession, path: str, table: str = "log", now_ms: int = 0) -> DataFrame:
    """Rows of a SQLite feed; columns are taken by the same aliases as keys of JSON lines."""
    spark.dataSource.register(SqliteSource)
    raw = spark.read.format("sqlite_feed").option("table", table).load(path)
    return normalize(raw, "value", table, now_ms).drop("value")


def read_hot(spark: SparkSession, path: str, fallback_table: str = "log", now_ms: int = 0) -> DataFrame:
    """A feed of either format; only a local single file can be SQLite."""
    local = Path(path.removeprefix("file:"))
    reader = read_sqlite if local.is_file() and is_sqlite(str(local)) else read_jsonl
    return reader(spark, path, fallback_table, now_ms)
