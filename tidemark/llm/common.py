"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, discard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reference(column: str) -> Column:
    """A key for joins on an id that may be null: null ids are equal to each other and to no other."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, without a shuffle: a task takes several in turn.

    For tables of a loop's rounds, which shrink: else each is as many small files as the
    shuffle has partitions.  An eighth of those partitions remain, and four for each core at least.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets by ``column``: a join on it moves the other side alone."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{checkpoint_dir(spark)}/{name}").bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


def free(*tables: DataFrame) -> None:
    """Discard tables, and let the JVM collect what it holds: files of shuffles go with the plans that made them."""
    discard(*tables)
    tables[0].sparkSession._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of texts small; both ends of the pipe hold one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release_memory() -> None:
    """Give freed memory back: idle Python workers stay beside the busy ones and count as well."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the text in ``column`` passes ``max_bytes``; one long text stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        release_memory()
