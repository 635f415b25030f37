"""The archive's row type, its catalog, and adapters from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The one relation: all columns are non-null once rows are normalised.
ROW = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
ROW_COLUMNS = ROW.fieldNames()
#: Largest accepted sequence number, and the separator of synthetic ids (fixed values of the row contract).
SEQ_MAX = 99_999_999
ID_SEPARATOR = "\x1f"
CATALOG_VERSION = 1


def epoch_ms(column: str):
    """Milliseconds since 1970 in UTC of a timestamp without zone, rounded down."""
    return F.expr(f"cast(floor(unix_micros(cast({column} as timestamp)) / 1000) as bigint)")


def hot_view(events: DataFrame, id_kind: str = "entity") -> DataFrame:
    """``events`` as archive rows, with ``value``; ids name the user (``entity``) or the event (``event``)."""
    events.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    ids = {"entity": F.concat(F.lit("u-"), F.col("user_id")), "event": F.concat(F.lit("trx-"), F.lpad((F.col("event_id") + 1).cast("string"), 8, "0"))}
    return events.select(
        F.concat(F.lit("dev-"), F.col("user_id") % 8).alias("device_id"),
        (F.col("event_id") + 1).alias("seq"),
        epoch_ms("ts").alias("ts"),
        ids[id_kind].alias("id"),
        F.col("event_type").alias("table"),
        F.col("props").alias("body"),
        "value",
    )


def chunked(rows: DataFrame, span: int = 500) -> DataFrame:
    """Rows with the logical ``file`` they lie in: one for each table and ``span`` sequence numbers.

    A function of the row alone, so no window or shuffle deals rows to chunks.
    """
    return rows.withColumn("file", F.format_string("%s-%08d", "table", ((F.col("seq") - 1) / span).cast("long")))
