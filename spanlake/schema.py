"""Events: intervals in nanoseconds with a JSON payload, in named buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bucket STRING, id LONG, start_ns LONG, end_ns LONG, data STRING (a JSON object).
EVENT = ["bucket", "id", "start_ns", "end_ns", "data"]
EVENT_DDL = "bucket string, id long, start_ns long, end_ns long, data string"
SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def ns(timestamp: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp column (UTC for those without a zone)."""
    return F.unix_micros(timestamp.cast("timestamp")) * 1000


def seconds(df: DataFrame) -> DataFrame:
    """Add ``duration``, in seconds as a double."""
    return df.withColumn("duration", (F.col("end_ns") - F.col("start_ns")) / SECOND)


def events(df: DataFrame, bucket: Column, id: Column, start_ns: Column, duration_ns: Column, data: Column) -> DataFrame:  # noqa: A002
    """An event frame from any columns. Null durations count as 0."""
    return df.select(bucket.alias("bucket"), id.cast("long").alias("id"), start_ns.alias("start_ns"), (start_ns + F.coalesce(duration_ns, F.lit(0))).alias("end_ns"), data.alias("data"))
