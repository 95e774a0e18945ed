"""Import of old SQLite files: buckets and events of a file that driver and executors can open.

The events' table is read as a Python data source, in partitions by ranges of row ids; a filter on the bucket's
key reaches SQLite.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions import payload
from .buckets import from_stamp

#: The tables of such a file, and their columns that are read.
BUCKETS, EVENTS = "SELECT key, id, type, client, hostname, created FROM bucketmodel", "SELECT bucket_id, timestamp, duration, datastr FROM eventmodel"
ROWS = 500_000


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.key = path, rows, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("bucket_key",) and self.key is None:
                self.key = f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            first, last = con.execute("SELECT min(rowid), max(rowid) FROM eventmodel").fetchone()
        return [] if first is None else [Range(k, min(k + self.rows - 1, last)) for k in range(first, last + 1, self.rows)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            asked, values = f"{EVENTS} WHERE rowid BETWEEN ? AND ?", [partition.first, partition.last]
            if self.key is not None:
                asked, values = f"{asked} AND bucket_id = ?", [*values, self.key]
            yield from con.execute(asked, values)


class LegacyEvents(DataSource):
    """Format ``legacy_events``; options ``path`` and ``rows``, the row ids of a partition."""

    @classmethod
    def name(cls) -> str:
        return "legacy_events"

    def schema(self) -> str:
        return "bucket_key long, timestamp string, duration double, datastr string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rows", ROWS)))


def read_legacy(spark: SparkSession, path: str, bucket: str | None = None, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Catalog and events, without ids, of an old file; of one bucket if it is named, KeyError if there is none.

    Events whose time can't be read or whose data are no JSON object are skipped. Durations, in seconds, are cut to nanoseconds.
    Buckets are read when this is called.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        found = [r for r in con.execute(BUCKETS) if bucket is None or r[1] == bucket]
    if bucket is not None and not found:
        raise KeyError(bucket)
    buckets = spark.createDataFrame(found, "key long, bucket string, type string, client string, hostname string, created string")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LegacyEvents)
    raw = spark.read.format("legacy_events").option("path", path).option("rows", rows).load()
    if bucket is not None:
        raw = raw.where(F.col("bucket_key") == found[0][0])
    at = from_stamp(F.replace("timestamp", F.lit(" "), F.lit("T")))
    events = raw.join(buckets.select("key", "bucket"), F.col("bucket_key") == F.col("key"))
    events = events.select("bucket", F.lit(None).cast("long").alias("id"), at.alias("start_ns"), (at + (F.col("duration") * 1e9).cast("long")).alias("end_ns"), F.to_json(F.try_parse_json("datastr")).alias("parsed"), "datastr")
    good = F.col("start_ns").isNotNull() & F.coalesce(F.startswith("parsed", F.lit("{")), F.lit(False))
    catalog = buckets.select("bucket", "type", "client", "hostname", F.try_to_timestamp(F.replace("created", F.lit(" "), F.lit("T"))).alias("created"), F.lit("{}").alias("data"))
    return catalog, events.where(good).select("bucket", "id", "start_ns", "end_ns", payload.canonical(F.col("datastr")).alias("data"))
