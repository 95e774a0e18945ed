"""Spans of time that dense buckets may be cut into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, SECOND

#: Rows of the largest bucket that isn't cut.
WINDOW_ROWS = 2_000_000
#: Spans of time that a larger bucket is cut into.
SPANS = (DAY, 3600 * SECOND, 60 * SECOND, SECOND)


def span_for(df: DataFrame, by: str = "bucket", most: int = WINDOW_ROWS) -> int:
    """The span that the interval operators may be told to cut ``df`` by: 0, for none, if no bucket has more than
    ``most`` rows, else the longest of ``SPANS`` in which no bucket has more, or the shortest. Runs jobs when called.
    """
    if (df.groupBy(by).count().agg(F.max("count")).first()[0] or 0) <= most:
        return 0
    for span in SPANS[:-1]:
        dense = df.groupBy(by, F.floor(F.col("start_ns") / F.lit(span)).alias("span")).count().agg(F.max("count")).first()[0]
        if dense <= most:
            return span
    return SPANS[-1]
