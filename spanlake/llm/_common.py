"""What several operators share: scratch tables, size-checked joins, word expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every operator here.
WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"

#: Rows below which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
_run: ContextVar[str | None] = ContextVar("run", default=None)
#: Bytes of an Arrow batch that a Python worker is given.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies under ``spark.checkpoint.dir``, inside a ``scratch_run`` under that. Only a local master may run without that setting.
    """
    if _run.get():
        return f"{_run.get()}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "spanlake-scratch")
    return f"{base.rstrip('/')}/spanlake/{uuid.uuid4().hex}"


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder. Frames that read it can't be used after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_inside(spark: SparkSession) -> Iterator[str]:
    """The scratch folders that this thread makes inside lie in one of its own, which stays."""
    parent = scratch_dir(spark)
    token = _run.set(parent)
    try:
        yield parent
    finally:
        _run.reset(token)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """The scratch folders that this thread makes inside lie in one of its own, which goes at the end, however it ends."""
    with scratch_inside(spark) as parent:
        try:
            yield parent
        finally:
            forget(spark, parent)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches for Python hold ``BATCH_BYTES`` at most, so that a worker's memory doesn't follow the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it again: cuts lineage and survives lost executors."""
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows; count it to know."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).collect()) <= max_rows else df


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for texts without a word."""
    trimmed = F.coalesce(F.btrim(text, F.lit(WHITE_CHARS)), F.lit(""))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, path: str, name: str) -> DataFrame:
    """``df`` written once with a column ``name`` that numbers its rows, in no order and with gaps.

    It must be written: the numbers of a plan that runs again may differ.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), path)


def boxed(df: DataFrame, name: str = "doc") -> DataFrame:
    """``df`` as one struct column, so that no column that an operator adds can clash with one of its own."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name))


def inside(column: str, name: str = "doc") -> Column:
    """A column of a ``boxed`` frame."""
    return F.col(name).getField(column)


def unboxed(columns: list[str], name: str = "doc") -> list[Column]:
    """The columns of a ``boxed`` frame under their own names, to be selected."""
    return [inside(c, name).alias(c) for c in columns]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
