"""The corpus pipeline; each stage works on all that the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import line_dedup, mixing, near_copies, packing, quality
from spanlake.llm._common import forget, materialize, scratch_dir, scratch_inside, scratch_run

_last = threading.local()


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage, which begins with deleting the scratch tables of the one that its thread has called before.

    What a stage returns is read from its scratch tables, so it must be written before the next stage is called, as the
    pipeline does.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if folder := getattr(_last, "folder", None):
            forget(spark, folder)
        with scratch_inside(spark) as _last.folder:
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lose most words to lines frequent on their host; the lines go too."""
    return quality.filter_documents(docs)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stand earlier in the corpus, and documents of which nothing is left."""
    return line_dedup.dedup_documents(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by 5-word shingles at a similarity of 0.8, one document stays."""
    return near_copies.one_of_each_group(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hash order and token ids can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared scratch folder, and goes once the next one has read it.

    A stage's own scratch tables go when it ends, whether it fails or not.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark)
    try:
        for k, (name, stage) in enumerate(STAGES):
            with scratch_run(spark):
                docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
            if k:
                forget(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    except BaseException:
        forget(spark, folder)
        raise
    return docs
