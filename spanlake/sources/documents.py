"""Whole export documents of any size, read in parts.

A document ``{"buckets": {name: bucket with events}}`` is often one line, which a JSON reader takes in one task. Here
Spark's text reader cuts it at every closing brace, at whatever byte ranges it splits files. Whether a fragment begins
inside a string, and how deep it lies, follows from all text before it. So each split is summed up under both
assumptions on how it begins; the sums, a row a split, are gone through in order; and each fragment's state then follows
from its own split. Fragments up to a brace that closes an event, or anything further out, make a piece, and
each event is parsed by itself: a bad one costs itself alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sweep
from ..scratch import written
from .buckets import read_export

#: How deep the events of a bucket lie, and the buckets.
EVENTS, BUCKETS = 4, 2
#: Strings whole, and brackets; and the key of a bucket's events with the bracket that opens them.
TOKEN, EVENTS_KEY = re.compile(r'"(?:[^"\\]|\\.)*+"|([{}\[\]])', re.S), re.compile(r'"events"\s*:\s*\[')
NAME = r'("(?:[^"\\]++|\\.)*+")\s*:\s*(\{.*)'


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, m, value, strings, deep0, deep1, odd0): the text between closing braces, in order of m within a block.

    strings is whether it begins inside a string if its block doesn't; deep0 and deep1 are how much deeper it leads if it
    begins outside and inside of one; odd0 is whether it ends inside one if it begins outside.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes stand in strings only, and end none
    raw = raw.withColumn("plain", plain).withColumn("odd0", F.pmod(F.regexp_count("plain", F.lit('"')), F.lit(2)))
    for begins in (0, 1):
        outside = F.regexp_replace(F.concat(F.lit('"' * begins), "plain"), '"[^"]*+(?:"|$)', "")
        closes = 1 - F.pmod(F.col("odd0") + begins, F.lit(2))  # the brace that ends the fragment, unless in a string
        raw = raw.withColumn(f"deep{begins}", F.regexp_count(outside, F.lit("[{\\[]")) - F.regexp_count(outside, F.lit("\\]")) - closes)
    before = Window.partitionBy("file", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    return raw.drop("plain").withColumn("strings", F.pmod(F.coalesce(F.sum("odd0").over(before), F.lit(0)), F.lit(2)))


def _placed(fragments: DataFrame) -> DataFrame:
    """(file, block, m, value, depth, ends): how deep each fragment begins, and whether it ends a piece; from a written table."""
    spark = fragments.sparkSession
    own = lambda h: F.when(F.pmod(F.col("strings") + h, F.lit(2)) == 0, F.col("deep0")).otherwise(F.col("deep1"))
    sums = fragments.groupBy("file", "block").agg(F.sum("odd0").alias("odd"), F.sum(own(0)).alias("d0"), F.sum(own(1)).alias("d1"))
    carries, odd, deep, file = [], 0, 0, None
    for r in sums.orderBy("file", "block").collect():  # a row a split
        if r.file != file:
            odd, deep, file = 0, 0, r.file
        carries.append((r.file, r.block, odd, deep))
        deep += r.d1 if odd else r.d0
        odd = (odd + r.odd) % 2
    known = spark.createDataFrame(carries, "file string, block long, odd int, deep long")
    rows = fragments.join(F.broadcast(known), ["file", "block"])
    upto = Window.partitionBy("file", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", own(F.col("odd"))).withColumn("after", F.col("deep") + F.sum("own").over(upto))
    outside = F.pmod(F.col("strings") + F.col("odd") + F.col("odd0"), F.lit(2)) == 0
    return rows.select("file", "block", "m", "value", (F.col("after") - F.col("own")).alias("depth"), (outside & (F.col("after") <= EVENTS)).cast("int").alias("ends"))


def _pieces(placed: DataFrame) -> DataFrame:
    """(file, piece, depth, text): the fragments up to each end put together, in order of piece; from a written table."""
    spark = placed.sparkSession
    bases, base, file = [], 0, None
    for r in placed.groupBy("file", "block").agg(F.sum("ends").alias("n")).orderBy("file", "block").collect():  # a row a split
        base = base if r.file == file else 0
        file = r.file
        bases.append((r.file, r.block, base))
        base += r.n
    known = spark.createDataFrame(bases, "file string, block long, base long")
    before = Window.partitionBy("file", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(F.broadcast(known), ["file", "block"]).withColumn("piece", F.col("base") + F.coalesce(F.sum("ends").over(before), F.lit(0)))
    own = rows.groupBy("file", "piece").agg(F.sort_array(F.collect_list(F.struct("block", "m", "value"))).alias("f"), F.min_by("depth", F.struct("block", "m")).alias("depth"))
    return own.select("file", "piece", "depth", F.concat(F.array_join(F.transform("f", lambda x: x["value"]), "}"), F.lit("}")).alias("text"))


def _elements(text: str) -> tuple[str | None, str]:
    """The event that a piece ends with, if it does, and what of it belongs to the bucket itself, of a piece that begins inside an
    array of events, after elements of other kinds or without any; or inside an object."""
    decode, at, n = json.JSONDecoder(strict=False).raw_decode, 0, len(text)
    while True:
        while at < n and text[at] in " \t\r\n,":
            at += 1
        if at == n or text[at] in "]}":
            return None, text[at:]
        try:
            _, end = decode(text, at)
        except ValueError:
            return None, ""
        if end == n and text[at] == "{":
            return text[at:], ""
        if text[end:].lstrip().startswith(":"):
            return None, text  # a key: it is an object
        at = end


def _opened(text: str, depth: int) -> int:
    """Where in a piece that begins at a depth the array of a bucket's events has been opened, 0 if nowhere."""
    for m in TOKEN.finditer(text):
        if m[1]:
            depth += 1 if m[1] in "{[" else -1
        elif depth == EVENTS - 1 and (opens := EVENTS_KEY.match(text, m.start())):
            return opens.end()
    return 0


def _sorted_out(pieces: DataFrame) -> DataFrame:
    """(file, piece, depth, text, event, meta): each piece's event, and what of it belongs to the bucket itself."""
    element = F.regexp_extract("text", r"(?s)^\s*,?\s*(\{.*)", 1)  # in an array; in an object a key would come first
    event = F.when(F.col("depth") == EVENTS, F.nullif(element, F.lit("")))
    pieces = pieces.withColumn("event", event)
    asked = F.col("event").isNull() & ((F.col("depth") == EVENTS) | F.contains("text", F.lit('"events"')))
    simple = pieces.where(~asked).withColumn("meta", F.when(F.col("event").isNull(), F.col("text")).otherwise(F.lit("")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for text, depth in zip(batch.column("text").to_pylist(), batch.column("depth").to_pylist(), strict=True):
                at = 0 if depth == EVENTS else _opened(text, depth)
                event, meta = _elements(text[at:]) if at or depth == EVENTS else (None, text)
                found.append((event, text[:at] + meta))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "piece", "depth", "text")), pa.array([e for e, _ in found], pa.string()), pa.array([m for _, m in found], pa.string())], ["file", "piece", "depth", "text", "event", "meta"])

    # Few: what begins or ends an array, or has elements that are no objects.
    odd = pieces.where(asked).select("file", "piece", "depth", "text").mapInArrow(run, "file string, piece long, depth long, text string, event string, meta string")
    return simple.select("file", "piece", "depth", "text", "event", "meta").unionByName(odd)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and events of the export documents under a path, as ``buckets.read_document`` gives them, in any size.

    Events that don't parse, or lack a time or an object as data, are dropped. A document whose quotes or brackets aren't
    balanced loses what follows. Jobs run when this is called: text is written with its fragments' states, and again as
    pieces; a row for each split of a file comes to the driver. An empty folder isn't allowed; a document without
    buckets gives none.
    """
    pieces = written(_sorted_out(written(_pieces(written(_placed(written(_fragments(spark, path))))))))
    named = F.when(F.col("depth") == 0, F.regexp_extract("text", rf'(?s)^\s*\{{\s*"buckets"\s*:\s*\{{\s*{NAME}', 1)).when(F.col("depth") == BUCKETS, F.regexp_extract("text", rf"(?s)^\s*,?\s*{NAME}", 1))
    names = pieces.select("file", F.col("piece").alias("start_ns"), named.alias("name")).where("name <> ''")
    until = F.lead("start_ns", 1, 1 << 62).over(Window.partitionBy("file").orderBy("start_ns"))  # a row a bucket
    names = names.withColumn("end_ns", until)
    placed = pieces.select("file", F.col("piece").alias("start_ns"), (F.col("piece") + 1).alias("end_ns"), "event", "meta")
    found = written(sweep.join(placed, names, by="file").select("file", F.col("start_ns").alias("piece"), F.col("r_start_ns").alias("bucket_at"), F.from_json(F.concat(F.lit("["), "r_name", F.lit("]")), "array<string>")[0].alias("name"), "event", "meta"))
    # What is left of a bucket without its events is its own object.
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("meta") != "", F.struct("piece", "meta")))), lambda x: x["meta"]), "")
    kind = "id string, type string, client string, hostname string, created string, data variant"
    own = found.groupBy("file", "bucket_at", "name").agg(body.alias("body"))
    own = own.withColumn("b", F.from_json(F.regexp_extract("body", rf'(?s)^\s*(?:\{{\s*"buckets"\s*:\s*\{{|,)?\s*{NAME}', 2), kind))
    own = own.withColumn("bucket", F.coalesce("b.id", "name"))
    catalog = own.select("bucket", "b.type", "b.client", "b.hostname", F.try_to_timestamp("b.created").alias("created"), F.coalesce(F.to_json("b.data"), F.lit("{}")).alias("data"))
    of = own.select(F.col("file").alias("_file"), F.col("bucket_at").alias("_at"), "bucket")
    lines = found.where("event is not null").join(of, (F.col("file") == F.col("_file")) & (F.col("bucket_at") == F.col("_at")))
    return catalog, read_export(lines.select("bucket", "event"))
