"""Line dedup by winnowing over line hashes (DataFrame functions only).

A document is the sequence of its lines that have a word. A window is the fewest lines that hold
``min_words`` words, counted onwards from a line or back from one; a single long line is a window of
its own. Each window selects its least line hash, the first of equals. So whatever run of that many
words two places share, they share its windows, and select the same lines of it: these window minima
are the document's fingerprints, fewer than its lines.

Positions of equal fingerprints are joined by hash: one that has no equal anywhere ends here, and so do
documents without another. In the others a match is extended both ways over the line hashes, onwards and
back, to each window that selected it; the extended run is hashed, and of the places that agree on the
whole of it the first one stays. All lines of a shared run lie in one of these: a line with ``min_words``
words from it to the run's end lies in the window onwards from it, and the others lie in the window back
from the run's end. So the union of the repeated windows is what stands at any earlier place, whichever
place that is, and no pairs of places are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, boxed, inside, materialize, numbered, scratch_dir, unboxed

MIN_WORDS = 50
RUNS = "array<struct<from:int,to:int>>"


def hashed_lines(rows: DataFrame, order: Column, text: Column) -> DataFrame:
    """(row, order, at, n, h) of each line of ``rows`` (with _row) that has a word: its place, words and hash."""
    norm = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09\\x0B-\\x0D]+", " "), "\n")
    lines = rows.select(F.col("_row").alias("row"), order.alias("order"), F.posexplode(norm).alias("at", "line"))
    return lines.select("row", "order", "at", F.regexp_count("line", F.lit(WORD)).cast("bigint").alias("n"), F.xxhash64(F.btrim("line")).alias("h")).where("n > 0")


def windows_of(lines: DataFrame, min_words: int, extended: bool) -> DataFrame:
    """A row for each of ``hashed_lines`` that has a full window: (row, order, on, back).

    on and back are the windows onwards from the line and back from it, null where there are too few
    words: structs of low (the hash of the line they select), at (its place), from and to (places of
    the first and last line), first and last (the same among lines that have a word) and, if
    ``extended``, run (the hash of all its lines).
    """
    of_doc = Window.partitionBy("row")
    so_far = of_doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ends", F.sum("n").over(so_far)).withColumn("nth", F.count("*").over(so_far).cast("int")).withColumn("starts", F.col("ends") - F.col("n"))

    def window(own) -> Column:
        least, begin, end = F.min(F.struct("h", "at")).over(own), F.first(F.struct("at", "nth", "starts")).over(own), F.last(F.struct("at", "nth", "ends")).over(own)
        run = [F.xxhash64(F.collect_list("h").over(own)).alias("run")] if extended else []
        found = F.struct(least["h"].alias("low"), least["at"].alias("at"), begin["at"].alias("from"), end["at"].alias("to"), begin["nth"].alias("first"), end["nth"].alias("last"), *run)
        return F.when(end["ends"] - begin["starts"] >= min_words, found)

    # Frames by words: lines that begin under min_words words after the line, or end under as many before its end.
    onwards, back = of_doc.orderBy("starts").rangeBetween(0, min_words - 1), of_doc.orderBy("ends").rangeBetween(1 - min_words, 0)
    return lines.select("row", "order", window(onwards).alias("on"), window(back).alias("back")).where("on is not null or back is not null")


def windows(rows: DataFrame, order: Column, text: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """``windows_of`` the lines of ``rows``, extended."""
    return windows_of(hashed_lines(rows, order, text), min_words, True)


def fingerprints(found: DataFrame) -> DataFrame:
    """(low, row, at): the lines that the windows select, once each."""
    return found.select("row", F.explode(F.array_compact(F.array("on", "back"))).alias("w")).select("w.low", "row", "w.at").distinct()


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, runs): the runs of each row that stand at an earlier place too, as sorted (from, to) line places.

    ``lines`` must be a written table of ``hashed_lines``. Earlier is by order (null first), row and place.
    """
    folder = scratch_dir(lines.sparkSession)
    marks = materialize(fingerprints(windows_of(lines, min_words, False)), f"{folder}/marks")
    shared = materialize(marks.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select(F.col("low").alias("of")), f"{folder}/shared")
    meeting = marks.join(shared, F.col("low") == F.col("of"), "left_semi").select(F.col("row").alias("in_row")).distinct()
    # Only documents in which a fingerprint meets another are gone over again, and only windows that selected one are kept.
    found = windows_of(lines.join(materialize(meeting, f"{folder}/meeting"), F.col("row") == F.col("in_row"), "left_semi"), min_words, True)
    each = found.select("row", "order", F.explode(F.array_distinct(F.array_compact(F.array("on", "back")))).alias("w")).select("row", "order", "w.*")
    runs = each.drop("at").join(shared, F.col("low") == F.col("of"), "left_semi")
    runs = materialize(runs, f"{folder}/matched")
    place = F.struct("order", "row", "first")
    firsts = runs.groupBy("low", "run").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest <> latest").drop("latest")
    later = runs.join(firsts, ["low", "run"]).where((F.col("row") != F.col("earliest.row")) | (F.col("first") != F.col("earliest.first")))
    by_row = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    # Windows that overlap, or have only blank lines between, are one run.
    islands = later.withColumn("new", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("row", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, new_text, runs, n_lines): each row as a struct, its text without the runs of lines, of
    ``min_words`` words or more, that stand earlier in the corpus, those runs as (from, to) line places
    from 0, both included, and how many lines of it have a word.

    Earlier is by key, then by the order in which rows were numbered, then by place in the text. Lines
    are compared in lower case with one space between words. Blank lines inside a deleted run go with it.

    A null text stays null and an empty one empty; null keys come first; of repeated rows one keeps
    its lines; a text whose lines all repeat becomes empty; texts under ``min_words`` words stay; an
    empty table gives no rows; a caller's other columns may have any name.
    """
    folder = scratch_dir(docs.sparkSession)
    rows = numbered(boxed(docs), f"{folder}/rows", "_row")
    lines = materialize(hashed_lines(rows, inside(key), inside(text)), f"{folder}/lines")
    runs = repeated_runs(lines, min_words).withColumnRenamed("row", "of")
    out = rows.join(runs, F.col("_row") == F.col("of"), "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    out = out.withColumn("lines", F.split(F.coalesce(inside(text), F.lit("")), "\n"))  # a column, so that lambdas don't split anew
    # What stays lies between one run's end and the next run's start.
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["to"] + 1))
    stops = F.concat(F.transform("runs", lambda r: r["from"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice("lines", a + 1, b - a)))
    new = F.when(F.size("runs") > 0, F.array_join(kept, "\n")).otherwise(inside(text))
    n_lines = F.size(F.filter("lines", lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))))
    return out.select("doc", new.alias("new_text"), "runs", n_lines.alias("n_lines"))


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents without their repeated runs, columns as they came; documents of which nothing is left go.

    ``n_chars`` names a column to bring up to date, if there is one. For nulls, repeated rows, clashing
    columns and empty tables see ``deduplicated``.
    """
    out = deduplicated(docs, min_words, key, text).where((F.size("runs") == 0) | (F.btrim("new_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    of = {text: F.col("new_text").alias(text)}
    if n_chars in docs.columns:
        of[n_chars] = F.when(F.size("runs") > 0, F.char_length("new_text").cast(docs.schema[n_chars].dataType)).otherwise(inside(n_chars)).alias(n_chars)
    return out.select(*(of[c] if c in of else unboxed([c])[0] for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs that repeat: doc_id, n_lines, n_lines_removed, runs (from-to, ...) and text."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1)
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["from"], r["to"])), ",")
    return out.select(inside("doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_lines_removed"), runs.alias("runs"), F.col("new_text").alias("text"))


_W = r"[^\x20\x09-\x0D]+"
#: DuckDB SQL for the query's rows: of whole windows by their text, without fingerprints.
ORACLE_SQL = rf"""WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT doc_id, pos, array_to_string(regexp_extract_all(lower(line), '{_W}'), ' ') AS norm, len(regexp_extract_all(line, '{_W}')) AS n FROM raw WHERE regexp_matches(line, '{_W}')),
e AS (SELECT *, CAST(sum(n) OVER o AS BIGINT) AS ends, CAST(sum(n) OVER o AS BIGINT) - n AS starts, count(*) OVER o AS nth FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT doc_id, list(norm) OVER o AS run, max(ends) OVER o - starts AS words, nth AS a, max(nth) OVER o AS b, pos AS x, max(pos) OVER o AS y FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY starts RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
g AS (SELECT doc_id, list(norm) OVER o AS run, ends - min(starts) OVER o AS words, min(nth) OVER o AS a, nth AS b, min(pos) OVER o AS x, pos AS y FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY ends RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
w AS (SELECT DISTINCT doc_id, array_to_string(run, chr(10)) AS run, a, b, x, y FROM (SELECT * FROM f UNION ALL SELECT * FROM g) WHERE words >= {MIN_WORDS}),
later AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
i AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM later),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM i),
m AS (SELECT doc_id, min(x) AS x, max(y) AS y FROM k GROUP BY doc_id, island),
r AS (SELECT doc_id, string_agg(x || '-' || y, ',' ORDER BY x) AS runs, CAST(sum(y - x + 1) AS BIGINT) AS gone FROM m GROUP BY doc_id),
t AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw WHERE doc_id IN (SELECT doc_id FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = raw.doc_id AND pos BETWEEN m.x AND m.y) GROUP BY raw.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS n_lines, coalesce(r.gone, 0) AS n_lines_removed, coalesce(r.runs, '') AS runs, CASE WHEN r.runs IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)"""
