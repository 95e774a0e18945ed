"""Quality rules: counts of a text, and cross-document line frequency (DataFrame functions only).

A host's boilerplate is the lines that many of its documents have. Lines are normalised (lower case,
one space between words, digits as 0) and hashed; for each host the distinct documents that have a
line are counted; lines above the limit go, and a document that loses most of its words is rejected.

Documents are distinct if their sets of lines differ, so exact copies, and such as only repeat or move
lines, don't make one another's lines frequent. Documents that differ in any line do: what many of
them share is boilerplate, however little each has of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, numbered, scratch_dir, small_side, unboxed, words

#: A line goes if more distinct documents of its host have it than both of these allow.
MIN_DOCS, MIN_SHARE = 20, 0.002
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
SYMBOLS = "[#*$%&|<>]"


def with_repeated_words(df: DataFrame, listed: str, name: str) -> DataFrame:
    """Add ``name``: how many words of the array ``listed`` lie in a 3-word window found twice or more in it.

    Windows are hashed and sorted with their places; equal neighbours repeat. What they cover is
    summed over their sorted places, each adding as much as it reaches beyond the one before. Each
    step is a column that is used more than once, so that no lambda computes it anew.
    """
    hashed = F.transform(F.slice(listed, 3, F.greatest(F.size(listed), F.lit(1))), lambda w, i: F.xxhash64(F.get(listed, i), F.get(listed, i + 1), w))
    df = df.withColumn("_windows", F.when(F.size(listed) > 3, hashed).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(0), F.size("_windows") - 1).alias("at")))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    pairs = F.zip_with("_placed", F.slice("_placed", 2, F.greatest(F.size("_placed"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.array_compact(pairs))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    reach = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
    return df.withColumn(name, F.coalesce(reach["n"], F.lit(0)).cast("bigint")).drop("_windows", "_placed")


def measure(docs: DataFrame) -> DataFrame:
    """Counts and hashed lines of each row of (doc, host, text): doc, host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and lines, an array of (h, n, at): hash, words and place of each line that has a word.
    """
    step = docs.select("doc", "host", F.coalesce("text", F.lit("")).alias("text"))
    step = step.withColumn("split", F.split("text", "\n"))
    step = step.withColumn("by_line", F.transform("split", words))
    step = step.withColumn("all", F.flatten("by_line"))
    step = with_repeated_words(step, "all", "repeated")
    full = F.filter("split", lambda x, i: F.size(F.get("by_line", i)) > 0)
    line = lambda w, i: F.struct(F.xxhash64(F.regexp_replace(F.lower(F.array_join(w, " ")), "[0-9]+", "0")).alias("h"), F.size(w).alias("n"), i.alias("at"))
    return step.select(
        "doc", "host",
        F.size("all").cast("long").alias("n_words"),
        F.char_length(F.array_join("all", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.col("repeated").alias("n_repeat_words"),
        F.filter(F.transform("by_line", line), lambda x: x["n"] > 0).alias("lines"),
    )


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h, n_docs) of the lines above their host's limit, from a written ``measure`` table.

    n_docs counts the host's distinct sets of lines that have the line. A null host is a host; documents
    without lines count for nothing; an empty table gives no rows.
    """
    folder, hs = scratch_dir(measured.sparkSession), F.array_sort(F.array_distinct("lines.h"))
    docs = measured.select("host", F.xxhash64(hs).alias("whole"), hs.alias("hs")).where(F.size("hs") > 0)
    hosts = docs.select("host", "whole").distinct().groupBy(F.col("host").alias("of")).agg((F.count("*") * min_share).alias("most"))
    seen = docs.select("host", "whole", F.explode("hs").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    limits = small_side(materialize(hosts, f"{folder}/limits"))
    return seen.join(limits, F.col("host").eqNullSafe(F.col("of"))).where("n_docs > most").select("host", "h", "n_docs")


def judge(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The verdict on each row of ``docs``.

    Returns doc (a struct of ``keep``), the counts of ``measure``, base_failed (under 50 words, or over
    half of them in repeated windows), removed (the places of lines above their host's limit, from 0),
    n_words_left and kept: true unless base_failed or depleted.

    A null or empty text has no words and so fails; a null host is a host; repeated rows get the
    same verdict; an empty table gives no rows; columns may have any name, the others are ignored.
    """
    folder, rows = scratch_dir(docs.sparkSession), boxed(docs)
    rows = rows.select(F.struct(*unboxed(keep)).alias("doc"), inside(host).alias("host"), inside(text).alias("text"))
    measured = numbered(measure(rows), f"{folder}/measured", "row")
    frequent = materialize(frequent_lines(measured, min_docs, min_share), f"{folder}/frequent")
    side = small_side(frequent.select(F.col("host").alias("of"), "h"))
    lines = measured.select("row", "host", F.inline("lines"))
    hits = lines.join(side, (lines.h == side.h) & F.col("host").eqNullSafe(F.col("of"))).groupBy("row").agg(F.sum("n").alias("lost"), F.sort_array(F.collect_list("at")).alias("removed"))
    judged = measured.drop("lines", "host").join(hits, "row", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    removed = F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc", *measures, failed.alias("base_failed"), removed, left.alias("n_words_left"), (~failed & (left >= F.col("n_words") * min_left)).alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str = "n_chars", **limits) -> DataFrame:
    """The documents that the rules keep, without their frequent lines; columns as they came.

    ``n_chars`` names a column to bring up to date, if there is one. For nulls, empty and repeated
    rows and clashing columns see ``judge``.
    """
    rows = numbered(boxed(docs), f"{scratch_dir(docs.sparkSession)}/rows", "row")
    asked = rows.select("row", inside(text).alias("text"), inside(host).alias("host"))
    verdicts = judge(asked, ["row"], "text", "host", **limits).where("kept").select(inside("row").alias("of"), "removed")
    out = rows.join(verdicts, F.col("row") == F.col("of"))
    left = F.filter(F.split(inside(text), "\n"), lambda _, i: ~F.array_contains("removed", i))
    out = out.withColumn("new_text", F.when(F.size("removed") > 0, F.array_join(left, "\n")).otherwise(inside(text)))
    of = {text: F.col("new_text").alias(text)}
    if n_chars in docs.columns:
        of[n_chars] = F.when(F.size("removed") > 0, F.char_length("new_text").cast(docs.schema[n_chars].dataType)).otherwise(inside(n_chars)).alias(n_chars)
    return out.select(*(of[c] if c in of else unboxed([c])[0] for c in docs.columns))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select(
        inside("doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", F.size("removed").alias("n_lines_removed")
    )


_W = r"[^\x20\x09-\x0D]+"
#: DuckDB SQL for the query's rows.
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
raw AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
lines AS (SELECT doc_id, source, line, pos, len(regexp_extract_all(line, '{_W}')) AS n, regexp_replace(lower(array_to_string(regexp_extract_all(line, '{_W}'), ' ')), '[0-9]+', '0', 'g') AS norm FROM raw WHERE regexp_matches(line, '{_W}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
w3 AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM w3 WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
sets AS (SELECT doc_id, string_agg(DISTINCT norm, chr(10) ORDER BY norm) AS s FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT s) AS docs FROM sets JOIN d USING (doc_id) GROUP BY source),
seen AS (SELECT source, norm, count(DISTINCT s) AS n FROM lines JOIN sets USING (doc_id) GROUP BY source, norm),
frequent AS (SELECT s.source, s.norm FROM seen s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE s.n > {MIN_DOCS} AND s.n > h.docs * {MIN_SHARE}),
lost AS (SELECT l.doc_id, sum(l.n) AS n, count(*) AS lines FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed, CAST(len(ws) - coalesce(lost.n, 0) AS BIGINT) AS n_words_left, CAST(coalesce(lost.lines, 0) AS INTEGER) AS n_lines_removed
 FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, NOT base_failed AND n_words_left >= n_words * {MIN_LEFT} AS kept FROM c"""
