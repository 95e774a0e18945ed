"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the whole, but never more than ``max_epochs`` times its
size. What capped sources can't take is shared among the others by weight, until no source is above
its cap. A target is met by whole repetitions of the source and one fractional one: the documents of
a seeded order while they fit. Where one doesn't fit, those after it go on to fill what is left, pass by
pass; a last one, of those that weren't taken, is taken then, added or in place of another, if that brings
the sum nearer to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, n_words, numbered, scratch_dir, small_side, unboxed

#: Buckets of the seeded order: a source's cut is first found among bucket sums, then in one bucket.
BUCKETS = 4096
WEIGHTS = (5, 2, 1)
#: A source is filled no further when this share of its target is left.
NEAR = 0.001


def targets(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a written table of (source, source_size, weight).

    Each round clamps the sources whose share is at their cap or above; the level (words a unit of
    weight) of the others rises with it, so that a source once clamped stays so. A round is one
    aggregate over the sources; there are as many rounds as levels at which sources clamp.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, F.lit(False)
    while True:
        r = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)).alias("held"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not r.weight:  # all are clamped, or there are none
            break
        risen = (total - r.held) / r.weight
        if level is not None and risen <= level:
            break
        level = risen
        clamped = F.col("weight") * F.lit(level) >= cap
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level or 0.0)))


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc, source, size, order) of each row: order is its seeded place in its source."""
    rows = boxed(docs)
    # Hashes pass over nulls, so these are marked.
    order = F.xxhash64(F.lit(seed), inside(key).cast("string"), inside(text), inside(key).isNull(), inside(text).isNull())
    return rows.select("doc", inside(source).alias("source"), n_words(inside(text)).alias("size"), order.alias("order"))


def bucket(order: Column) -> Column:
    """Place of a 64-bit order among the buckets, in the same order."""
    return F.shiftright(order, 52) + F.lit(BUCKETS // 2)


def _pass(sizes: DataFrame, asked: DataFrame, folder: str) -> DataFrame:
    """One pass over the sources of ``asked``, a written table of (s, target, rest, after, most): it takes the documents
    beyond ``after`` in the order, of ``most`` words at most, while they fit in ``rest``.

    Returns ``asked`` with cut, the place of the first that doesn't fit, copies, how many of the rows at it do, and
    gap, what is left then; cut is null where all fit. Rows equal in key and text have one place in the order.
    """
    fits = (F.col("after").isNull() | (F.col("order") > F.col("after"))) & (F.col("most").isNull() | (F.col("size") <= F.col("most")))
    open_ = sizes.join(small_side(asked), F.col("source").eqNullSafe(F.col("s"))).where(fits)
    sums = open_.groupBy("s", "rest", bucket(F.col("order")).alias("bucket")).agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.withColumn("before", before), f"{folder}/sums")
    # The bucket in which the sum passes what is left to take; a source has one at most.
    passed = small_side(sums.where("before <= rest and before + size > rest").select(F.col("s").alias("z"), F.col("bucket").alias("b"), "before"))
    rows = open_.join(passed, F.col("s").eqNullSafe(F.col("z")) & (bucket(F.col("order")) == F.col("b")))
    ties = rows.groupBy("s", "before", "rest", "order").agg(F.max("size").alias("each"), F.sum("size").alias("size"))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("order"))
    ends = ties.select("s", "order", "each", (F.col("rest") - running + F.col("size")).alias("left"), running.alias("running"), "rest")
    crossing = ends.where("running > rest").groupBy(F.col("s").alias("z")).agg(F.min(F.struct("order", "each", "left")).alias("c"))
    all_of = sums.groupBy(F.col("s").alias("y")).agg(F.sum("size").alias("all"))
    copies = F.floor(F.col("c.left") / F.col("c.each"))
    found = asked.join(crossing, F.col("s").eqNullSafe(F.col("z")), "left").join(all_of, F.col("s").eqNullSafe(F.col("y")), "left")
    gap = F.coalesce(F.col("c.left") - copies * F.col("c.each"), F.col("rest") - F.coalesce("all", F.lit(0)))
    return materialize(found.select("s", "target", "rest", "after", "most", F.col("c.order").alias("cut"), copies.alias("copies"), gap.alias("gap")), f"{folder}/pass")


def cuts(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source its whole repetitions and which documents are taken once more.

    Returns (source, source_size, target, whole, passes, last, out): of each pass the documents beyond ``after``,
    below ``cut`` and of ``most`` words at most are taken once more (a null sets no bound), and of the rows at
    ``cut`` so many ``copies``; then one at the place ``last`` in the order is taken too, and one at ``out`` isn't.
    Either may be null.
    """
    folder, same = scratch_dir(sizes.sparkSession), F.col("source").eqNullSafe(F.col("s"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    planned = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    planned = materialize(planned, f"{folder}/planned")
    none = F.lit(None).cast("long")
    asked = planned.where("source_size > 0").select(F.col("source").alias("s"), "target", "rest", none.alias("after"), none.cast("double").alias("most"))
    asked, done, k = materialize(asked, f"{folder}/asked"), None, 0
    while asked.limit(1).count():
        found = _pass(sizes, asked, f"{folder}/{k}")
        done = found if done is None else done.unionByName(found)
        asked = found.where(F.col("cut").isNotNull() & (F.col("gap") > NEAR * F.col("target"))).select("s", "target", F.col("gap").alias("rest"), F.col("cut").alias("after"), F.col("gap").alias("most"))
        k += 1
    if done is None:
        none = F.array().cast("array<struct<after:bigint,cut:bigint,most:double,copies:bigint>>")
        return planned.select("source", "source_size", "target", "whole", none.alias("passes"), *(F.lit(None).cast("long").alias(c) for c in ("last", "out")))
    # As many passes a source as its documents stop to fit, a few.
    passes = done.groupBy("s").agg(F.collect_list(F.struct("after", "cut", "most", "copies")).alias("passes"), F.min("gap").alias("gap"))
    passes = small_side(materialize(passes, f"{folder}/passes"))
    # Of each size one document that is taken and one that isn't: what is added, or what replaces what, so that least is off.
    pool = sizes.join(passes, same).withColumn("taken", taken_whole()).where(F.col("taken") | (copies_taken() == 0))
    pool = pool.groupBy("s", "gap", "taken", "size").agg(F.min("order").alias("place")).withColumn("value", F.when(F.col("taken"), F.col("size")).otherwise(F.col("size") - F.col("gap")))
    by_value = Window.partitionBy("s").orderBy("value")
    given = F.when(F.col("taken"), F.struct("size", "place"))
    lower, upper = F.last(given, True).over(by_value.rowsBetween(Window.unboundedPreceding, 0)), F.first(given, True).over(by_value.rowsBetween(0, Window.unboundedFollowing))
    pool = materialize(pool.withColumn("lower", lower).withColumn("upper", upper), f"{folder}/pool").where("not taken")
    off = lambda size: F.abs(F.col("size") - size - F.col("gap"))
    change = lambda size, out: F.struct(off(size).alias("off"), F.col("place").alias("last"), out.alias("out"))
    changes = F.array(change(F.lit(0), F.lit(None).cast("long")), *(F.when(F.col(c).isNotNull(), change(F.col(f"{c}.size"), F.col(f"{c}.place"))) for c in ("lower", "upper")))
    best = pool.select("s", "gap", F.explode(F.array_compact(changes)).alias("c")).where("c.off < gap").groupBy(F.col("s").alias("z")).agg(F.min("c").alias("c"))
    ended = passes.join(best, F.col("s").eqNullSafe(F.col("z")), "left").select("s", "passes", "c.last", "c.out")
    return planned.join(ended, same, "left").select("source", "source_size", "target", "whole", "passes", "last", "out")


def taken_whole() -> Column:
    """Whether a pass takes all rows at a place in the order of this size."""
    order, size = F.col("order"), F.col("size")
    fits = lambda p: (p["after"].isNull() | (order > p["after"])) & (p["cut"].isNull() | (order < p["cut"])) & (p["most"].isNull() | (size <= p["most"]))
    return F.coalesce(F.exists("passes", fits), F.lit(False))


def copies_taken() -> Column:
    """How many of the rows at a pass's cut it takes."""
    return F.coalesce(F.aggregate(F.filter("passes", lambda p: p["cut"] == F.col("order")), F.lit(0).cast("long"), lambda n, p: n + p["copies"]), F.lit(0))


def _ranked(equal: DataFrame, path: str) -> DataFrame:
    """``equal`` with nth, from 0 within a source's place in the order: numbered a task, then over the tasks."""
    rows = numbered(equal, path, "id").withColumn("task", F.shiftright("id", 33))
    own = ["source", "order", "task"]
    counts = rows.groupBy(*own).agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source", "order").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = small_side(counts.select(F.col("source").alias("s2"), F.col("order").alias("o2"), F.col("task").alias("t2"), base.alias("base")))
    found = rows.join(bases, F.col("source").eqNullSafe(F.col("s2")) & (F.col("order") == F.col("o2")) & (F.col("task") == F.col("t2")))
    return found.withColumn("nth", F.col("base") + F.row_number().over(Window.partitionBy(*own).orderBy("id")) - 1).drop("id", "task", "s2", "o2", "t2", "base")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, size, source_size, target, times): each row as a struct, its words, those of its source,
    its source's target, and how often the mix has it.

    Sources, in the order of their code points and null last, weigh as ``weights`` repeats, and
    share 100% of all words. A row's order depends on seed, key and text alone, so reruns agree; of
    rows equal in key and text as many are taken as the target asks for, and it doesn't matter which.

    A null text has size 0; a null key or source is one like others; documents without words come
    with the whole repetitions and in the fraction like others; a source without words has target 0;
    an empty table gives no rows; a caller's columns may have any name.
    """
    folder = scratch_dir(docs.sparkSession)
    rows = sized(docs, key, text, source, seed)
    sizes = materialize(rows.drop("doc"), f"{folder}/sizes")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    table = materialize(table.withColumn("weight", weight), f"{folder}/sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    found = materialize(cuts(sizes, targets(table, float(total), max_epochs)).withColumnRenamed("source", "s"), f"{folder}/cuts")
    rows = rows.join(small_side(found), F.col("source").eqNullSafe(F.col("s")))
    # How many of the rows at this place of the order are taken once more: all where a pass takes them whole.
    at_last, at_out = (F.coalesce(F.col("order") == F.col(c), F.lit(False)) for c in ("last", "out"))
    asked, below = copies_taken() + at_last.cast("int"), taken_whole()
    places = F.array_distinct(F.array_compact(F.concat(F.coalesce(F.transform("passes", lambda p: p["cut"]), F.array().cast("array<bigint>")), F.array("last", "out"))))
    of = found.select(F.col("s").alias("s3"), F.explode(places).alias("o3"))
    several = sizes.join(small_side(of), F.col("source").eqNullSafe(F.col("s3")) & (F.col("order") == F.col("o3"))).groupBy("source", "order").count().where("count > 1")
    some = materialize(several.select(F.col("source").alias("s4"), F.col("order").alias("o4")), f"{folder}/several")  # as many places a source as passes, and two

    def times(more: Column) -> Column:
        # Documents without words may lie before the cut of a source that is at its cap already.
        return F.least(F.col("whole") + more, F.lit(math.ceil(max_epochs))).alias("times")

    columns, once = ["doc", "size", "source_size", "target"], F.when((below & ~at_out) | (asked > 0), 1).otherwise(0)
    if some.limit(1).count():
        equal = F.col("source").eqNullSafe(F.col("s4")) & (F.col("order") == F.col("o4"))
        ranked = _ranked(rows.withColumn("asked", F.when(below, F.lit(1 << 40)).otherwise(asked)).withColumn("first", F.when(at_out, 1).otherwise(0)).join(small_side(some), equal, "left_semi"), f"{folder}/equal")
        taken = ranked.select(*columns, times(F.col("nth").between(F.col("first"), F.col("asked") - 1).cast("int")))
        return rows.join(small_side(some), equal, "left_anti").select(*columns, times(once)).unionByName(taken)
    return rows.select(*columns, times(once))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns as they came."""
    out = mix(docs, **how).where("times > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*unboxed(docs.columns))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and how many of their words the mix takes."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(inside("doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
