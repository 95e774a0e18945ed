"""Operators on intervals within buckets. Events are ordered by (start_ns, id) within a bucket.

Zero-length and overlapping events, ties and repeated rows are allowed unless an operator says
otherwise; null starts or ends aren't. Empty input gives empty output. Columns beyond those of an
event are dropped. Rows a bucket are counted when an operator is called, and large buckets are cut into parts,
see ``folds``; ``span`` cuts all into spans of so many nanoseconds instead, and 0 cuts none. Payloads are compared as
JSON objects: order of keys, white space and escapes don't matter, and come out in one form (sorted keys, no white space).
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload
from ..schema import EVENT
from ..scratch import written
from . import sweep
from .folds import CUT_ROWS, PART_ROWS, Fold, cut_points, fold_events, in_parts, no_cuts, spans, with_part


def merge_same(events: DataFrame, pulse_ns: int, touching: bool, span: int | None = None, share: bool = False) -> DataFrame:
    """Merge neighbours of equal data whose gap to the furthest end of their run is below ``pulse_ns``
    (at most, if ``touching``). The first event's id, start and data stay, the end is the furthest. With ``share``
    other gaps below ``pulse_ns`` are split between their neighbours.
    """
    fold = Fold(limit=pulse_ns if touching else pulse_ns - 1, by_key=True, pulse=pulse_ns if share else 0)
    return fold_events(events.withColumn("data", payload.canonical()), F.col("data"), fold, span)


def flood(events: DataFrame, pulse_ns: int = 5_000_000_000, span: int | None = None) -> DataFrame:
    """Fill gaps shorter than ``pulse_ns``: events of equal data merge, others meet in the middle."""
    return merge_same(events, pulse_ns, touching=False, span=span, share=True)


def heartbeat_merge(events: DataFrame, pulse_ns: int, span: int | None = None) -> DataFrame:
    """What a heartbeat stream in order of start leaves: gaps up to ``pulse_ns`` between equal data close."""
    return merge_same(events, pulse_ns, touching=True, span=span)


def period_union(*frames: DataFrame, span: int | None = None) -> DataFrame:
    """The union of all intervals: touching ones merge, data is empty, the first's id stays."""
    df = frames[0].select(*EVENT)
    for f in frames[1:]:
        df = df.unionByName(f.select(*EVENT))
    return fold_events(df.withColumn("data", F.lit("{}")), None, Fold(limit=0, by_key=False), span)


def chunk_by_key(events: DataFrame, key: str, span: int | None = None) -> DataFrame:
    """Runs of equal values of a key: durations add up, the first event's id, start and data stay.

    Events without the key are left out and don't break a run.
    """
    df = events.withColumn("_key", payload.value(events, key)).where(F.col("_key").isNotNull())
    return fold_events(df, F.col("_key"), Fold(limit=None, by_key=True, total=True), span)


def furthest(events: DataFrame, span: int | None = None) -> DataFrame:
    """Add ``before``: the furthest end of the bucket's earlier events, null for its first."""
    return fold_events(events, None, Fold(limit=None, by_key=False, label=True), span).drop("island")


def overlaps(left: DataFrame, right: DataFrame, by: str = "bucket", width: int | None = None, small: bool = False) -> DataFrame:
    """Pairs of rows whose intervals share more than a point, as left's columns and right's with ``r_``.

    Pairs are found by sorted starts, see ``sweep``. With ``width`` both sides are cut into bins of so many nanoseconds
    and meet in equal bins; a pair counts in the bin where the later of the two starts. An interval is in as many
    bins as it spans.
    """
    right = right.where("end_ns > start_ns")
    if width is None:
        return sweep.join(left, right, by, small=small)
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start_ns") / F.lit(width)), F.floor((F.col("end_ns") - 1) / F.lit(width)))).alias("_bin")
    a = left.where("end_ns > start_ns").select("*", bins())
    b = right.select("*", bins())
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    meet = (a[by] == b[f"r_{by}"]) & (F.col("_bin") == F.col("r__bin")) & (F.col("start_ns") < F.col("r_end_ns")) & (F.col("end_ns") > F.col("r_start_ns"))
    first = F.floor(F.greatest("start_ns", "r_start_ns") / F.lit(width)) == F.col("_bin")
    return a.join(b, meet & first).drop("_bin", "r__bin")


def period_intersect(events: DataFrame, periods: DataFrame, width: int | None = None, united: bool = False, span: int | None = None) -> DataFrame:
    """The parts of events that lie inside the periods, with id and data of the event.

    Periods of a bucket are united first, unless they are ``united`` already. Zero-length events and
    periods give nothing, nor do touching ones.
    """
    if span is None and width is None:
        periods = written(periods.select(*EVENT))  # fewer than the events, as a rule
        span = no_cuts(events, periods)
    if not united:
        periods = period_union(periods.where("end_ns > start_ns"), span=span)
    pairs = overlaps(events.select(*EVENT), periods.select("bucket", "start_ns", "end_ns"), width=width, small=span == 0)
    return pairs.select("bucket", "id", F.greatest("start_ns", "r_start_ns").alias("start_ns"), F.least("end_ns", "r_end_ns").alias("end_ns"), "data")


def period_intersect_consumed(events: DataFrame, periods: DataFrame, span: int | None = None) -> DataFrame:
    """The parts of events that lie inside the periods, as one walk along both sorted sides finds them.

    The walk never goes back: a period that an event has run beyond is over for all events after it, and of periods
    that overlap one another the next one counts from where the one before has been used up. So an event meets the
    periods from the first on whose furthest end so far reaches the end of all events before; of these each that
    isn't covered by earlier ones gives a piece, from the end of those before it. Without overlaps on either side that
    is ``period_intersect``, with periods that aren't united. A period without length inside an event gives a piece
    without length; events without length give none.
    """
    e = furthest(events.select(*EVENT), span)
    f = furthest(periods.select(*EVENT), span).where("before is null or end_ns > before")  # the others are covered
    pairs = sweep.join(e, f.select("bucket", "start_ns", "end_ns", "before"))
    reached = lambda end: F.col("before").isNull() | F.coalesce(end >= F.col("before"), F.lit(False))
    # Where the period isn't the first that the event meets, those before it are used up.
    used = F.when(F.col("r_before").isNotNull() & reached(F.col("r_before")), F.col("r_before"))
    pairs = pairs.where(reached(F.col("r_end_ns"))).withColumn("begins", F.greatest("start_ns", used))
    pairs = pairs.where("begins < r_end_ns and begins < end_ns and r_start_ns < end_ns")
    return pairs.select("bucket", "id", F.greatest("begins", "r_start_ns").alias("start_ns"), F.least("end_ns", "r_end_ns").alias("end_ns"), "data")


class _Union:
    """One walk along two lists: rows of (first, id, start, end, data) go in, each list in its order, both by start; (id, start, end,
    data) of their union come out.

    The heads of the lists are compared. Where they meet, the second's is given out up to the first's start, the
    first's is whole, and what the second's has left beyond it is the head that is compared next. Only
    rows that may still meet one another are held.
    """

    def __init__(self):
        self.lists = deque(), deque()

    def heads(self, now):
        one, two = self.lists
        while one and two:
            a, b = one[0], two[0]
            meet = max(a[1], b[1]) < min(a[2], b[2])
            if a[1] <= b[1]:
                yield one.popleft()
                if meet:
                    two.popleft()
                    if a[2] < b[2]:
                        two.appendleft((None, a[2], *b[2:]))
            elif meet:
                yield (None, b[1], a[1], b[3])
                two[0] = (None, a[1], *b[2:])
            else:
                yield two.popleft()
        # A head that ends by now meets nothing that is to come; but one of the second that begins now comes after the first's.
        while one and (now is None or one[0][2] <= now):
            yield one.popleft()
        while two and (now is None or two[0][1] < now and two[0][2] <= now):
            yield two.popleft()

    def put(self, first, *row):
        self.lists[not first].append(row)
        yield from self.heads(row[1])


#: Rows of a walk: of a part, or held at its end (then ``nth`` says in which place); ``out`` are rows of the union.
WALK = "part long, nth long, out boolean, first boolean, bucket string, id long, start_ns long, end_ns long, data string"


def _walked(rows: DataFrame, last: frozenset, out: bool) -> DataFrame:
    """What walks along the parts of ``rows`` (WALK, sorted) give: with ``out`` their unions, and what they hold when they end.

    A part's walk begins with the rows that have a number, in that order. In the ``last`` part of a bucket nothing is held.
    """

    def run(batches):
        from itertools import groupby, islice

        import pyarrow as pa

        columns = ("part", "bucket", "first", "id", "start_ns", "end_ns", "data", "nth")
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))

        def walked():
            for (part, bucket), own in groupby(rows, key=lambda r: r[:2]):
                walk = _Union()
                for r in own:
                    if r[7] is not None:
                        walk.lists[not r[2]].append(r[3:7])
                        continue
                    for x in walk.put(*r[2:7]):
                        if out:
                            yield part, None, True, None, bucket, *x
                if part < 0 or part in last:
                    if out:
                        yield from ((part, None, True, None, bucket, *x) for x in walk.heads(None))
                else:
                    held = [(first, *x) for first, some in ((True, walk.lists[0]), (False, walk.lists[1])) for x in some]
                    yield from ((part, k, False, x[0], bucket, *x[1:]) for k, x in enumerate(held))

        types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in WALK.split(", ")])
        given = walked()
        while some := list(islice(given, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, WALK)


def _walk_parts(rows: DataFrame, cuts: dict) -> DataFrame:
    """The union's rows of parts of cut buckets (WALK), from a written table.

    What a walk holds where a part ends hardly ever depends on what it held where the part began. So all parts are walked along
    at once, each from what the one before it held at its end in the round before, until no part holds anything else than it did
    then: by then each part has been walked along from what the one before it really holds. The first round begins with nothing, and two
    rounds are enough as a rule; there are never more than parts and one.
    """
    ends = [int(e) - 1 for e in np.cumsum([len(c) + 1 for c in cuts.values()])]
    last = frozenset(ends)
    held, known = rows.limit(0), None
    while True:
        begun = rows.unionByName(held.withColumn("part", F.col("part") + 1))
        walked = written(_walked(in_parts(begun, cuts, "bucket", F.col("nth").asc_nulls_last(), "start_ns", "id", "data"), last, known is not None))
        held = walked.where("not out")
        found = {r.part: (r.n, r.h) for r in held.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("nth", "first", "id", "start_ns", "end_ns", "data").cast("decimal(38,0)")).alias("h")).collect()}  # a row a part
        if known is not None and found == known:
            return walked.where("out")
        known = found


def union_no_overlap(first: DataFrame, second: DataFrame, strict: bool = True, span: int | None = None) -> DataFrame:
    """All of ``first``, and of ``second`` what ``first`` leaves free; pieces of split events have no id.

    With ``strict`` the heads of both lists are compared, in order of (start_ns, id), and each is used up in turn: an
    event of ``first`` is taken only from the one event of ``second`` that it meets first, and overlaps within a side
    stay. Without, it is taken from all. A bucket is gone through row by row, holding only rows that may still meet; a large one
    in parts, each in a task. Both sides are written when this is called.
    """
    a, b = first.select(*EVENT), second.select(*EVENT)
    if not strict:
        return a.unionByName(_left_free(a, b, span))
    both = a.withColumn("first", F.lit(True)).unionByName(b.withColumn("first", F.lit(False)))
    cuts = {}
    if span != 0:
        both = written(both)
        cuts = spans(both, span) if span else cut_points(both, PART_ROWS, CUT_ROWS)
    parted = with_part(both, cuts) if cuts else both.withColumn("part", F.lit(-1).cast("long"))
    rows = parted.select("part", F.lit(None).cast("long").alias("nth"), F.lit(False).alias("out"), "first", *EVENT)
    small = rows.where("part < 0").repartition("bucket").sortWithinPartitions("bucket", "start_ns", "id", "data")
    out = _walked(small, frozenset(), True)
    return (out.unionByName(_walk_parts(rows.where("part >= 0"), cuts)) if cuts else out).select(*EVENT)


def without_overlaps(events: DataFrame, span: int | None = None) -> DataFrame:
    """Events up to the next one's start at most, those that are left with some length. A large bucket is cut into parts; a part's
    last event ends where the next part begins."""
    df = events.select(*EVENT)
    cuts = {}
    if span != 0:
        df = written(df)
        cuts = spans(df, span) if span else cut_points(df, PART_ROWS, CUT_ROWS)
    after = F.lead("start_ns").over(Window.partitionBy("bucket", "part").orderBy("start_ns", "id"))
    if not cuts:
        parted = df.withColumns({"part": F.lit(-1).cast("long"), "_next": F.lit(None).cast("long")})
    else:
        parted = with_part(df, cuts).drop("own")
        begins, next_ = {r.part: (r.bucket, r.start) for r in parted.where("part >= 0").groupBy("part", "bucket").agg(F.min("start_ns").alias("start")).collect()}, []  # a row a part
        for part, following in zip(sorted(begins), sorted(begins)[1:], strict=False):
            if begins[part][0] == begins[following][0]:
                next_.append((part, begins[following][1]))
        known = df.sparkSession.createDataFrame(next_, "_of long, _next long")
        parted = parted.join(F.broadcast(known), F.col("part") == F.col("_of"), "left").drop("_of")
    ends = parted.withColumn("_after", F.coalesce(after, "_next"))
    return ends.withColumn("end_ns", F.least("end_ns", F.coalesce("_after", "end_ns"))).where("end_ns > start_ns").select(*EVENT)


def _left_free(first: DataFrame, second: DataFrame, span: int | None) -> DataFrame:
    """What no event of ``first`` covers of those of ``second``: their parts in the gaps between the periods of ``first``."""
    periods = furthest(period_union(first.where("end_ns > start_ns"), span=span), span)
    lo, hi = -(1 << 62), 1 << 62
    gaps = periods.select("bucket", F.coalesce("before", F.lit(lo)).alias("start_ns"), F.col("start_ns").alias("end_ns"))
    last = periods.groupBy("bucket").agg(F.max("end_ns").alias("start_ns"), F.lit(hi).alias("end_ns"))
    met = second.join(last.select(F.col("bucket").alias("_b"), F.lit(True).alias("_has")), F.col("bucket").eqNullSafe(F.col("_b")), "left")
    whole = met.where("_has is null or end_ns <= start_ns").drop("_b", "_has")  # buckets without periods, and rows without length
    parts = sweep.join(met.where("_has").drop("_b", "_has"), gaps.unionByName(last))
    begins, ends = F.greatest("start_ns", "r_start_ns"), F.least("end_ns", "r_end_ns")
    uncut = (begins == F.col("start_ns")) & (ends == F.col("end_ns"))
    return whole.unionByName(parts.select("bucket", F.when(uncut, F.col("id")).alias("id"), begins.alias("start_ns"), ends.alias("end_ns"), "data").where("start_ns < end_ns"))
