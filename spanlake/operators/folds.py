"""Folds over a bucket's events in order of (start_ns, id), in one pass.

A fold goes over sorted Arrow batches and keeps one open event: the next row joins it, or closes it and
becomes the open one. A bucket of up to ``PART_ROWS`` rows is gone over in the task it is shuffled to, batch by batch.

A larger bucket is cut at quantiles of its own starts into parts of about ``CUT_ROWS`` rows. Two stages go over
its parts, batch by batch too. The first one sums each part up in a row: its first run and its last two events, which is all
that can depend on, or reach into, other parts. The summaries, a row a part, are gone through in order on the
driver: what is open where each part begins, and whether a part's last event goes on in the next. The second
stage folds every part with that. An event is given out by the part that has its last row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of the largest bucket that isn't cut, and of a part of those that are.
PART_ROWS, CUT_ROWS = 1_000_000, 250_000
#: Quantiles of a bucket's starts that are asked for at most; so many parts a bucket at most.
QUANTILES = 10_000
ROW = "bucket string, id long, start_ns long, end_ns long, data string, key string"


@dataclass(frozen=True)
class Fold:
    """What joins the open event: a row that starts up to ``limit`` after the furthest end so far (whenever, if None),
    of an equal key if ``by_key``.

    Durations add up if ``total``, else the end is the furthest. Gaps shorter than ``pulse`` are shared between
    neighbours. With ``label`` the rows come out instead, with the start of the event they joined, ``island``, and the
    furthest end of the run's rows before, ``before``.
    """

    limit: int | None
    by_key: bool
    total: bool = False
    pulse: int = 0
    label: bool = False

    @property
    def schema(self) -> str:
        return "bucket string, id long, start_ns long, end_ns long, data string" + (", island long, before long" if self.label else "")


@dataclass
class Context:
    """What a part's neighbours say: the open row where it begins, the end of the event before that, whether its last
    event is closed, and where the next one starts."""

    row: tuple | None = None
    before: int | None = None
    closes: bool = True
    next_start: int | None = None


def _schema():
    import pyarrow as pa

    return pa.schema([("bucket", pa.string()), ("id", pa.int64()), ("start_ns", pa.int64()), ("end_ns", pa.int64()), ("data", pa.string()), ("key", pa.string())])


def _changed(column) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    import pyarrow.compute as pc

    a, b = column.slice(1), column.slice(0, len(column) - 1)
    nulls = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.and_not(pc.fill_null(pc.not_equal(a, b), True), nulls), bool)


def furthest_before(end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest ``end`` among the earlier rows of a run; runs begin where ``first`` is true, and there it is the row's own."""
    values, rank = np.unique(end, return_inverse=True)
    run = np.cumsum(first) - 1
    so_far = np.maximum.accumulate(run * len(values) + rank) - run * len(values)
    before = values[so_far[:-1]]
    return np.where(first, end, np.concatenate([end[:1], before]))


def _parts_of(table, fold: Fold):
    """(first, starts, first row of each event, its end, furthest ends before) of sorted rows."""
    start, end = (np.asarray(table.column(c)) for c in ("start_ns", "end_ns"))
    new_bucket = np.concatenate([[True], _changed(table.column("bucket"))])
    first = new_bucket | np.concatenate([[True], _changed(table.column("key"))]) if fold.by_key else new_bucket
    before = furthest_before(end, first)
    opens = first if fold.limit is None else first | (start - before > fold.limit)
    at = np.flatnonzero(opens)
    ends = start[at] + np.add.reduceat(end - start, at) if fold.total else np.maximum.reduceat(end, at)
    return first, new_bucket, start, at, ends, before


def _half(gap: np.ndarray, pulse: int) -> np.ndarray:
    return np.where((gap >= 0) & (gap < pulse), gap // 2, 0)


def folded(batches: Iterator, fold: Fold, context: Context | None = None) -> Iterator:
    """The record batches that a fold gives for sorted batches of ``ROW``."""
    import pyarrow as pa

    context = context or Context()
    open_ = None if context.row is None else pa.table({f.name: pa.array([v], f.type) for f, v in zip(_schema(), context.row, strict=True)})
    before_open = context.before

    def given(rows, start, end, island=None, before=None):
        columns = [rows.column("bucket"), rows.column("id"), pa.array(start), pa.array(end), rows.column("data")]
        names = ["bucket", "id", "start_ns", "end_ns", "data"]
        if fold.label:
            columns, names = [*columns, pa.array(island), before], [*names, "island", "before"]
        return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        if not len(table):
            continue
        table = table.select(_schema().names).cast(_schema())
        carried = open_ is not None
        if carried:
            table = pa.concat_tables([open_, table])
        table = table.combine_chunks()
        first, new_bucket, start, at, ends, before = _parts_of(table, fold)
        n = len(at)
        if fold.label:
            own = slice(int(carried), None)
            of = start[at][np.searchsorted(at, np.arange(len(start)), "right") - 1]
            yield from given(table.slice(int(carried)), start[own], np.asarray(table.column("end_ns"))[own], of[own], pa.array(before[own], mask=first[own]))
        else:
            same = ~new_bucket[at[1:]]  # each event but the first follows one of its bucket
            if n > 1:
                left = np.concatenate([[-1 if before_open is None else start[at[0]] - before_open], np.where(same, start[at[1:]] - ends[:-1], -1)])[:-1]
                right = np.where(same, start[at[1:]] - ends[:-1], -1)
                closed = table.take(pa.array(at[:-1]))
                yield from given(closed, start[at[:-1]] - _half(left, fold.pulse), ends[:-1] + _half(right, fold.pulse))
                before_open = int(ends[-2]) if same[-1] else None
        end_column = table.schema.get_field_index("end_ns")
        # With labels the furthest end of the run counts for what follows, else that of the open event.
        furthest = int(max(before[-1], np.asarray(table.column("end_ns"))[-1])) if fold.label else int(ends[-1])
        open_ = table.slice(int(at[-1]), 1).set_column(end_column, "end_ns", pa.array([furthest]))
    if open_ is not None and context.closes and not fold.label:
        start, end = (np.asarray(open_.column(c)) for c in ("start_ns", "end_ns"))
        left = -1 if before_open is None else start - before_open
        right = -1 if context.next_start is None else context.next_start - end
        yield from given(open_, start - _half(np.asarray(left), fold.pulse), end + _half(np.asarray(right), fold.pulse))


# Parts of large buckets -----------------------------------------------------------------------------


def cut_points(rows: DataFrame, most: int, each: int | None = None) -> dict[str | None, np.ndarray]:
    """The starts at which each bucket of more than ``most`` rows is cut, into parts of ``each`` rows (``most``, if None). Runs a
    job, and a second one if there are such buckets. Rows of equal starts aren't parted."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    large = {r.bucket: r.n for r in counts.where(F.col("n") > most).collect()}  # there are rows / most of them at most
    if not large:
        return {}
    parts = {name: min(QUANTILES, -(-n // (each or most))) for name, n in large.items()}
    grain = min(QUANTILES, 50 * max(parts.values()))  # a part is off by a few hundredths of its rows
    shares = [k / grain for k in range(1, grain)]
    found = rows.join(counts.where(F.col("n") > most).select(F.col("bucket").alias("of")), F.col("bucket").eqNullSafe(F.col("of")))
    asked = found.groupBy("bucket").agg(F.percentile_approx("start_ns", shares, grain).alias("q"))
    out = {r.bucket: np.unique([r.q[k * grain // parts[r.bucket] - 1] for k in range(1, parts[r.bucket])]) for r in asked.collect()}
    return out


def no_cuts(*frames: DataFrame, most: int | None = None) -> int | None:
    """The ``span`` for operators on these frames and on what is made of them: 0 if no bucket has more than ``most`` rows in them
    together, so that nothing need be counted again, else None. Runs a job when called."""
    names = frames[0].select("bucket")
    for f in frames[1:]:
        names = names.unionAll(f.select("bucket"))
    return 0 if (names.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0) <= (most or PART_ROWS) else None


def spans(rows: DataFrame, span: int) -> dict[str | None, np.ndarray]:
    """Cut points every ``span`` nanoseconds, for each bucket."""
    reach = rows.groupBy("bucket").agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi")).collect()
    return {r.bucket: np.arange(r.lo // span + 1, r.hi // span + 1) * span for r in reach}


def with_part(rows: DataFrame, cuts: dict[str | None, np.ndarray], whole: bool = False) -> DataFrame:
    """Add ``part``, numbered over all cut buckets, -1 for rows of others, and ``own``, true. If ``whole``, a row stands in each part
    that it reaches into, and is its own where it starts."""
    first = dict(zip(cuts, np.cumsum([0, *(len(c) + 1 for c in cuts.values())])[:-1].tolist(), strict=True))
    sent = rows.sparkSession.sparkContext.broadcast((cuts, first))

    def part_at(buckets, at):
        import pyarrow as pa

        cuts, base = sent.value
        coded = buckets.dictionary_encode(null_encoding="encode")
        names, codes, at = coded.dictionary.to_pylist(), np.asarray(coded.indices), np.asarray(at)
        out = np.full(len(at), -1)
        for k in (k for k, name in enumerate(names) if name in cuts):
            mine = codes == k
            out[mine] = base[names[k]] + np.searchsorted(cuts[names[k]], at[mine], "right")
        return pa.array(out, pa.int64())

    part = F.arrow_udf(part_at, "long")
    rows = rows.withColumn("part", part("bucket", "start_ns"))
    if not whole:
        return rows.withColumn("own", F.lit(True))
    last = F.when(F.col("part") < 0, -1).otherwise(part("bucket", F.greatest(F.col("end_ns") - 1, "start_ns")))
    rows = rows.withColumn("_last", last).withColumn("_in", F.explode(F.sequence("part", F.col("_last"))))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("part", "_last", "_in")), F.col("_in").alias("part"), (F.col("_in") == F.col("part")).alias("own"))


def in_parts(parted: DataFrame, cuts: dict[str | None, np.ndarray], *order: str | Column) -> DataFrame:
    """The rows of cut buckets, those of a part in one partition and in ``order``; partitions are as many as a shuffle has at most."""
    n = min(sum(len(c) + 1 for c in cuts.values()), int(parted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parted.where("part >= 0").repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", *order)


def by_part(batches: Iterator) -> Iterator:
    """(part, its tables) of sorted batches with a column ``part``; the tables are to be gone through in turn."""
    import pyarrow as pa

    def slices():
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if len(table):
                at = [0, *(np.flatnonzero(_changed(table.column("part"))) + 1).tolist(), len(table)]
                yield from ((table.column("part")[a].as_py(), table.slice(a, b - a)) for a, b in zip(at, at[1:], strict=False))

    for part, own in groupby(slices(), key=lambda x: x[0]):
        yield part, (t for _, t in own)


SUMMARY = "part long, bucket string, head_key string, head_start long, one_run boolean, id long, start_ns long, end_ns long, data string, key string, before_start long, before_end long, before_in_head boolean"


ORDER = ("start_ns", "id", "data")


def _summary(part: int, tables: Iterator, fold: Fold) -> dict:
    """What ``contexts`` needs to know of a part: one pass that holds its open event."""
    import pyarrow as pa

    open_, head, in_head = None, None, True
    previous = (None, None, None)  # start and end of the event before the open one, and whether it is of the first run
    for table in tables:
        table = table.select(_schema().names).cast(_schema())
        if open_ is not None:
            table = pa.concat_tables([open_, table])
        table = table.combine_chunks()
        first, _, start, at, ends, before = _parts_of(table, fold)
        if head is None:
            head = (table.column("key")[0].as_py(), int(start[0]))
        of_first = in_head & (np.cumsum(first) == 1)
        if len(at) > 1:
            previous = (int(start[at[-2]]), int(ends[-2]), bool(of_first[at[-2]]))
        in_head = bool(of_first[-1])
        end = int(max(before[-1], np.asarray(table.column("end_ns"))[-1])) if fold.label else int(ends[-1])
        open_ = table.slice(int(at[-1]), 1).set_column(table.schema.get_field_index("end_ns"), "end_ns", pa.array([end]))
    last = open_.to_pylist()[0]
    own = {c: last[c] for c in ("id", "start_ns", "end_ns", "data", "key")}
    return {"part": part, "bucket": last["bucket"], "head_key": head[0], "head_start": head[1], "one_run": in_head, **own, **dict(zip(("before_start", "before_end", "before_in_head"), previous, strict=True))}


def summaries(sorted_parts: DataFrame, fold: Fold) -> DataFrame:
    """A row of ``SUMMARY`` for each part: its first run, and its last event and the one before."""

    def run(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SUMMARY.split(", ")])
        for part, tables in by_part(batches):
            yield from pa.Table.from_pylist([_summary(part, tables, fold)], schema).to_batches()

    return sorted_parts.mapInArrow(run, SUMMARY)


def contexts(summed: list, fold: Fold) -> dict[int, Context]:
    """The context of each part, from the summaries of all."""
    out: dict[int, Context] = {}
    carry, before, previous = None, None, None  # the open row, the end of the event before it, and the part they are of
    near = lambda start, end: fold.limit is None or start - end <= fold.limit
    for s in sorted(summed, key=lambda s: s.part):
        context = out[s.part] = Context()
        own = (s.bucket, s.id, s.start_ns, s.end_ns, s.data, s.key)
        if carry is None or carry[0] != s.bucket:
            carry, before = own, s.before_end
            previous = context
            continue
        furthest = carry[3]
        joins = (not fold.by_key or carry[5] == s.head_key) and near(s.head_start, furthest)
        previous.closes, previous.next_start = not joins, s.head_start
        context.row, context.before = (carry, before) if joins else (None, furthest)
        if fold.label:
            # Labels go on over gaps of a run, as the furthest end does.
            same_run = not fold.by_key or carry[5] == s.head_key
            context.row = carry if same_run else None
        if joins and s.one_run and near(s.start_ns, furthest):
            end = furthest + s.end_ns - s.start_ns if fold.total else max(furthest, s.end_ns)
            carry = (*carry[:3], end, *carry[4:])
        else:
            swallowed = joins and s.before_in_head and near(s.before_start, furthest)
            before = furthest if s.before_end is None else max(furthest, s.before_end) if swallowed else s.before_end
            if fold.label and s.one_run and (not fold.by_key or carry[5] == s.key):
                own = (*own[:3], max(furthest, s.end_ns), *own[4:])
            carry = own
        previous = context
    return out


def fold_events(events: DataFrame, key: Column | None, fold: Fold, span: int | None = None, most: int | None = None) -> DataFrame:
    """What a fold gives for a frame of events; ``key`` is what ``by_key`` compares.

    The frame is written and rows a bucket are counted when this is called, and large buckets are summed up;
    ``span`` cuts every bucket into spans of so many nanoseconds instead (0: none is cut).
    """
    rows = events.select("bucket", "id", "start_ns", "end_ns", "data", (F.lit(None).cast("string") if key is None else key).alias("key"))
    cuts = {}
    if span != 0:
        rows = written(rows)
        cuts = spans(rows, span) if span else cut_points(rows, most or PART_ROWS, None if most else CUT_ROWS)

    def run(batches):
        return folded(batches, fold)

    def small(df: DataFrame) -> DataFrame:
        ordered = df.repartition("bucket").sortWithinPartitions("bucket", *ORDER)
        return ordered.mapInArrow(run, fold.schema)

    if not cuts:
        return small(rows)
    parted = with_part(rows, cuts).drop("own")
    large = in_parts(parted, cuts, *ORDER)
    known = contexts(summaries(large, fold).collect(), fold)  # a row a part
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run_part(batches):
        for part, tables in by_part(batches):
            yield from folded(tables, fold, sent.value[part])

    return large.mapInArrow(run_part, fold.schema).unionByName(small(parted.where("part < 0").drop("part")))
