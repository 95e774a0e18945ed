"""Interval joins by sorted starts.

Of two intervals that share more than a point, one starts within the other. So the pairs of a bucket are, for each
left row, the right rows that start within it, and for each right row, the left rows that start after it and
within it: two ranges of places in sorted starts, found by binary search. The work is that of sorting and of the
pairs there are, however dense or sparse a bucket is and wherever it is so.

A bucket whose sides have more rows than ``folds.PART_ROWS`` is cut at quantiles of its own starts. A row then stands in
every part that it reaches into, and a pair counts where the later of the two starts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import folds

#: Rows that are matched together, of as many buckets as they are of, and pairs that are given out together.
TOGETHER, PAIRS = 50_000, 100_000


def _ranges(lo: np.ndarray, hi: np.ndarray):
    """(row, place) chunks: each row with each place of its range [lo, hi)."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        some = n[a:b]
        # A row with more pairs than are given out together is gone through by itself.
        for x in range(0, max(1, int(some.sum())) if b == a + 1 else 1, PAIRS):
            if b == a + 1:
                places = np.arange(lo[a] + x, min(lo[a] + x + PAIRS, hi[a]))
                yield np.full(len(places), a), places
            else:
                rows = np.repeat(np.arange(a, b), some)
                yield rows, np.arange(len(rows)) - np.repeat(ends[a:b] - some - base, some) + lo[rows]
        a = b


def matches(group: np.ndarray, left: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray):
    """(left rows, right rows) chunks of the pairs that meet, each once, among rows of a group that are ``left`` or not."""
    values, rank = np.unique(np.concatenate([start, end]), return_inverse=True)
    base = group * len(values)
    start, end = base + rank[: len(start)], base + rank[len(start) :]
    sides = []
    for side in (left, ~left):
        at = np.flatnonzero(side)
        at = at[np.argsort(start[at], kind="stable")]
        sides.append((at, start[at], end[at]))
    (a, a_start, a_end), (b, b_start, b_end) = sides
    for rows, places in _ranges(np.searchsorted(b_start, a_start), np.searchsorted(b_start, a_end)):
        keep = own[b[places]]
        yield a[rows[keep]], b[places[keep]]
    for rows, places in _ranges(np.searchsorted(a_start, b_start, "right"), np.searchsorted(a_start, b_end)):
        keep = own[a[places]]
        yield a[places[keep]], b[rows[keep]]


def join(left: DataFrame, right: DataFrame, by: str = "bucket", most: int | None = None, small: bool = False) -> DataFrame:
    """Pairs of rows whose intervals share more than a point, as left's columns and right's with ``r_``.

    A right row without length meets the left rows that it lies in or at the start of; left rows without length meet none.
    Both sides are written, and their rows a bucket counted, when this is called, unless they are said to be ``small``.
    """
    sides = []
    for df, name, other in ((left.where("end_ns > start_ns"), "l", right), (right, "r", left)):
        box, none = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), F.lit(None).cast(other.select(F.struct(*(F.col(f"`{c}`") for c in other.columns))).schema[0].dataType)
        own = [F.col(by).cast("string").alias("bucket"), "start_ns", "end_ns", F.lit(name == "l").alias("left")]
        sides.append(df.select(*own, *([box, none.alias("r")] if name == "l" else [none.alias("l"), box])))
    both = sides[0].unionByName(sides[1])
    cuts = {}
    if not small:
        both = written(both)
        cuts = folds.cut_points(both, most or folds.PART_ROWS)
    both = folds.with_part(both, cuts, whole=True) if cuts else both.withColumns({"part": F.lit(-1).cast("long"), "own": F.lit(True)})

    def run(batches):
        import pyarrow as pa

        def pairs(table):
            table = table.combine_chunks()
            change = folds._changed(table.column("bucket")) | folds._changed(table.column("part"))
            group = np.cumsum(np.concatenate([[False], change]))
            left, start, end, own = (np.asarray(table.column(c)) for c in ("left", "start_ns", "end_ns", "own"))
            for a, b in matches(group, left.astype(bool), start, end, own.astype(bool)):
                if len(a):
                    yield from pa.Table.from_arrays([table.column("l").take(pa.array(a)), table.column("r").take(pa.array(b))], names=["l", "r"]).combine_chunks().to_batches()

        held, n = [], 0  # batches since the last group that was matched
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            if not len(batch):
                continue
            # Where the last group of all rows so far begins in this batch, -1 if before it.
            keys = pa.concat_tables([*(t.slice(len(t) - 1) for t in held[-1:]), batch]).select(["bucket", "part"])
            change = np.flatnonzero(folds._changed(keys.column("bucket")) | folds._changed(keys.column("part")))
            begins = int(change[-1]) + (0 if held else 1) if len(change) else -1
            held.append(batch)
            n += len(batch)
            if n >= TOGETHER and begins >= 0:
                yield from pairs(pa.concat_tables([*held[:-1], batch.slice(0, begins)]))
                held = [batch.slice(begins)]
                n = len(held[0])
        if n:
            yield from pairs(pa.concat_tables(held))

    types = both.schema
    found = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, f"l {types['l'].dataType.simpleString()}, r {types['r'].dataType.simpleString()}")
    return found.select("l.*", *(F.col("r").getField(c).alias(f"r_{c}") for c in right.columns))
