"""Interval operators against plain walks on random overlapping input, whole and cut into parts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanlake.operators import folds, intervals, sweep
from spanlake.schema import EVENT_DDL, SECOND


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_DDL)


def got(df):
    return sorted((r.bucket or "", -1 if r.id is None else r.id, r.start_ns, r.end_ns, r.data) for r in df.collect())


def intersected(events, periods):
    """One walk along both sides; what is left of an event or a period is compared next."""
    out, periods = [], sorted(periods, key=lambda p: p[1])
    k = 0
    for i, s, e, d in sorted(events, key=lambda x: (x[1], x[0])):
        while s < e and k < len(periods):
            _, a, b, _ = periods[k]
            if e <= a:
                break
            if s >= b:
                k += 1
                continue
            out.append((i, max(s, a), min(e, b), d))
            s = min(e, b)
    return out


def united(first, second):
    """The heads of both lists are compared until one has no more."""
    first, second, out = list(first), list(second), []
    while first and second:
        a, b = first[0], second[0]
        if max(a[1], b[1]) < min(a[2], b[2]):
            if a[1] <= b[1]:
                out.append(first.pop(0))
                second[:1] = [(None, a[2], b[2], b[3])] if a[2] < b[2] else []
            else:
                out.append((None, b[1], a[1], b[3]))
                second[0] = (None, a[1], b[2], b[3])
        else:
            out.append(first.pop(0) if a[1] <= b[1] else second.pop(0))
    return out + first + second


def lists(seed, n, reach, lengths, names="xyz"):
    """Random rows of two buckets and one of null: {bucket: [(id, start, end, data)]}, in order."""
    rng = random.Random(seed)
    out = {}
    for bucket in ("a", "b", None):
        rows = [(s, s + rng.choice(lengths), rng.choice(names)) for s in (rng.randrange(reach) for _ in range(n))]
        out[bucket] = [(i, *r) for i, r in enumerate(sorted(rows))]
    return out


def flat(found):
    return sorted((b or "", -1 if i is None else i, s, e, d) for b, rows in found.items() for i, s, e, d in rows)


def table(spark, found):
    return frame(spark, [(b, *r) for b, rows in found.items() for r in rows]).repartition(3)


LENGTHS = [[0, 1, 3, 9, 30], [1, 2], [5, 40, 80], [0]]


@pytest.mark.parametrize("span", [None, 40])
@pytest.mark.parametrize("seed", range(4))
def test_intersections_of_overlapping_sides(spark, seed, span):
    ev, per = lists(seed, 60, 300, LENGTHS[seed]), lists(9 + seed, 40, 300, LENGTHS[(seed + 1) % 4 if seed else 0])
    out = intervals.period_intersect_consumed(table(spark, ev), table(spark, per), span)
    assert got(out) == flat({b: intersected(ev[b], per[b]) for b in ev})


def test_known_intersections(spark):
    case = lambda e, f: sorted((r.start_ns, r.end_ns, r.data) for r in intervals.period_intersect_consumed(frame(spark, [("b", i, *x) for i, x in enumerate(e)]), frame(spark, [("b", i, *x, "f") for i, x in enumerate(f)])).collect())
    assert case([(4, 16, "b"), (12, 14, "a")], [(0, 14)]) == [(4, 14, "b")]
    assert case([(2, 12, "b")], [(8, 8)]) == [(8, 8, "b")]
    assert case([(12, 26, "b")], [(2, 16), (16, 16)]) == [(12, 16, "b")]
    assert case([(0, 20, "x"), (1, 30, "y")], [(0, 10), (5, 25)]) == [(0, 10, "x"), (5, 25, "y"), (10, 20, "x")]
    assert case([], [(0, 1)]) == case([(0, 1, "a")], []) == []


@pytest.mark.parametrize("span", [None, 40])
@pytest.mark.parametrize("seed", range(4))
def test_unions_of_overlapping_sides(spark, seed, span):
    one, two = lists(20 + seed, 50, 300, LENGTHS[seed]), lists(30 + seed, 50, 300, LENGTHS[(seed + 2) % 4])
    out = intervals.union_no_overlap(table(spark, one), table(spark, two), span=span)
    assert got(out) == flat({b: united(one[b], two[b]) for b in one})


def test_unions_of_dense_sides_in_parts(spark):
    """Nothing is apart from anything, so that the bucket would be one stretch; and a head that is held over many parts."""
    one = {"a": [(i, 10 * i, 10 * i + 10, "x") for i in range(100)], "b": [(1, 5, 900, "x"), (2, 880, 890, "x")]}
    two = {"a": [(i, 7 * i + 3, 7 * i + 10, "y") for i in range(140)], "b": [(1, 0, 2000, "y")] + [(i, 6 * i, 6 * i + 9, "y") for i in range(2, 150)]}
    out = intervals.union_no_overlap(table(spark, one), table(spark, two), span=150)
    assert got(out) == flat({b: united(one[b], two[b]) for b in one})
    assert "island" not in out._jdf.queryExecution().toString()


def test_events_cut_at_the_next_start_in_parts(spark):
    ev = lists(50, 60, 300, [0, 1, 9, 120])
    want = {b: [(i, s, min(e, n), d) for (i, s, e, d), n in zip(rows, [*(r[1] for r in rows[1:]), 1 << 62], strict=True) if min(e, n) > s] for b, rows in ev.items()}
    for span in (None, 40):
        assert got(intervals.without_overlaps(table(spark, ev), span)) == flat(want)


@pytest.mark.parametrize("span", [None, 40])
def test_unions_that_take_from_all(spark, span):
    one, two = lists(5, 30, 300, [0, 4, 20]), lists(6, 40, 300, [0, 3, 50])
    one["b"] = []
    want = {}
    for b, rows in two.items():
        want[b] = list(one[b])
        for i, s, e, d in rows:
            free = [t for t in range(s, e) if not any(x <= t < y for _, x, y, _ in one[b])]
            cuts = [k for k in range(1, len(free)) if free[k] > free[k - 1] + 1]
            pieces = [free[x:y] for x, y in zip([0, *cuts], [*cuts, len(free)], strict=True) if free]
            want[b] += [(i, s, e, d)] if s == e else [(i if len(p) == e - s else None, p[0], p[-1] + 1, d) for p in pieces]
    assert got(intervals.union_no_overlap(table(spark, one), table(spark, two), strict=False, span=span)) == flat(want)


@pytest.mark.parametrize("most", [None, 15])
def test_pairs_by_sorted_starts(spark, monkeypatch, most):
    monkeypatch.setattr(sweep, "PAIRS", 7)
    left, right = lists(40, 80, 300, [0, 1, 9, 120]), lists(41, 50, 300, [0, 2, 60])
    out = sweep.join(table(spark, left), table(spark, right).withColumn("more", F.lit("m")), most=most)
    want = sorted((b or "", i, j) for b in left for i, s, e, _ in left[b] for j, x, y, _ in right[b] if s < e and ((x < e and y > s) if y > x else s <= x < e))
    assert out.columns == ["bucket", "id", "start_ns", "end_ns", "data", "r_bucket", "r_id", "r_start_ns", "r_end_ns", "r_data", "r_more"]
    assert sorted((r.bucket or "", r.id, r.r_id) for r in out.collect()) == want
    assert sweep.join(table(spark, left).limit(0), table(spark, right)).count() == 0


@pytest.mark.parametrize("span", [1, 7, 40])
def test_parts_of_any_size(spark, span):
    """Runs that go on over many parts, and parts that a long event covers."""
    rng = random.Random(span)
    rows = [(s, s + rng.choice([0, 1, 2, 3, 150]), rng.choice("xxxxxxy")) for s in (rng.randrange(500) for _ in range(120))]
    df = frame(spark, [("b", i, s, e, f'"{d}"') for i, (s, e, d) in enumerate(sorted(rows))])
    for op in (lambda d, x: intervals.flood(d, 6, x), lambda d, x: intervals.heartbeat_merge(d, 2, x), lambda d, x: intervals.period_union(d, span=x), lambda d, x: intervals.furthest(d, x).withColumn("data", F.col("before").cast("string")).drop("before")):
        assert got(op(df, span)) == got(op(df, 0))
    keyed = df.withColumn("data", F.concat(F.lit('{"k":'), F.col("data"), F.lit(',"n":'), F.col("id"), F.lit("}")))
    assert got(intervals.chunk_by_key(keyed, "k", span)) == got(intervals.chunk_by_key(keyed, "k", 0))


def test_parts_are_never_held_whole(spark, monkeypatch):
    """A part goes through Python batch by batch."""
    monkeypatch.setattr(folds, "PART_ROWS", 400)
    monkeypatch.setattr(folds, "CUT_ROWS", 100)
    n = 1000
    df = spark.range(n).select(F.lit("b").alias("bucket"), "id", (F.col("id") * 3).alias("start_ns"), (F.col("id") * 3 + 1).alias("end_ns"), F.concat(F.lit('{"a":'), F.floor(F.col("id") / 7) % 3, F.lit("}")).alias("data"))
    out = intervals.flood(df, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert got(out) == got(intervals.flood(df, 5, span=0))
    assert 8 <= len(folds.cut_points(df, folds.PART_ROWS, folds.CUT_ROWS)["b"]) + 1 <= 12


def test_three_million_rows_in_a_bucket(spark, monkeypatch):
    n = 3_000_000
    df = spark.range(n).select(F.lit("b").alias("bucket"), "id", (F.col("id") * SECOND).alias("start_ns"), (F.col("id") * SECOND + F.when(F.col("id") % 1000 == 0, 1500 * SECOND).otherwise(SECOND // 2)).alias("end_ns"), F.concat(F.lit('{"a":'), F.floor(F.col("id") / 7) % 3, F.lit("}")).alias("data"))
    assert len(folds.cut_points(df, folds.PART_ROWS)["b"]) == 2
    began = time.perf_counter()
    by = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("id", "start_ns", "end_ns", "data") % 1000)).first()
    parted = by(intervals.flood(df))
    took = time.perf_counter() - began
    assert parted == by(intervals.flood(df, span=0)) and took < 300


def test_dense_and_sparse_buckets(spark):
    dense = spark.range(60_000).select(F.lit("dense").alias("bucket"), "id", (F.col("id") * 1000).alias("start_ns"), (F.col("id") * 1000 + 50).alias("end_ns"), F.lit("e").alias("data"))
    sparse = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 100).alias("bucket"), "id", (F.col("id") * 10**15).alias("start_ns"), (F.col("id") * 10**15 + 10**14).alias("end_ns"), F.lit("e").alias("data"))

    def timed(df):
        began = time.perf_counter()
        n = intervals.period_intersect(df, df).count()
        return n, time.perf_counter() - began

    timed(dense)
    (n, alone), (both, mixed) = timed(dense), timed(dense.unionByName(sparse))
    assert n == 60_000 and both == 61_000 and mixed < 3 * alone + 3
