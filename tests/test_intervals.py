"""Operators on small frames: known cases, random comparison with plain folds, and both window plans."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions.patterns import DEFAULT_CATEGORIES, Rule, read_classes, write_classes
from spanlake.functions.patterns import rule as read_rule
from spanlake.operators import intervals, prefix, rows
from spanlake.plans import reports
from spanlake.schema import EVENT_DDL, SECOND
from spanlake.sources import buckets


def frame(spark, events, bucket="b"):
    return spark.createDataFrame([(bucket, i, s, e, d) for i, (s, e, d) in enumerate(events)], EVENT_DDL)


def got(df):
    return sorted((r.start_ns, r.end_ns, r.data) for r in df.collect())


def merged(events, pulse, touching):
    out = []
    for s, e, d in sorted(events, key=lambda x: x[0]):
        gap = s - out[-1][1] if out else None
        if out and out[-1][2] == d and (gap <= pulse if touching else gap < pulse):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, d])
    return out


def flooded(events, pulse):
    out = merged(events, pulse, False)
    ends = [(s, e) for s, e, _ in out]
    for k in range(len(out) - 1):
        gap = ends[k + 1][0] - ends[k][1]
        if 0 <= gap < pulse:
            out[k][1] += gap // 2
            out[k + 1][0] -= gap // 2
    return sorted(map(tuple, out))


def random_events(seed, n=150):
    rng = random.Random(seed)
    return [(s, s + rng.choice([0, 1, 3, 9, 30]), rng.choice("xyz")) for s in (rng.randrange(600) for _ in range(n))]


@pytest.mark.parametrize("span", [None, 40])
def test_flood_and_heartbeats_match_folds(spark, span):
    events = random_events(1)
    df = frame(spark, events)
    assert got(intervals.flood(df, 5, span)) == flooded(events, 5)
    assert got(intervals.heartbeat_merge(df, 4, span)) == sorted(map(tuple, merged(events, 4, True)))


@pytest.mark.parametrize("span", [None, 40])
def test_period_union(spark, span):
    events = random_events(2, 60)
    out = []
    for s, e, _ in sorted(events):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    assert got(intervals.period_union(frame(spark, events), span=span)) == [(s, e, "{}") for s, e in out]


def test_flood_known_cases(spark):
    s = 1_000_000_000
    case = lambda *x: got(intervals.flood(frame(spark, [(a * s, (a + b) * s, d) for a, b, d in x])))
    assert case((0, 1, "a"), (3, 1, "a")) == [(0, 4 * s, "a")]
    assert case((0, 1, "a"), (3, 1, "b")) == [(0, 2 * s, "a"), (2 * s, 4 * s, "b")]
    assert case((0, 10, "a"), (1, 5, "b")) == [(0, 10 * s, "a"), (s, 6 * s, "b")]
    assert case((0, 10, "a"), (5, 10, "a")) == [(0, 15 * s, "a")]


def test_intersect_and_union_no_overlap(spark):
    ev = frame(spark, [(10, 20, "a"), (20, 30, "a"), (30, 40, "a")])
    assert got(intervals.period_intersect(ev, frame(spark, [(15, 35, "f")]), width=7)) == [(15, 20, "a"), (20, 30, "a"), (30, 35, "a")]
    assert got(intervals.union_no_overlap(frame(spark, [(10, 20, "a")]), frame(spark, [(0, 30, "b")]))) == [(0, 10, "b"), (10, 20, "a"), (20, 30, "b")]
    quirk = frame(spark, [(6, 22, "a")]), frame(spark, [(12, 16, "x"), (16, 32, "y")])
    assert got(intervals.union_no_overlap(*quirk)) == [(6, 22, "a"), (16, 32, "y")]
    assert got(intervals.union_no_overlap(*quirk, strict=False)) == [(6, 22, "a"), (22, 32, "y")]
    empty = frame(spark, [(1, 2, "a")]).limit(0)
    assert got(intervals.union_no_overlap(empty, ev)) == got(ev) and got(intervals.flood(empty)) == []


def test_payload_types_and_rules(spark):
    df = frame(spark, [(0, 1, '{"test":1}'), (1, 2, '{"test":1.0,"x":"just a test"}'), (2, 3, '{"test":"1"}'), (3, 4, '{"o":2}')])
    assert [x[0] for x in got(rows.filter_keyvals(df, "test", [1]))] == [0, 1]
    assert [x[0] for x in got(rows.exclude_keyvals(df, "test", [1]))] == [2, 3]
    assert [x[0] for x in got(rows.filter_regex(df, "test", "1"))] == [2]
    out = rows.categorize(df, [(["T"], Rule("test")), (["T", "S"], Rule("JUST", True, ("x",)))]).orderBy("id").collect()
    assert [r.category for r in out] == [["Uncategorized"], ["T", "S"], ["Uncategorized"], ["Uncategorized"]]
    with pytest.raises(ValueError):
        Rule("a", keys=())


def test_equal_payloads_in_any_notation(spark):
    df = frame(spark, [(0, 1, '{"a":1,"b":[2]}'), (2, 3, '{ "b": [2], "\\u0061": 1 }'), (4, 5, '{"a":1}'), (6, 7, "no json"), (8, 9, "no json")])
    assert got(intervals.flood(df, 5)) == [(0, 3, '{"a":1,"b":[2]}'), (3, 5, '{"a":1}'), (5, 9, "no json")] or got(intervals.flood(df, 5)) == [(0, 3, '{"a":1,"b":[2]}'), (4, 5, '{"a":1}'), (6, 9, "no json")]
    again = frame(spark, [(0, 1, '{"b": [2], "a": 1}'), (0, 2, '{"a":1,"b":[2]}')])
    assert got(buckets.import_new(again, df)) == [(0, 2, '{"a":1,"b":[2]}')]


def test_numbers_compare_by_value(spark):
    texts = ["1e3", "1000", "1000.0", '"1000"', "true", "1e-7", "0.0000001", "[1]", "1", "9007199254740993"]
    df = frame(spark, [(i, i, f'{{"v": {x}}}') for i, x in enumerate(texts)])
    kept = lambda *values: [x[0] for x in got(rows.filter_keyvals(df, "v", list(values)))]
    assert kept(1000) == kept(1e3) == [0, 1, 2] and kept(1e-7) == [5, 6] and kept(True) == [4] and kept("1000") == [3]
    assert kept(1) == [8] and kept([1]) == [7] and kept(9007199254740993) == [9] and kept(1, "x", [1]) == [7, 8]


def test_redaction_of_any_notation(spark):
    rule = {"pattern": "^secret$", "action": "redact", "field": "app", "replacement": "x"}
    texts = ['{"app": "secret"}', '{"a\\u0070p":"secret"}', '{"app":"secret","o":{"app":"secret"}}', '{"app":"other"}', '{"app": 1}', "not json", "[]", '{"app":"secret","b":"\\"app\\":\\"secret\\""}']
    df = frame(spark, [(i, i, x) for i, x in enumerate(texts)])
    want = ['{"app":"x"}', '{"app":"x"}', '{"app":"x","o":{"app":"secret"}}', '{"app":"other"}', '{"app": 1}', '{"app":"x","b":"\\"app\\":\\"secret\\""}']
    assert [x[2] for x in got(buckets.redact(df, [rule]))] == want  # what can't be read is dropped
    nested = buckets.redact(df, [rule | {"field": "o.app"}])
    assert got(nested)[2][2] == '{"app":"secret","o":{"app":"x"}}' and len(got(nested)) == 6
    assert len(got(buckets.redact(df, [rule | {"bucket_prefix": "other"}]))) == len(texts)
    for bad in ({"field": None}, {"replacement": ""}, {"action": "hide"}):
        with pytest.raises(ValueError):
            buckets.redact(df, [rule | bad])


def test_sync_resumes_at_the_event_that_starts_last(spark):
    source = frame(spark, [(0, 100, "long"), (10, 20, "a"), (20, 30, "b"), (20, 20, "zero"), (40, 50, "c")])
    dest = frame(spark, [(0, 100, "long"), (10, 20, "a")], "b-synced-from-x")
    assert got(buckets.sync(source, dest, "x")) == [(20, 20, "a"), (20, 20, "zero"), (20, 30, "b"), (20, 100, "long"), (40, 50, "c")]
    dest = frame(spark, [(10, 20, "a")], "b-synced-from-x")
    source = frame(spark, [(10, 20, "a"), (20, 30, "b")])
    assert got(buckets.sync(source, dest, "x")) == [(20, 30, "b")]
    assert got(buckets.sync(frame(spark, [(10, 25, "a")]), dest, "x")) == [(20, 25, "a")]
    assert got(buckets.sync(source, dest.limit(0), "x")) == got(source) and got(buckets.sync(source, dest.limit(0), "x", since=25)) == [(25, 30, "b")]


def test_export_documents(spark, tmp_path):
    s = 1_000_000_000
    df = frame(spark, [(1, s + 500, '{"a": 1}'), (946684800 * s + 123456789, 946684801 * s + 1, '{"b":"x"}'), (-s - 1, 5, "{}")])
    out = buckets.export(df)
    assert sorted(r.event for r in out.collect())[-1] == '{"id":2,"timestamp":"1969-12-31T23:59:58.999999999Z","duration":1.000000006,"data":{}}'
    assert got(buckets.read_export(out)) == sorted([(1, s + 500, '{"a":1}'), (946684800 * s + 123456789, 946684801 * s + 1, '{"b":"x"}'), (-s - 1, 5, "{}")])
    text = '{"buckets":{"w":{"id":"w","type":"window","client":"c","hostname":"h","created":"2020-01-01T00:00:00Z","data":{"k":1},"events":[{"timestamp":"2000-01-01T00:00:00.5+01:00","duration":1.5,"data":{"t":"x"}},{"data":2},{"timestamp":"no","data":{}}]},"e":{"type":"t","client":"c","hostname":"h","events":[]}}}'
    catalog, events = buckets.read_document(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.bucket, r.type, r.data) for r in catalog.collect()) == [("e", "t", "{}"), ("w", "window", '{"k":1}')]
    start = (946684800 - 3600) * s + s // 2
    assert got(events) == [(start, start + 3 * s // 2, '{"t":"x"}')]
    bad = spark.createDataFrame([("b", "nonsense"), ("b", '{"timestamp":"2000-01-01T00:00:00Z","data":{}}')], "bucket string, event string")
    assert sorted(str(r.bad) for r in buckets.read_export(bad, kept="bad").collect()) == ["None", "nonsense"]
    buckets.write(df, f"{tmp_path}/t")
    assert got(buckets.read(spark, f"{tmp_path}/t")) == got(df)


def test_catalog(spark):
    empty = spark.createDataFrame([], buckets.CATALOG_DDL)
    catalog = buckets.create_bucket(buckets.create_bucket(empty, "a", "t", "c", "unknown"), "b", "t", "c", "h", "2020-01-01")
    with pytest.raises(ValueError):
        buckets.create_bucket(catalog, "a", "t", "c", "h")
    for missing in (lambda: buckets.delete_bucket(catalog, empty, "x"), lambda: buckets.rename(catalog, empty, "x", "y"), lambda: buckets.bucket(catalog, "x")):
        with pytest.raises(KeyError):
            missing()
    with pytest.raises(ValueError):
        buckets.rename(catalog, frame(spark, [(0, 1, "x")], "a"), "a", "b")
    assert buckets.bucket(catalog, "b").first().hostname == "h"
    left, events = buckets.delete_bucket(catalog, frame(spark, [(0, 1, "x")], "a"), "a")
    assert [r.bucket for r in left.collect()] == ["b"] and events.count() == 0
    assert buckets.with_ids(frame(spark, [(5, 6, "y"), (1, 2, "x")]), 10).orderBy("id").select("id", "start_ns").collect() == [(11, 1), (12, 5)]
    synced = buckets.synced_buckets(catalog, "dev", ["a"]).first()
    assert (synced.bucket, synced.hostname, synced.data) == ("a-synced-from-dev", "dev", '{"$aw.sync.origin":"dev"}')


def test_remotes(spark, tmp_path):
    for device in ("one", "two", "me"):
        buckets.write(frame(spark, [(0, 1, "x")]), f"{tmp_path}/device={device}/events")
    assert buckets.remotes(spark, str(tmp_path), "me") == ["one", "two"]


def test_classes_as_text():
    classes = [(["A", "B"], Rule("x\"\\d", True, ("t",))), (["C"], Rule()), (["D"], Rule("y"))]
    assert read_classes(write_classes(classes)) == classes and read_classes(write_classes(DEFAULT_CATEGORIES)) == DEFAULT_CATEGORIES
    for bad in ({"regex": "x"}, {"type": "other"}, {"type": "regex"}, {"type": "regex", "regex": "x", "ignore_case": 1}, {"type": "regex", "regex": "x", "select_keys": "t"}, {"type": "regex", "regex": "x", "select_keys": []}):
        with pytest.raises(ValueError):
            read_rule(bad)


def test_dense_buckets_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SPANS", (400, 40, 4))
    df = frame(spark, random_events(9, 300))
    assert prefix.span_for(df, most=300) == 0 and prefix.span_for(df, most=250) == 400 and prefix.span_for(df, most=60) == 40 and prefix.span_for(df, most=1) == 4
    assert got(intervals.flood(df, 5, prefix.span_for(df, most=30))) == flooded(random_events(9, 300), 5)


def test_dense_intersections(spark):
    rng = random.Random(2)
    events = [(s, s + rng.choice([0, 1, 500]), "e") for s in (rng.randrange(3000) for _ in range(400))]
    periods = [(10 * k, 10 * k + rng.choice([3, 7]), "p") for k in range(300)]
    want = sorted((max(s, a), min(e, b), "e") for s, e, _ in events for a, b, _ in periods if s < b and e > a and e > s)
    out = intervals.period_intersect(frame(spark, events), frame(spark, periods))
    assert got(out) == want


def test_stream_with_rules_and_resets(spark, tmp_path):
    from spanlake.streaming.heartbeats import merge_stream

    schema = "bucket string, at long, start_ns long, end_ns long, data string, reset boolean"
    beats = [("a", 1, 0, 1, '{"t":"x"}', None), ("a", 2, 2, 3, '{ "t" : "x" }', False), ("a", 3, 4, 5, '{"t":"drop me"}', False), ("a", 4, 50, 60, '{"t":"x"}', True), ("a", 5, 65, 66, '{"t":"x"}', False), ("b", 6, 1, 2, '{"t":"y"}', True)]
    spark.createDataFrame(beats, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    seen = {}

    def keep(batch, _):
        seen.update({(r.bucket, r.seq): (r.start_ns, r.end_ns, r.data) for r in batch.collect()})

    merged = merge_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 10, [{"pattern": "drop", "action": "drop", "field": "t"}])
    merged.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert seen == {("a", 0): (0, 3, '{"t":"x"}'), ("a", 1): (50, 66, '{"t":"x"}')}


def test_stream_of_heartbeats(spark, tmp_path):
    from spanlake.streaming.heartbeats import merge_stream

    schema = "bucket string, at long, start_ns long, end_ns long, data string"
    beats = [("a", k, k * 10, k * 10, "x" if k < 5 or k > 6 else "y") for k in range(9)] + [("b", 1, 5, 6, "x")]
    for part, own in enumerate((beats[:4], beats[4:])):
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    seen = {}

    def keep(batch, _):
        seen.update({(r.bucket, r.seq): (r.start_ns, r.end_ns, r.data) for r in batch.collect()})

    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    query = merge_stream(stream, 10).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == {("a", 0): (0, 40, "x"), ("a", 1): (50, 60, "y"), ("a", 2): (70, 80, "x"), ("b", 0): (5, 6, "x")}


def test_a_report_runs_what_is_asked_for_only(spark):
    row = lambda data: spark.createDataFrame([("b", 1, 0, 10 * SECOND, data)], "bucket string, id long, start_ns long, end_ns long, data string")
    window, tabs = row('{"app":"Firefox","title":"x"}'), row('{"url":"https://a.org/"}')
    fails = row("{}").withColumn("data", F.raise_error(F.lit("not to be run")).cast("string"))
    out = reports.desktop_report(window, fails, {"firefox": tabs}, names=["browser_duration"])
    assert list(out) == ["browser_duration"] and out["browser_duration"].first()[0] == 10_000
    with pytest.raises(ValueError):
        reports.desktop_report(window, names=["browser_time"])
