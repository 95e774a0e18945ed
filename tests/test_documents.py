"""Documents read in parts, cut anywhere, against the reader of whole ones."""

import json
import random

import pytest

from spanlake.sources import buckets, documents


def document(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice('ab"\\{}[],: \né/') for _ in range(rng.randrange(12)))
    event = lambda i: {"id": i, "timestamp": f"2020-01-01T00:{i % 60:02d}:{rng.randrange(60):02d}.{rng.randrange(10**6)}Z", "duration": rng.randrange(9), "data": {"app": text(), "n": {"x": [text(), {"y": 1}]}, "events": [{"no": 1}]}}
    bad = [{"data": 2}, {"timestamp": "no", "data": {}}, {"timestamp": "2020-01-01T00:00:00Z", "data": [1]}, 7, "text", [{"a": 1}], {}]
    out = {}
    for k in range(6):
        name = f"b{k}" if k else 'odd "name" {['
        rows = [event(i) if rng.random() < 0.8 else rng.choice(bad) for i in range(0 if k == 3 else n)]
        own = {"id": name, "type": "t", "client": text(), "hostname": "h", "data": {"x": {"y": {}}, "events": [{"z": text()}]}, "events": rows}
        if k % 2:  # members in another order
            own = dict(reversed(own.items()))
        if k == 5:
            own["data"] = {"events": [{"z": 1}, 3], "more": {"events": []}}
        if k == 4:
            own = {"id": name, "events": rows, "type": "t", "data": {}}
        out[name] = own
    return json.dumps({"buckets": out}, ensure_ascii=seed % 2 == 0, indent=seed if seed else None)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_parts_of_any_size_read_as_the_whole(spark, tmp_path, seed):
    (tmp_path / "d").mkdir()
    for k in range(2):
        (tmp_path / "d" / f"{k}.json").write_text(document(seed + 10 * k if k else seed, 40), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/d").rdd.getNumPartitions() > 20
        catalog, events = documents.read_documents(spark, f"{tmp_path}/d")
        want_catalog, want_events = buckets.read_document(spark.read.text(f"{tmp_path}/d", wholetext=True))
        assert same(catalog.select(sorted(catalog.columns)), want_catalog.select(sorted(catalog.columns))) and catalog.count() == 12
        assert same(events, want_events) and events.count() > 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents_without_buckets_or_events(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "0.json").write_text('{"buckets": {}}\n')
    assert [x.count() for x in documents.read_documents(spark, f"{tmp_path}/d")] == [0, 0]
    (tmp_path / "d" / "1.json").write_text('\n{ "buckets" : { "a" : {"events": [ ] } , "b":{} }}\n\n')
    catalog, events = documents.read_documents(spark, f"{tmp_path}/d")
    assert sorted(r.bucket for r in catalog.collect()) == ["a", "b"] and events.count() == 0
