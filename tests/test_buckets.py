"""Ids, replacements and whole documents."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanlake.schema import EVENT_DDL
from spanlake.sources import buckets, documents, legacy


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_DDL)


def got(df):
    return sorted(((r.bucket, r.id, r.start_ns, r.end_ns, r.data) for r in df.collect()), key=str)


def test_ids_follow_the_highest_and_the_last_of_equals_counts(spark):
    have = frame(spark, [("a", 1, 0, 1, "x"), ("a", 7, 5, 6, "y"), ("b", 3, 0, 1, "z")])
    new = [("b", None, 9, 9, "n"), ("a", None, 4, 4, "n"), ("a", 3, 1, 2, "old"), ("a", 3, 2, 3, "new"), ("a", None, 4, 4, "n")]
    out = got(buckets.insert(have, frame(spark, new).repartition(3)))
    assert out == sorted([("a", 1, 0, 1, "x"), ("a", 7, 5, 6, "y"), ("a", 3, 2, 3, "new"), ("a", 8, 4, 4, "n"), ("a", 9, 4, 4, "n"), ("b", 10, 9, 9, "n")], key=str)
    assert got(buckets.insert(have.limit(0), frame(spark, new[:1]))) == [("b", 1, 9, 9, "n")]
    many = spark.range(1000).selectExpr("'b' as bucket", "cast(null as long) as id", "id % 10 as start_ns", "id as end_ns", "'x' as data").repartition(7)
    ids = [r.id for r in buckets.with_ids(many, 5).orderBy("start_ns", "end_ns").collect()]
    assert ids == list(range(6, 1006))


def test_replacing_what_is_not_there_is_an_error(spark):
    have = frame(spark, [("a", 1, 0, 1, "x"), ("b", 2, 0, 1, "z")])
    assert got(buckets.replace(have, frame(spark, [("a", 1, 0, 9, "w")]))) == [("a", 1, 0, 9, "w"), ("b", 2, 0, 1, "z")]
    for bucket, id_ in (("a", 2), ("c", 1), ("a", None)):
        with pytest.raises(KeyError):
            buckets.replace(have, frame(spark, [(bucket, id_, 0, 1, "w")]))
    with pytest.raises(KeyError):
        buckets.event(have, "a", 9, required=True)
    assert buckets.event(have, "a", 1, required=True).count() == 1 and buckets.event(have, "a", 9).count() == 0


def test_documents_in_parts(spark, tmp_path):
    catalog = spark.createDataFrame([], buckets.CATALOG_DDL)
    for name in ('a "quoted"/name', "b", "empty"):
        catalog = buckets.create_bucket(catalog, name, "t", "c", "h", "2020-01-01", '{"k":"[}"}')
    s = 1_000_000_000
    rows = [("b", i, i * s, i * s + i, f'{{"n":{i},"t":"}}],\\"{i}"}}') for i in range(500)] + [('a "quoted"/name', 7, -s, 0, '{"x":1}')] * 2 + [("not in the catalog", 1, 0, 1, "{}")]
    events = frame(spark, rows).repartition(5)
    buckets.write_documents(events, catalog, f"{tmp_path}/d", parts=5)
    for k, name in enumerate(('a "quoted"/name', "b", "empty")):
        buckets.join_document(spark, f"{tmp_path}/d", name, f"{tmp_path}/whole/{k}.json")
    with pytest.raises(KeyError):
        buckets.join_document(spark, f"{tmp_path}/d", "none", f"{tmp_path}/whole/n.json")
    raw = json.loads((tmp_path / "whole" / "1.json").read_text())
    assert [e["id"] for e in raw["buckets"]["b"]["events"]] == list(range(500)) and raw["buckets"]["b"]["data"] == {"k": "[}"}
    assert json.loads((tmp_path / "whole" / "2.json").read_text())["buckets"]["empty"]["events"] == []
    assert len(list((tmp_path / "d" / "parts" / "bucket=b").glob("part-*"))) > 1
    found, back = buckets.read_document(spark.read.text(f"{tmp_path}/whole", wholetext=True))
    assert sorted(r.bucket for r in found.collect()) == ['a "quoted"/name', "b", "empty"]
    assert got(back) == got(events.where(F.col("bucket") != "not in the catalog"))


def test_stored_buckets_leave_others_untouched(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.write(frame(spark, [(b, 1, 0, 1, b) for b in ("user-1", "user-2", "person-2", "odd/name", "else")]), path)
    files = lambda: {(str(f.relative_to(path)), f.stat().st_mtime_ns) for f in (tmp_path / "t").rglob("part-*")}
    before = files()
    buckets.delete_stored(spark, path, "odd/name")
    left = files()
    assert left < before and len(left) == 4
    buckets.rename_stored(spark, path, "else", "new/name")
    assert len(files() & left) == 3 and sorted(r[0] for r in got(buckets.read(spark, path))) == ["new/name", "person-2", "user-1", "user-2"]
    assert buckets.migrate_stored(spark, path, "user-", "person-") == 1
    assert sorted(r[0] for r in got(buckets.read(spark, path))) == ["new/name", "person-1", "person-2", "user-2"]
    with pytest.raises(KeyError):
        buckets.delete_stored(spark, path, "none")
    with pytest.raises(KeyError):
        buckets.rename_stored(spark, path, "none", "x")
    with pytest.raises(ValueError):
        buckets.rename_stored(spark, path, "user-2", "person-2")


def test_documents_of_many_buckets_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FOLDERS", 2)
    monkeypatch.setattr(buckets, "SHARED_ROWS", 12)
    rows = [(f"user-{k}", i, i, i + k, f'{{"t":"}}],\\n{i}"}}') for k in range(40) for i in range(30 if k in (8, 9, 11, 18) else k % 10)]
    events = frame(spark, rows).repartition(5)
    catalog = spark.range(40).select(F.concat(F.lit("user-"), "id").alias("bucket"), F.lit("t").alias("type"), F.lit("c").alias("client"), F.lit("h\n").alias("hostname"), F.lit(None).cast("timestamp").alias("created"), F.lit("{}").alias("data"))
    buckets.write_documents(events, catalog, f"{tmp_path}/d", parts=5)
    assert sorted(f.name for f in (tmp_path / "d" / "heads").glob("bucket=*")) == ["bucket=user-11", "bucket=user-18", "bucket=user-8", "bucket=user-9"]
    asked = catalog.where("bucket like '%8' or bucket = 'user-30'")
    buckets.join_documents(spark, f"{tmp_path}/d", asked, f"{tmp_path}/whole")
    files = [f for f in (tmp_path / "whole").iterdir() if f.suffix in (".txt", ".json")]
    assert len([f for f in files if f.suffix == ".json"]) == 2 and all(json.loads(line)["buckets"] for f in files for line in f.read_text().splitlines())
    want = [r for r in rows if r[0].endswith("8")]
    for catalog_, back in (buckets.read_document(spark.read.text(f"{tmp_path}/whole")), documents.read_documents(spark, f"{tmp_path}/whole")):
        assert sorted(r.bucket for r in catalog_.collect()) == ["user-18", "user-28", "user-30", "user-38", "user-8"]
        assert got(back) == sorted(want, key=str)
    buckets.join_document(spark, f"{tmp_path}/d", "user-28", f"{tmp_path}/one.json")
    assert [e["id"] for e in json.loads((tmp_path / "one.json").read_text())["buckets"]["user-28"]["events"]] == list(range(8))


def test_many_buckets_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FOLDERS", 2)
    path = f"{tmp_path}/a table"
    rows = [(f"user-{k}", i, i, i + 1, "x") for k in range(40) for i in range(3 if k > 1 else 9)] + [(None, 1, 0, 1, "n")]
    for some in (rows[::2], rows[1::2]):
        buckets.write(frame(spark, some), path)
    assert len(list((tmp_path / "a table").glob("bucket=*"))) <= 5 and len(list((tmp_path / "a table").rglob("part-*.parquet"))) < 20
    assert got(buckets.read(spark, path)) == sorted(rows, key=str)
    assert got(buckets.read(spark, path).where("bucket = 'user-7' and start_ns >= 1")) == [("user-7", 1, 1, 2, "x"), ("user-7", 2, 2, 3, "x")]
    buckets.delete_stored(spark, path, "user-7")
    buckets.delete_stored(spark, path, "user-0")
    buckets.rename_stored(spark, path, "user-8", "person-9")
    for call in (lambda: buckets.delete_stored(spark, path, "user-7"), lambda: buckets.rename_stored(spark, path, "user-8", "x")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        buckets.rename_stored(spark, path, "user-10", "user-11")
    assert buckets.migrate_stored(spark, path, "user-", "person-") == 36
    new = {"user-8": "person-9", "user-9": "user-9", None: None}
    assert got(buckets.read(spark, path)) == sorted(((new.get(b, b and b.replace("user", "person")), *r) for b, *r in rows if b not in ("user-7", "user-0")), key=str)


def test_an_event_is_parsed_once_for_export(spark):
    out = buckets.export(frame(spark, [("a", 1, 0, 1, '{ "b":1}'), ("a", 2, 0, 1, "no json"), ("a", 3, 0, 1, "null"), ("a", 4, 0, 1, None)]))
    assert out._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    assert {json.loads(r.event)["id"]: json.loads(r.event)["data"] for r in out.collect()} == {1: {"b": 1}, 2: {}, 3: None, 4: {}}


def test_legacy_files(spark, tmp_path):
    path = f"{tmp_path}/old.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE bucketmodel (key INTEGER PRIMARY KEY, id TEXT, type TEXT, client TEXT, hostname TEXT, created TEXT)")
        con.execute("CREATE TABLE eventmodel (id INTEGER PRIMARY KEY, bucket_id INTEGER, timestamp TEXT, duration REAL, datastr TEXT)")
        con.executemany("INSERT INTO bucketmodel VALUES (?, ?, 't', 'c', 'h', '2020-01-01 00:00:00.5+00:00')", [(1, "a"), (2, "b"), (3, "empty")])
        rows = [(1, f"2000-01-01 00:00:{k:02d}.123456+01:00", k + 0.5, json.dumps({"n": k})) for k in range(50)]
        rows += [(2, "2000-01-01 00:00:00+00:00", 0.0, bad) for bad in ("no json", "[1]", "{")] + [(2, "2000-01-01 00:00:00+00:00", 1.25, '{ "b":1, "a":2 }')]
        con.executemany("INSERT INTO eventmodel (bucket_id, timestamp, duration, datastr) VALUES (?, ?, ?, ?)", rows)
    catalog, events = legacy.read_legacy(spark, path, rows=7)
    assert sorted(r.bucket for r in catalog.collect()) == ["a", "b", "empty"] and catalog.first().created is not None
    s = 1_000_000_000
    start = (946684800 - 3600) * s + 123456000
    want = [("a", None, start + k * s, start + k * s + k * s + s // 2, f'{{"n":{k}}}') for k in range(50)] + [("b", None, 946684800 * s, 946684800 * s + 5 * s // 4, '{"a":2,"b":1}')]
    assert got(events) == sorted(want, key=str)
    one = legacy.read_legacy(spark, path, "b", rows=7)[1]
    assert got(one) == want[-1:]
    with pytest.raises(KeyError):
        legacy.read_legacy(spark, path, "none")
    reader = legacy.Reader(path, 7)
    assert list(reader.pushFilters([legacy.EqualTo(("bucket_key",), 2)])) == [] and len(reader.partitions()) == 8
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 4


def test_largest_table_of_each_host(spark, tmp_path):
    for host, table, n in (("one", "a", 1), ("one", "b", 5000), ("two", "c", 10)):
        buckets.write(frame(spark, [("x", i, i, i * i, f'{{"n":{i}}}') for i in range(n)]), f"{tmp_path}/{host}/{table}")
    found = {r.host: (r.table, r.bytes) for r in buckets.largest_tables(spark, str(tmp_path)).collect()}
    size = lambda *at: sum(f.stat().st_size for f in tmp_path.joinpath(*at).rglob("*.parquet"))
    assert found == {"one": ("b", size("one", "b")), "two": ("c", size("two", "c"))}
