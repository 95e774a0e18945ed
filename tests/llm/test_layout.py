"""Packing, mixing, token files and sharding on documents and awkward rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from _brute import AWKWARD, WORD, by, clashing, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import mixing, packing, shard, token_files

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def _rows(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return docs + [(10**6 + i, t, None) for i, t in enumerate(AWKWARD)]


TOKENIZER = Tokenizer.from_file(PATH)


def _ids(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing(spark):
    rows = _rows(spark)
    out = packing.pack_documents(frame(spark, rows)).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = 0
    for i, t, _ in rows:
        ids = _ids(t, 0)
        total += len(ids)
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = ids[2048 * k : 2048 * k + 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert sum(r.length for r in pieces[i]) == len(ids)
    assert len(places) <= -(-total // 2048) * 1.03 + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = _rows(spark)
    token_files.write(frame(spark, rows), str(tmp_path / "t"), PATH, 1, parts=3)
    out = {r.key: r for r in token_files.read(spark, str(tmp_path / "t")).collect()}
    at = 0
    for i, t, _ in sorted(rows):
        ids = _ids(t, 1)
        assert (out[i].start, out[i].n_tokens, list(out[i].ids), out[i].ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wide = clashing(frame(spark, rows), ["key", "tie", "part", "n", "tag", "doc"])
    token_files.write(wide, f"file:{tmp_path}/c", PATH, 1, parts=2)
    assert token_files.read(spark, f"file:{tmp_path}/c").count() == len(rows)
    token_files.write(frame(spark, []), str(tmp_path / "e"), PATH, 1, parts=2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_packing_of_clashing_columns_and_few_rows(spark):
    odd = clashing(frame(spark, [(1, "one two", "s"), (None, None, None), (1, "one two", "s")]), ["key", "ids", "length", "piece", "start", "offset", "sequence_id", "n", "rank"])
    out = packing.pack_documents(odd).collect()
    # Three, one and three ids fit in one sequence.
    assert sorted(r.length for r in out) == [1, 3, 3] and {r.sequence_id for r in out} == {out[0].sequence_id} and sorted(r.offset for r in out)[0] == 0


def test_packing_is_as_good_as_any_on_small_counts():
    """Against the least number of sequences, found by trying all."""
    from functools import lru_cache

    rng = np.random.default_rng(3)

    @lru_cache(None)
    def least(lengths):
        """The fewest sequences of ten for sorted lengths: the longest goes with every choice of others that fits."""
        if not lengths:
            return 0
        best = len(lengths)
        rest = lengths[1:]
        for mask in range(1 << len(rest)):
            some = [rest[k] for k in range(len(rest)) if mask >> k & 1]
            if lengths[0] + sum(some) <= 10:
                best = min(best, 1 + least(tuple(x for k, x in enumerate(rest) if not mask >> k & 1)))
        return best

    worse = 0
    for _ in range(40):
        lengths = tuple(sorted(rng.integers(1, 11, rng.integers(1, 9)).tolist(), reverse=True))
        n = sum(times for _, times in packing.plan(Counter(lengths), 10).patterns)
        worse += n - least(lengths)
        assert least(lengths) <= n <= least(lengths) + 1
    assert worse <= 2


def test_token_files_name_the_attempts_that_count(spark, tmp_path):
    folder = str(tmp_path / "t")
    for text in ("one", "two three"):  # the second manifest replaces the first, what the first wrote is left unread
        token_files.write(frame(spark, [(1, text, "s"), (2, text, "s")]), folder, PATH, 1, parts=2)
    assert [r.ids for r in token_files.read(spark, folder).orderBy("key").collect()] == [_ids("two three", 1)] * 2
    assert len(list((tmp_path / "t").glob("*.bin"))) > 2


def test_stores_by_scheme(spark):
    conf = spark._jsc.hadoopConfiguration()
    for name, value in {"access.key": "a", "secret.key": "b", "endpoint": "http://localhost:1", "endpoint.region": "here", "bucket.own.access.key": "c"}.items():
        conf.set(f"fs.s3a.{name}", value)
    try:
        found = token_files.settings(spark, "s3a://own/x/y")
        assert found == {"access_key": "c", "secret_key": "b", "endpoint_override": "http://localhost:1", "region": "here"}
        store, root = token_files._store("s3a://own/x/y/", found)
        assert store.type_name == "s3" and root == "own/x/y" and store.region == "here"
    finally:
        for name in ("access.key", "secret.key", "endpoint", "endpoint.region", "bucket.own.access.key"):
            conf.unset(f"fs.s3a.{name}")
    assert token_files.settings(spark, "/local") == {} and token_files._store("file:/local")[1] == "/local"


def test_mixing_targets(spark):
    rows = _rows(spark)
    out = mixing.mix(frame(spark, rows)).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / (sum(weight[s] for s in names if s not in capped) or 1)
        over = {s for s in names if s not in capped and weight[s] * level >= 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in out:
        s = r.doc.source
        target = 3 * size[s] if s in capped else weight[s] * level
        assert r.source_size == size[s] and abs(r.target - target) < 1e-6 * total and 0 <= r.times <= 3
        taken[s] += r.times * r["size"]
    longest = {s: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - (3 * size[s] if s in capped else weight[s] * level)) <= longest[s] for s in names)
    again = mixing.mix(frame(spark, rows[::-1]))
    assert {(r.doc.doc_id, r.times) for r in again.collect()} == {(r.doc.doc_id, r.times) for r in out}
    assert mixing.mixed_rows(frame(spark, rows)).count() == sum(r.times for r in out)
    assert mixing.mix(frame(spark, [])).count() == mixing.mixed_rows(frame(spark, [])).count() == 0


def test_mixing_comes_near_each_target(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for (source,), own in by([{"source": r.doc.source, "taken": r.times * r["size"], "target": r.target} for r in out], "source").items():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"], source
    # A place in the order is the key's and the text's, nulls included.
    places = mixing.sized(frame(spark, [(None, "5", "s"), (5, None, "s"), (5, "5", "s"), (None, None, "s")]), "doc_id", "text", "source", 1)
    assert places.select("order").distinct().count() == 4


def test_mixing_passes_beyond_what_does_not_fit(spark):
    # One text holds nearly all words: it may be met anywhere in the order.
    rows = [(0, "w " * 5000, "A"), *((k, "a b c", "A") for k in range(1, 1000)), (5000, "one " * 100_000, "B")]
    for seed in range(4):
        out = mixing.mix(frame(spark, rows), weights=(1, 9), seed=seed).collect()
        own = [r for r in out if r.doc.source == "A"]
        assert abs(sum(r.times * r["size"] for r in own) - own[0].target) <= max(3, 0.001 * own[0].target) and max(r.times for r in own) <= 3


def test_mixing_repeated_rows(spark):
    rows = [(k, f"a {k} " * 4, "A") for k in range(3000)] + [(7, "one two three four five", "B")] * 6000 + [(k, "x y z " * (k % 7), "B") for k in range(600)] + [(None, "n", None)] * 5
    docs = frame(spark, rows).repartition(5)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    for s, most in (("A", 8), ("B", 18), (None, 1)):
        own = [r for r in out if r.doc.source == s]
        taken = sum(r.times * r["size"] for r in own)
        assert abs(taken - own[0].target) <= most and 0 < own[0].target and max(r.times for r in own) <= 3
    counted = lambda rows: Counter((r.doc.doc_id, r.doc.text, r.times) for r in rows)
    assert counted(out) == counted(mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect())
    wide = clashing(docs, ["_cut", "_s", "_whole", "_last", "doc", "source_size", "size", "order", "s", "times", "id", "task", "col"])
    mixed = mixing.mixed_rows(wide)
    assert mixed.columns == wide.columns and mixed.count() == sum(r.times for r in out)


def test_sharding(spark, tmp_path):
    rows = _rows(spark)
    docs = frame(spark, rows)
    out = shard.shard(docs, 4).collect()
    text = {i: (t or "").encode() for i, t, _ in rows}
    sizes, places = defaultdict(int), defaultdict(list)
    for r in out:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
        sizes[r.shard] += r["size"]
        places[r.shard].append(r.position)
    assert len(out) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())
    mean, largest = sum(sizes.values()) / 4, max(r["size"] for r in out)
    assert max(sizes.values()) <= mean + largest and min(sizes.values()) >= mean - largest
    assert shard.shard(frame(spark, []), 4).count() == 0
    wide = clashing(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")), ["key", "size", "part", "virtual_slot", "shard", "base", "place", "doc"])
    got = shard.shard(wide, 3).collect()
    assert len(got) == 2 * len(rows) and all(r.doc_id is None for r in got)
    assert all(sorted(r.position for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(3))


def test_slot_map_is_kept_and_edited(spark, tmp_path):
    docs, maps = frame(spark, _rows(spark)), f"{tmp_path}/maps"
    shard.save(spark, maps, 1, shard.first_map(512, 4))
    first = {r.doc_id: r.shard for r in shard.shard(docs, 4, 512, maps=maps).collect()}
    version, kept = shard.load(spark, maps)
    assert version == 2 and shard.load(spark, maps, 1)[1] == shard.first_map(512, 4) != kept
    again = {r.doc_id: r.shard for r in shard.shard(docs, 4, 512, maps=maps).collect()}
    assert again == first and shard.load(spark, maps)[0] == 2  # nothing to edit
    grown = {r.doc_id: r.shard for r in shard.shard(docs, 5, 512, maps=maps).collect()}
    version, edited = shard.load(spark, maps)
    assert version == 3 and set(edited) == set(range(5)) and 0 < sum(a != b for a, b in zip(kept, edited, strict=True)) < 0.5 * 512
    assert sum(grown[i] == s for i, s in first.items()) > 0.4 * len(first)


def test_sharding_query(spark):
    out = shard.op10_virtual_slots(spark, "/root/testdata/sf0.01").collect()
    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    sizes, places = defaultdict(int), defaultdict(list)
    for r in out:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(want[r.doc_id]) + 1, zlib.crc32(want[r.doc_id]), "bytes", None)
        sizes[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(out) == len(want) and sorted(sizes) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(sizes.values()) / 8
    assert all(abs(x - mean) <= 0.001 * mean for x in sizes.values())


def test_slots_move_little():
    load = [(k * 7919) % 100 + 1 for k in range(512)]
    before = shard.first_map(512, 4)
    grown = shard.rebalanced(before, load, 5)
    totals = [sum(load[k] for k in range(512) if grown[k] == s) for s in range(5)]
    assert max(totals) <= 1.01 * sum(load) / 5 and sum(grown[k] != before[k] for k in range(512)) < 0.3 * 512
