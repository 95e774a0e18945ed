"""The pipeline's stages one after another, against plain versions of each on what the one before kept."""

import threading
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from _brute import AWKWARD, clashing, frame, groups, without_repeated_runs
from pyspark import InheritableThread
from test_near_copies import _alike, _shingles
from test_quality import _prose, _verdicts
from tokenizers import Tokenizer

from spanlake.llm import mixing
from spanlake.llm._common import numbered, scratch_dir


def _docs():
    rows = [(i, "\n".join([f"{_prose(i % 3)}menu of the site", _prose(100 + i, 80), _prose(1000 + i, 30)]), "a") for i in range(40)]
    passage = _prose(5000, 55)
    rows += [(100 + i, f"{_prose(2000 + i, 60)}\n{passage}\n{_prose(3000 + i, 9)}", "b") for i in range(10)]
    rows += [(200 + i, _prose(4000, 90).replace(" ", "  ", i), "b") for i in range(5)] + [(210, _prose(4000, 89) + " end", "c")]
    base = _prose(6000, 120).split()
    rows += [(300 + i, " ".join([*base[:i], f"new{chr(97 + i)}", *base[i + 1 :]]), "c") for i in range(6)]
    return rows + [(400 + i, t, None) for i, t in enumerate(AWKWARD)]


def test_stages_match_plain_versions(spark):
    rows = _docs()
    docs = clashing(frame(spark, rows), ["row", "_of", "runs", "order", "of"])
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    kept = stages["quality_rules"](spark, docs, "").cache()
    verdicts = _verdicts(rows)
    want = {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in verdicts[i][0]) for i, t, _ in rows if verdicts[i][1]}
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == want and 0 < len(want) < len(rows)

    once = stages["line_dedup"](spark, kept, "").cache()
    listed = sorted(want.items())
    left = {i: t for (i, _), t in zip(listed, without_repeated_runs(listed, 50), strict=True) if t.strip()}
    assert once.columns == docs.columns and {r.doc_id: r.text for r in once.collect()} == left and left != want

    single = stages["simhash_near_dedup"](spark, once, "").cache()
    ids = sorted(left)
    root = groups([_shingles(left[i]) for i in ids], _alike)
    least = {min(ids[k] for k in range(len(ids)) if root[k] == r) for r in root}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == least and len(least) < len(left)

    mixed = stages["mix_sources"](spark, single, "").cache()
    times = {r.doc.doc_id: r.times for r in mixing.mix(single).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})

    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n_ids = {i: len(tokenizer.encode(left[i], add_special_tokens=False).ids) + 1 for i in times}
    assert sum(r.length for r in packed) == sum(n_ids[i] * n for i, n in times.items())
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_runs_keep_to_their_own_scratch_folders(spark, tmp_path, monkeypatch):
    base, docs = Path(scratch_dir(spark).removeprefix("file://")).parent, f"{tmp_path}/sf"
    listed = lambda: {f"{a.name}/{b.name}" for a in base.glob("*") for b in a.iterdir()}
    frame(spark, _docs()).write.parquet(f"{docs}/documents.parquet")
    before = listed()
    both = threading.Barrier(2)

    def wait(s, d, _):
        both.wait(300)
        return d

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], ("wait", wait), stages[1], stages[3]])
    out = [None, None]
    threads = [InheritableThread(target=lambda k=k: out.__setitem__(k, corpus_pipeline.run(spark, docs))) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(900)
    assert out[0].count() == out[1].count() > 0
    new = listed() - before
    assert len(new) == 2 and {Path(x).name for x in new} == {"3-mix_sources"}  # the last stage's rows alone are left

    def fail(s, d, _):
        numbered(d, f"{scratch_dir(s)}/x", "n")
        raise RuntimeError("on its way")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], ("fail", fail)])
    before = listed()
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, docs)
    assert listed() <= before


def test_stages_on_an_empty_table(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
