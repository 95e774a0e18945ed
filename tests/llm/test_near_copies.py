import random

from _brute import AWKWARD, WORD, frame, groups

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def _shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    shared = len(a & b)
    return a == b or 5 * shared >= 4 * (len(a) + len(b) - shared)


def test_stage_keeps_one_of_all_that_are_alike(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(150).collect()]
    rng = random.Random(6)
    for i in range(150):  # edits from few to many, so that similarities lie on both sides of 0.8
        words = rows[i][1].split()
        for _ in range(rng.randint(0, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        rows.append((5000 + i, " ".join(words), "copy"))
    rows += [(9000 + i, t, None) for i, t in enumerate(AWKWARD)] + [rows[3], (rows[4][0], rows[4][1], "again"), (None, "no key here at all", None), (None, rows[5][1], None)]
    sets = [_shingles(t) for _, t, _ in rows]
    root = groups(sets, _alike)
    close = [k for k in range(150) if root[150 + k] == root[k]]
    assert 40 < len(close) < 140
    least = {}
    for (i, _, _), g in zip(rows, root, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    docs = frame(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, least.values()))
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), SF).count() == 0
