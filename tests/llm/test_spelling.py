"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from _brute import AWKWARD, clashing, frame

from spanlake.llm import spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    total = Counter()
    for key, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(n):
    out, form = {}, {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(close)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n[w], out[w], form[w], n.get(form[w]), root))
    return rows


def as_rows(df):
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]


def vocabulary(seed, size):
    """Words with many neighbours: few letters, shared ends, chains of forms."""
    rng, n = random.Random(seed), {}
    for _ in range(size):
        w = rng.choice(["", "aaaaaa", "prefix"]) + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) + rng.choice(["", "aaaa", "suffix"])
        if len(w) >= 6:
            n[w] = 5 ** rng.randrange(1, 7)
    return n


def test_trie_pairs_are_all_pairs():
    words = [*vocabulary(1, 400), "", "a", "b", "ab", "ba"]
    got = list(spelling.trie_pairs(words))
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b)}


@pytest.mark.parametrize("most", [spelling.MOST, 40, 0])
def test_variants_at_any_size_of_parts(spark, most):
    n = vocabulary(2, 500)
    got = as_rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most))
    assert len(got) == len(set(got)) and set(got) == brute(n)
    assert any(r[3] and r[5] != r[3] for r in got)  # chains of forms


def test_documents(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10**6 + i, t, None) for i, t in enumerate(AWKWARD)] + [(None, "Häuser ×÷×÷×÷ ÉCOLES écoles ÀÉÎÕÜ " * 9, None)] + docs[:30]
    counted = spelling.word_counts(frame(spark, docs))
    assert dict(map(tuple, counted.collect())) == counts(docs)
    got = as_rows(spelling.variants(counted))
    assert len(got) == len(set(got)) and set(got) == brute(counts(docs))
    assert any(r[3] for r in got)


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert set(as_rows(spelling.op12_spelling(spark, SF))) == brute(counts(docs))


def test_empty_clashing_and_long(spark):
    assert not spelling.variants(spelling.word_counts(frame(spark, []))).collect()
    assert not spelling.variants(spelling.word_counts(frame(spark, [(None, None, None), (1, "", ""), (1, "short words " * 9, "")]))).collect()
    long = [(i, "x" * 3000 + c, "s") for i, c in enumerate("aaaaab" + "b" * 30)]
    assert {(r[1], r[2], r[4]) for r in as_rows(spelling.variants(spelling.word_counts(frame(spark, long)), most=100))} == {(5, 1, 31), (31, 1, None)}
    odd = clashing(frame(spark, long), ["word", "n", "name", "near", "shared", "head"])
    assert len(as_rows(spelling.variants(spelling.word_counts(odd)))) == 2
