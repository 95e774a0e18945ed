import random
import zlib

import numpy as np
import pytest
from _brute import AWKWARD, clashing, frame
from pyspark.sql import functions as F

from spanlake.llm import language

SF = "/root/testdata/sf0.1"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 7, 12, 30):
        code = language.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else code.shape[1] // 5)
        assert all(abs(c.sum()) < n for c in code.T)


def test_features_count_every_ngram_of_long_texts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdé", k=5)) for _ in range(80_000))
    line = f" {text} ".encode()
    assert language.features(text.encode()).sum() == sum(len(line) - n + 1 for n in language.ORDERS)


def test_held_out_accuracy(spark):
    out = language.op1_ecoc_language(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(docs)
    right = n = 0
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
        if r.held_out and docs[r.doc_id].lang:
            n, right = n + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert n > 1000 and right / n > 0.97, (right, n)


@pytest.mark.parametrize("labels", [[], ["en"], ["en", "de"]])
def test_awkward_rows_and_few_languages(spark, labels):
    rows = [(i, t, "s") for i, t in enumerate(AWKWARD)] + [(None, "the end", "s")] * 2
    y = [labels[k % len(labels)] for k in range(8)] if labels else []
    x = np.array([language.features((b"the thing " if k % 2 else b"der die das ") * 5) for k in range(len(y))]).reshape(-1, language.BUCKETS)
    out = language.predict(frame(spark, rows).withColumn("score", F.lit("x")), language.fit(language.unit(x), y)).collect()
    assert len(out) == len(rows)
    for r, (_, t, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), rows):
        assert (r.lang_pred == "und") == (not labels or not any(c.isalpha() for c in t or ""))
    assert language.predict(frame(spark, []), language.fit(language.unit(x), y)).count() == 0


def test_samples_are_bounded_and_columns_may_clash(spark):
    docs = spark.range(3000).selectExpr("7 as doc_id", "concat('the same key ', id) as text", "'en' as lang")
    x, y = language.sample(docs, F.lit(True), "doc_id", "text", "lang", per_lang=5000, in_all=50)
    assert len(y) <= 100 and x.shape[0] == len(y)
    odd = clashing(frame(spark, [(1, "the end", "s")]), ["key", "lang_pred", "score", "ambiguous", "order"])
    assert language.predict(odd, language.fit(x, y)).columns == ["doc_id", "lang_pred", "score", "ambiguous"]
