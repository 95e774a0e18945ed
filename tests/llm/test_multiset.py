import hashlib
import random

import numpy as np
from _brute import AWKWARD, clashing, frame

from spanlake.llm import multiset

SF = "/root/testdata/sf0.01"


def test_sums_are_free_of_order_and_incremental():
    rng = random.Random(6)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))).encode() for _ in range(50)]
    whole = multiset.vector(b"\n".join(lines))
    assert np.array_equal(whole, multiset.vector(b"\n\n".join(lines[::-1])))
    assert np.array_equal(multiset.delete(whole, lines[3]), multiset.vector(b"\n".join(lines[:3] + lines[4:])))
    assert np.array_equal(multiset.insert(whole, lines[3]), multiset.vector(b"\n".join(lines + lines[3:4])))
    assert not np.array_equal(whole, multiset.insert(whole, lines[3]))
    assert np.array_equal(multiset.from_string(multiset.as_string(whole)), whole)


def _edited(rows):
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1] or "", len(t or "") // 2
        t = t or ""
        yield i, t, t[: len(t) - half] + after[:half], after


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(5000 + 3 * i, t) for i, t in enumerate(AWKWARD)]
    docs = frame(spark, [(i, t, "s") for i, t in rows]).selectExpr("*", "'x' as fingerprint", "1 as part")
    out = {r.doc_id: r for r in multiset.edited(docs).collect()}
    assert len(out) == len(rows)
    near = []
    for i, t, e, after in _edited(rows):
        r, a, b, c = out[i], *(multiset.vector(x.encode()) for x in (t, e, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest()), i
        assert (r.fingerprint, r.edited_fingerprint) == (multiset.as_string(a), multiset.as_string(b))
        assert (r.near_edited, r.near_next) == (multiset.likeness(a, b), multiset.likeness(a, c))
        assert t != e or r.near_edited == 1
        if len(t) > 500:
            near.append((r.near_edited, r.near_next))
    assert sum(a > b for a, b in near) / len(near) > 0.97


def test_small_tables_nulls_and_ties(spark):
    assert multiset.edited(frame(spark, [])).count() == 0
    one = multiset.edited(frame(spark, [(4, "ab cd", None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1
    out = multiset.edited(frame(spark, [(7, "same", None)] * 3 + [(None, "none", None)] * 2 + [(8, None, None)])).collect()
    assert sorted(r.n_chars for r in out) == [0, 4, 4, 4, 4, 4] and sum(r.near_next == 1 for r in out) >= 3
    assert len(multiset.fingerprints(frame(spark, [(1, None, None)])).collect()) == 1


def test_columns_may_clash(spark):
    odd = clashing(frame(spark, [(1, "a b", "s"), (2, "c d", "s")]), ["key", "part", "copy", "tie", "bucket", "as_double", "fingerprint", "of", "to", "place"])
    assert sorted(r.doc_id for r in multiset.edited(odd).collect()) == [1, 2] and multiset.fingerprints(odd).columns == ["doc_id", "fingerprint"]
