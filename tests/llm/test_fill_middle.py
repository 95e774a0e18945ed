"""Fill-in-middle against plain slicing."""

import re
from hashlib import sha256

import duckdb
import pytest
from _brute import AWKWARD, clashing, frame

from spanlake.llm import fill_middle

SF = "/root/testdata/sf0.001"
UNITS = {"char": r"(?s:.)", "word": r"[^\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}


def brute(key, text, unit="char"):
    text = text or ""
    h = [int(sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    starts = [m.start() for m in re.finditer(UNITS[unit], text)]
    n = len(starts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted([*starts, len(text)][x % (n + 1)] for x in h[:2])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return key, n, form, a, b - a, out


def rows(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [*AWKWARD, *(f"a{s}b {s}" for s in ("<P>", "<S>", "<M>", "<p>", "<P", "<<P>>")), "<", ">", "P>", "<P<S<M", "漢字\U0001f600\n" * 9, "x\r\ny\x85z  \x0b", "\n", "\n\na", "a\n"]
    return docs + [(10**6 + i, t, None) for i, t in enumerate(odd * 5)] + [(None, "no key here", None), (None, None, None)] + docs[:2]


@pytest.mark.parametrize("unit", UNITS)
def test_forms_cuts_and_round_trip(spark, unit):
    docs = rows(spark)
    got = fill_middle.restored(fill_middle.transform(frame(spark, docs), ["doc_id", "text"], unit=unit)).collect()
    want = [brute(k, t, unit) for k, t, _ in docs]
    assert sorted(((r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(want, key=str)
    assert all(r.restored == (r.doc.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        if r.form != "plain":
            cuts = (r.prefix_chars, r.prefix_chars + r.middle_chars)
            assert r.cuts_in_word == sum(bool(re.fullmatch(r"[^\x20\x09-\x0D]{2}", r.doc.text[max(c - 1, 0) : c + 1])) for c in cuts if c)


def test_many_events_are_taken_by_parts(monkeypatch):
    monkeypatch.setattr(fill_middle, "EVENTS", 3)
    scan = fill_middle.Scan("one two\nthree  four <M> x" * 9, "word")
    assert scan.n == 46 and len(scan.sentinels) == 9 and [scan.place(r) for r in (0, 1, 46, 99)] == [0, 4, scan.size, scan.size]


def test_query_and_sql(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = fill_middle.op13_fill_middle(spark, SF)
    got = out.collect()
    digest = lambda t: sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == sorted((*w[:5], digest(w[5]), digest(docs[k] or "")) for k in docs for w in [brute(k, docs[k])])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = duck.execute(fill_middle.ORACLE_SQL)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(rel.fetchall(), key=str)


def test_empty_and_clashing(spark):
    assert not fill_middle.transform(frame(spark, []), ["doc_id"]).collect()
    odd = clashing(frame(spark, [(1, "some text", "s")]), ["doc", "name", "output", "form", "n"])
    assert fill_middle.transform(odd, ["doc_id"]).first().output == brute(1, "some text")[5]
