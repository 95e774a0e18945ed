import random
import re
from collections import Counter

import duckdb
from _brute import AWKWARD, WORD, clashing, counts, frame, same_rows

from spanlake.llm import quality, registry

SF = "/root/testdata/sf0.001"


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    extra = frame(spark, [(10**6 + i, t, None) for i, t in enumerate(AWKWARD)]).select("doc_id", "text", "source")
    got = {r.doc.doc_id: r for r in quality.judge(docs.union(extra), ["doc_id"]).collect()}
    rows = docs.union(extra).collect()
    assert len(got) == len(rows)
    for r in rows:
        (n_words, word_chars, n_symbols, n_dup, n_rep), failed = counts(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (n_words, word_chars, n_symbols, n_dup, n_rep, failed), r.doc_id


def _prose(i, n=60):
    letters = "".join(chr(97 + int(c)) for c in str(i))  # digits are all alike to the rules
    return " ".join(f"w{letters}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    menu = " ".join(f"menu{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows = [(i, f"{_prose(i)}\nMenu Home  About", "a") for i in range(30)]
    rows += [(100, f"{menu}\n{_prose(100, 5)}", "a")] + [(200 + i, f"{_prose(200 + i, 150)}\n{menu}", "a") for i in range(30)]
    rows += [(500 + i, _prose(500), "b") for i in range(40)]  # copies are one document
    out = {r.doc.doc_id: r for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()}
    assert all(out[i].kept and out[i].removed == [1] for i in range(30))
    assert not out[100].kept and not out[100].base_failed
    assert all(out[200 + i].kept == (150 >= 350 * quality.MIN_LEFT) for i in range(30))
    assert all(out[500 + i].kept and not out[500 + i].removed for i in range(40))
    kept = {r.doc_id: r for r in quality.filter_documents(frame(spark, rows)).collect()}
    assert set(kept) == {i for i, r in out.items() if r.kept}
    assert kept[3].text == _prose(3) and kept[3].n_chars == len(_prose(3))
    assert kept[500].text == _prose(500)


def test_empty_table_and_extra_columns(spark):
    assert quality.judge(frame(spark, []), ["doc_id"]).count() == quality.filter_documents(frame(spark, [])).count() == 0
    docs = frame(spark, [(None, _prose(1), None), (None, _prose(1), None), (2, None, "s")])
    wide = clashing(docs, ["row", "kept", "of", "doc", "host", "removed", "_removed", "_of", "lines", "split", "new_text", "_row"])
    out = quality.filter_documents(wide)
    assert out.columns == wide.columns and same_rows(out, wide.where("doc_id is null"))
    assert quality.filter_documents(wide.drop("n_chars")).columns == wide.drop("n_chars").columns
    judged = quality.judge(wide, ["row", "kept", "host"]).collect()
    assert len(judged) == 3 and all(r.doc.row == r.doc.kept == r.doc.host == "x" for r in judged)


def test_every_shared_line_goes_on_every_host(spark):
    line = lambda name: " ".join(f"{name}{chr(97 + k)}" for k in range(6))
    rows = []
    for h in range(60):
        shared = [line(f"host{_prose(h, 1)}{chr(97 + k)}") for k in range(4)]
        rows += [(100 * h + i, "\n".join([*shared[:2], _prose(1000 + 100 * h + i), *shared[2:]]), f"h{h}") for i in range(50)]
    out = quality.judge(frame(spark, rows), ["doc_id"]).collect()
    assert len(out) == 3000 and all(r.removed == [0, 1, 3, 4] and r.kept for r in out)


def _verdicts(rows):
    """{key: (removed places, kept)} of (key, text, host) rows, by the rule of the docstring."""
    docs, hosts = [], {}
    for key, text, host in rows:
        lines = [(re.sub("[0-9]+", "0", " ".join(WORD.findall(x)).lower()), len(WORD.findall(x)), at) for at, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        docs.append((key, host, lines, text))
        hosts.setdefault(host, []).append(lines)
    frequent = {}
    for host, listed in hosts.items():
        sets = {frozenset(x[0] for x in lines) for lines in listed if lines}
        having = Counter(x for s in sets for x in s)
        frequent[host] = {x for x, k in having.items() if k > max(quality.MIN_DOCS, quality.MIN_SHARE * len(sets))}
    out = {}
    for key, host, lines, text in docs:
        gone = [x for x in lines if x[0] in frequent[host]]
        words = sum(x[1] for x in lines)
        out[key] = [x[2] for x in gone], not counts(text)[1] and words - sum(x[1] for x in gone) >= words * quality.MIN_LEFT
    return out


def test_verdicts_match_brute_force_and_sql(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.source[:4]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    rng, pool = random.Random(4), [_prose(5000 + k, rng_n) for k, rng_n in enumerate([3, 5, 8, 20, 70] * 6)]
    rows += [(10**6 + i, "\n".join([*rng.sample(pool, rng.randint(0, 9)), _prose(7000 + i % 150, 30)]), f"p{i % 3}") for i in range(400)]
    rows += [(2 * 10**6 + i, t, None) for i, t in enumerate(AWKWARD)]
    want = _verdicts(rows)
    assert 30 < sum(bool(r) for r, _ in want.values()) and {k for _, k in want.values()} == {True, False}
    assert {r.doc.doc_id: (r.removed, r.kept) for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()} == want
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(f"SELECT doc_id, n_lines_removed, kept FROM ({quality.ORACLE_SQL})").fetchall()
    assert {i: (n, kept) for i, n, kept in got} == {i: (len(gone), kept) for i, (gone, kept) in want.items()}


def _line(name, n=6):
    return " ".join(f"{name}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def test_documents_that_are_mostly_boilerplate_are_rejected(spark):
    shared, rows = [_line(f"shared{c}", 40) for c in "abcde"], []
    for size in (6, 12, 18, 24, 40):
        rows += [(1000 * size + i, "\n".join([*shared[:2], _prose(i, size), *shared[2:]]), f"own-{size}") for i in range(100)]
    # Groups of five share a paragraph.
    rows += [(i, "\n".join([_line("menu", 8), _prose(10**4 + i // 5, 60), _prose(2 * 10**4 + i, 30), _prose(3 * 10**4 + i, 30)]), "grouped") for i in range(100)]
    out = {r.doc.doc_id: r for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()}
    assert all(out[i].kept and out[i].removed == [0] for i in range(100))
    assert all(not r.kept and not r.base_failed and r.removed == [0, 1, 3, 4, 5] for i, r in out.items() if i >= 1000)


def test_copies_count_once_and_boilerplate_hides_none(spark):
    menu = [_line(f"menu{chr(97 + k)}") for k in range(8)]
    rows = [(i, "\n".join([*menu, _prose(i, 60)]), "a") for i in range(60)]
    lines = [_prose(500 + k, 12) for k in range(6)]
    rows += [(1000 + i, "\n".join(lines[i % 6 :] + lines[: i % 6]), "b") for i in range(60)]  # the same lines in other orders
    out = {r.doc.doc_id: r for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()}
    assert all(out[i].removed == list(range(8)) and out[i].kept for i in range(60))
    assert all(out[1000 + i].kept and not out[1000 + i].removed for i in range(60))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rel = con.execute(registry.oracle_sql()["op6_line_frequency"])
    names = [x[0] for x in rel.description]
    df = quality.op6_line_frequency(spark, "/root/testdata/sf0.01")
    assert sorted(names) == sorted(df.columns)
    want = sorted(rel.fetchall())
    assert sorted(map(tuple, df.select(*names).collect())) == want and len({x[names.index("kept")] for x in want}) == 2
