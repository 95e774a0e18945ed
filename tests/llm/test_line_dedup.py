import random

import duckdb
from _brute import AWKWARD, clashing, frame, same_rows, without_repeated_runs
from pyspark.sql import functions as F

from spanlake.llm import line_dedup
from spanlake.llm._common import boxed, inside, numbered

SF = "/root/testdata/sf0.001"


def _run(spark, rows, min_words):
    docs = frame(spark, [(i, t, None) for i, t in rows])
    return {r.doc.doc_id: r.new_text for r in line_dedup.deduplicated(docs, min_words).collect()}


def test_random_runs_match_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 7, 12]))) for _ in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    for min_words in (1, 4, 10):
        got = _run(spark, rows, min_words)
        assert [got[i] for i, _ in rows] == without_repeated_runs(rows, min_words)


def test_documents_match_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = _run(spark, docs, 50)
    assert [got[i] for i, _ in docs] == without_repeated_runs(docs, 50)


def test_passages_and_copies(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    own = lambda i: " ".join(f"o{i}x{k}" for k in range(60))
    rows = [(1, f"{own(1)}\n{passage}"), (2, f"{passage}\n{own(2)}\nshort"), (3, own(1)), (4, f"{own(4)}\nshort"), (5, None), (6, "")]
    got = _run(spark, rows, 50)
    assert got[1] == rows[0][1] and got[2] == f"{own(2)}\nshort" and got[3] == "" and got[4] == rows[3][1] and got[5] is None and got[6] == ""
    kept = line_dedup.dedup_documents(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id for r in kept} == {1, 2, 4, 5, 6} and all(r.n_chars == len(r.text) for r in kept if r.text is not None)


def test_runs_of_any_earlier_place_go(spark):
    window, x, more = " ".join(f"w{k}" for k in range(50)), "another end", "eight words more that stand at two places"
    rows = [(1, f"{window}\n{x}"), (2, f"{window}\n{more}"), (3, f"{window}\n{more}"), (4, f"own words\n{window}\nand own")]
    assert _run(spark, rows, 50) == {1: rows[0][1], 2: more, 3: "", 4: "own words\nand own"}
    lines = ["one two three", "four five", "six seven eight", "nine ten"]
    rows = [(1, "\n".join(["before it", *lines])), (2, "\n".join([*lines, "after it"])), (3, "\n\n".join(["x", *lines, "after it", "y"]))]
    assert _run(spark, rows, 10) == {1: rows[0][1], 2: "after it", 3: "x\n\n\ny"}


def test_window_minima_are_fewer_than_lines_and_guaranteed(spark):
    rng = random.Random(5)
    docs = frame(spark, [(i, "\n".join(" ".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)), None) for i in range(20)])
    rows = boxed(docs).withColumn("_row", F.monotonically_increasing_id())
    found = line_dedup.windows(rows, inside("doc_id"), inside("text"), 50).cache()
    marks = {(r.row, r.at) for r in line_dedup.fingerprints(found).collect()}
    assert len(marks) < 0.5 * 20 * 60
    for r in found.collect():
        for w in (r.on, r.back):
            assert w is None or ((r.row, w.at) in marks and w["from"] <= w.at <= w.to)


def test_repeated_rows_nulls_empty_table_and_clashes(spark, tmp_path):
    text = " ".join(f"p{k}" for k in range(55))
    docs = frame(spark, [(None, text, None), (None, text, None), (7, text, None)])
    assert sorted(r.new_text for r in line_dedup.deduplicated(docs).collect()) == ["", "", text]
    assert line_dedup.deduplicated(frame(spark, [])).count() == line_dedup.dedup_documents(frame(spark, [])).count() == 0
    wide = clashing(docs, ["_row", "row", "of", "runs", "lines", "doc", "_of", "_runs", "n_lines", "new_text"])
    out = line_dedup.dedup_documents(wide)
    assert out.columns == wide.columns and same_rows(out, wide.limit(1))
    assert line_dedup.dedup_documents(wide.drop("n_chars")).columns == wide.drop("n_chars").columns
    assert numbered(boxed(wide), f"{tmp_path}/n", "row").count() == 3


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rel = con.execute(line_dedup.ORACLE_SQL)
    names = [x[0] for x in rel.description]
    df = line_dedup.op3_line_dedup(spark, "/root/testdata/sf0.01")
    assert sorted(names) == sorted(df.columns)
    want = sorted(rel.fetchall(), key=repr)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == want and sum(x[names.index("n_lines_removed")] > 0 for x in want) > 50
