"""Token counts against the library on each whole text."""

import random

import public_tokenizers
import pytest
from _brute import AWKWARD, clashing, frame
from tokenizers import Tokenizer

from spanlake.llm import token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def brute(rows):
    out = []
    for key, text, _ in rows:
        n = len(WHOLE.encode(text or "", add_special_tokens=False).ids)
        out.append((key, len((text or "").encode()), n, n > 1024))
    return sorted(out, key=str)


def counted(df):
    return sorted(((r.doc.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, ["doc_id"], PATH).collect()), key=str)


def odd_texts():
    rng = random.Random(5)
    pool = [*"abzÉé019 \n\t\x0b\x1c\x1f\x85\r.,'\"<|>_ ­​ 　", "<|endoftext|>", "'s", "'ve", " ", "  ", "漢字", "한글", "\U0001f600", "é", "ß", "ǅ", "\U00010d4e", "٣", "Ⅷ", "²"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]


@pytest.mark.parametrize("hot", [token_counts.HOT, 0])
def test_counts_as_the_library(spark, monkeypatch, hot):
    monkeypatch.setattr(token_counts.hot_pieces, "__defaults__", (token_counts.SAMPLE, hot))
    texts = [*AWKWARD, *odd_texts(), None, "", "<|endoftext|>" * 3, " " * 5000, "x" * 5000, "<|endoftext|", "a<|endoftext|> b <|endoftext|>\n"]
    rows = [(i if i % 7 else None, t, "s") for i, t in enumerate(texts)] + [(3, "twice", "s"), (3, "twice", "s")]
    assert counted(frame(spark, rows)) == brute(rows)


def test_sample_of_hot_pieces_is_bounded(spark):
    rows = frame(spark, [(i, f"the same words word{i}", "s") for i in range(400)]).selectExpr("text")
    assert len(token_counts.hot_pieces(rows, PATH, 400, 2)) == 2
    assert set(token_counts.hot_pieces(rows, PATH, 100, 9)) >= {"the", " same", " words"}


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op11_token_counts(spark, SF).collect()]
    assert sorted(got, key=str) == brute(docs) and {r[3] for r in got} == {True, False}


def test_empty_and_clashing(spark):
    assert not counted(frame(spark, []))
    rows = [(1, "one two two", "s"), (2, "two", None)]
    assert counted(clashing(frame(spark, rows), ["row", "doc", "pieces", "piece", "times", "n", "size"])) == brute(rows)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Pieces(public_tokenizers.path("word_bpe_49k.json"))
