"""The encoder by words against encoding each whole text."""

import random

import public_tokenizers
import pytest

from spanlake.llm.tokens import Encoder

RAW = ["It's he'd can't. don't,.. x<|endoftext|>y A<|startoftext|> B", "İstanbul Åb. é.,é é, a·b ÷. ß.x ", "n°5 1,234.5 ab12cd. (x) [y] --z ﬁne. ǅ. 한글. 漢字,", "a b c\u0085d é Å. é, f̸", "it'S. we'LL, '.'s x'.s ab.'s ab,'t end*** end.&& (end)", "", " \n", None]


TEXTS = [t if t is None else t.encode() for t in RAW]


def test_words_encode_as_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Encoder(path, by_word=False)
    by_word = Encoder(path)
    assert list(by_word.many(TEXTS)) == list(whole.many(TEXTS))
    assert list(by_word.many(TEXTS * 2)) == list(whole.many(TEXTS * 2))  # from what it has learnt
    assert list(by_word.many([])) == []


def test_random_texts_and_whole_documents(spark):
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    pool = [*"abzéÄßñ÷×ÀÿµN019 \n\t\x0b.,;:!?*$&%#)]}/-\"'`(<|>_=+~^\u00a0\u200b", "<|endoftext|>", "'s", "n't", " ", "é", "漢"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))).encode() for _ in range(5000)]
    texts += [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    assert list(Encoder(path).many(texts)) == list(Encoder(path, by_word=False).many(texts))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert next(Encoder(public_tokenizers.path("byte_bpe_50k.json"), by_word=False).many([b"Two words"]))
