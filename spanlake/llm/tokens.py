"""Token ids of whole texts by a public tokenizer file, for Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words that a worker keeps with their ids.
KEPT = 500_000
#: Bytes of text that are encoded together, and words of one call of the tokenizer.
TOGETHER, CALL = 1 << 20, 2000
PROBES = ["Two  words,\tA line\nend.".encode(), "it's x'S.y (An) über. Éa, 12.5%".encode(), "wordsword's word...\n\n Word".encode()]
#: By byte: symbols that make a token run of their own after a letter (an apostrophe may begin a suffix
#: instead), white space, letters, and the second bytes of letters after 0xC3.
_TAIL, _WHITE, _LETTER, _SECOND = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".,;:!?*$&%#)]}/-\"", b" \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", bytes([*range(0xA0, 0xB7), *range(0xB8, 0xC0)])))


def split_tails(texts: list[bytes]) -> list[bytes]:
    """The texts, in lower case, with a blank before each run of tail symbols that follows a letter and ends its word.

    Such a run is a token run of its own, so it may be encoded apart.
    """
    if not texts:
        return []
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    tail, white = _TAIL[data], _WHITE[data]
    letter = _LETTER[data]
    letter[1:] |= _SECOND[data[1:]] & (data[:-1] == 0xC3)
    begins = np.flatnonzero(tail[1:] & letter[:-1]) + 1
    ends = np.flatnonzero(white[1:] & tail[:-1]) + 1  # of the runs that end a word
    # A run that begins after a letter ends its word if no byte but tail symbols lies before the next end.
    others = np.cumsum(~tail, dtype=np.int64)
    after = ends[np.minimum(np.searchsorted(ends, begins), max(0, len(ends) - 1))] if len(ends) else begins * 0
    begins = begins[(after > begins) & (others[after - 1] == others[begins - 1])]
    line = np.insert(data, begins, 32).tobytes()
    stops = np.cumsum([len(t) + 1 for t in texts])
    stops += np.searchsorted(begins, stops)
    return [line[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


class Encoder:
    """Encodes texts with a ``tokenizers`` file; ids come as little-endian bytes of ``dtype``.

    ``by_word`` is for vocabularies that lower-case, drop white space, never merge across it and mark
    the last token of each run of letters (word_bpe_49k.json): each distinct word is then encoded once
    a worker, at any text length; ValueError if a probe shows a vocabulary to be of another kind.
    Otherwise each whole text is encoded as it stands.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

        if by_word and (not self.last.any() or any(x != self._encode(t) for x, t in zip(self.many(PROBES), PROBES, strict=True))):
            raise ValueError(f"{path} can't be encoded word by word")

    def _encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode runs of letters many at a call: each one ends with the only token that is marked as last."""
        alone = []
        together = []
        for word in words:
            (together if word.decode().isalpha() else alone).append(word)
        for a in range(0, len(together), CALL):
            some = together[a : a + CALL]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # one of them is not a single run to the tokenizer
                alone += some
                continue
            raw, at = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
            self.words.update((word, raw[x:y]) for word, x, y in zip(some, at[:-1], at[1:], strict=True))
        for word in alone:
            self.words[word] = self._encode(word)

    def _encode_words(self, some: list[bytes]) -> list[bytes]:
        # What may be a special token keeps its case, which matters to it, and its tails.
        plain = iter(split_tails([t.lower() for t in some if b"<|" not in t]))
        split = [(t if b"<|" in t else next(plain)).split() for t in some]
        if len(self.words) > KEPT:
            self.words.clear()
        new = set().union(*split).difference(self.words)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def many(self, bodies: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, null as empty."""
        if not self.by_word:
            yield from (self._encode(t) if t else b"" for t in bodies)
            return
        some, size = [], 0
        for body in bodies:
            some.append(body or b"")
            size += len(some[-1])
            if size >= TOGETHER:
                yield from self._encode_words(some)
                some, size = [], 0
        yield from self._encode_words(some)

    def __call__(self, text: bytes | None) -> bytes:
        return next(self.many([text]))


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool = True) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path, by_word)


def texts(batch, column: str):
    """The UTF-8 bytes of an Arrow batch's text column; None for null."""
    import pyarrow as pa

    return batch.column(column).cast(pa.binary()).to_pylist()
