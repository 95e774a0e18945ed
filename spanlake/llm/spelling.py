"""Spelling variants: words at edit distance one, and the frequent form that a rare one stands for.

The vocabulary is joined with itself as a trie. Each node of a trie has its active nodes: those whose
strings are within distance one of its own. A child's follow from its parent's, so prefixes that words
share are compared once, and where two words end at nodes that are active for one another, at distance
one and not zero, a pair is emitted.

The trie is partitioned so that no part grows with the vocabulary. Words near one another are as long
or differ by one in length, so the shorter one's length is the first part of the key. Of the place where
they differ, either the half before or the half after is shared: the words of a part with equal first
halves make a part, and those with equal last halves one more (a trie read from its other end). A part
with more than ``MOST`` characters is cut in the same way again within what is left between the shared
ends; where that is one character, or two of the longer words, there are no more words than an alphabet
allows. Each pair belongs to one of the parts that it comes to lie in, and is emitted there alone.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, scratch_dir, small_side
from .tokens import texts

#: Runs of letters, over UTF-8 bytes of lower-cased text (U+00C0 to U+00FF are C3 80 to C3 BF).
RUN = rb"(?:[a-z]|\xC3[\x80-\xBF])+"
#: One run in so many loses a code point.
NOISE = 199
#: The least code points and occurrences of a word, and how many times as frequent its form is.
MIN_CHARS, MIN_N, TIMES = 6, 5, 5
#: Characters, but the shared ones, of a part that isn't cut again; distinct runs that a task holds before
#: it passes on their counts, and pairs that it passes on together.
MOST, HELD, PASSED_ON = 400_000, 200_000, 10_000


def dropped(run: bytes, h: int) -> bytes:
    """A run without its code point h modulo its length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, min_chars: int = MIN_CHARS, min_n: int = MIN_N) -> DataFrame:
    """(word, n) of all texts: the words of at least ``min_chars`` code points and ``min_n`` occurrences.

    In every text each run whose ``crc32("<key>:<run>")`` is divisible by ``noise`` loses a code point
    first (no run does if ``noise`` is 0). A null text has no words, a null key counts as an empty one;
    rows that are repeated count as often; an empty table gives no rows; columns may have any name.
    """
    rows = boxed(docs).select(F.concat(F.coalesce(inside(key).cast("string"), F.lit("")), F.lit(":")).alias("name"), inside(text).alias("text"))

    def run(batches):
        import re

        import pyarrow as pa

        runs, total = re.compile(RUN), Counter()

        def out():
            found = [(w.decode(), n) for w, n in total.items()]
            found = [(w, n) for w, n in found if len(w) >= min_chars]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for batch in batches:
            for body, name in zip(texts(batch, "text"), batch.column("name").to_pylist(), strict=True):
                own, seed = Counter(runs.findall((body or b"").lower())), zlib.crc32(name.encode())
                if noise:
                    odd = [(w, h) for w in own if not (h := zlib.crc32(w, seed)) % noise]
                    for w, h in odd:
                        total[dropped(w, h)] += own.pop(w)
                total.update(own)
                if len(total) > HELD:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


# Parts --------------------------------------------------------------------------------------------


def _half(left):
    """Of so many characters of the shorter word how many a half is, at least one end of which is shared."""
    return (left / 2).cast("int") if isinstance(left, Column) else left // 2


KEY = ("shorter", "head", "tail", "shared")


def parts(words: DataFrame, folder: str, most: int = MOST) -> DataFrame:
    """(shorter, head, tail, shared, word, n): the words of each part, from a written table of (word, n).

    shorter is the length of its shorter words, head and tail the number of characters that all share at
    their beginning and end, and shared those characters.
    """
    size = F.char_length("word")
    # Each word is among those of its own length and the longer ones of the length below.
    open_ = words.select(F.explode(F.array(size, size - 1)).alias("shorter"), F.lit(0).alias("head"), F.lit(0).alias("tail"), "word", "n").where("shorter > 0")
    out, k = None, 0
    while True:
        left = F.col("shorter") - F.col("head") - F.col("tail")
        sides = F.array(F.struct((F.col("head") + _half(left)).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + _half(left)).alias("tail")))
        cut = open_.select("shorter", "word", "n", F.explode(F.array_distinct(sides)).alias("s")).select("shorter", "s.*", "word", "n")
        cut = cut.select("shorter", "head", "tail", F.concat(F.expr("left(word, head)"), F.expr("right(word, tail)")).alias("shared"), "word", "n")
        left = F.col("shorter") - F.col("head") - F.col("tail")
        large = cut.groupBy(*KEY).agg(F.sum(F.char_length("word") - F.col("head") - F.col("tail")).alias("chars")).where((F.col("chars") > most) & (left > 1))
        large = small_side(materialize(large.select(*KEY), f"{folder}/large-{k}"))
        settled = cut.join(large, list(KEY), "left_anti")
        out = settled if out is None else out.union(settled)
        open_ = materialize(cut.join(large, list(KEY), "left_semi").drop("shared").distinct(), f"{folder}/open-{k}")
        k += 1
        if not open_.limit(1).count():
            return out


def belongs(shorter: int, head: int, tail: int, common: int) -> bool:
    """Whether a pair whose first ``common`` characters agree belongs to a part, and not to another that has both words.

    Of two halves that a pair shares it belongs to the first.
    """
    a = b = 0
    while (a, b) != (head, tail):
        half = _half(shorter - a - b)
        if common >= a + half:
            a += half
        else:
            b += half
        if a > head or b > tail or not half:
            return False
    return True


# Tries --------------------------------------------------------------------------------------------


def trie_pairs(words: list[str]):
    """The pairs (x, y) of places in a list of distinct words that are at edit distance one.

    Nodes are numbered in the order of a depth-first walk. A node's active nodes are held as
    {node: distance} while the walk is below it, so there are as many such sets as words are long.
    """
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for k, word in enumerate(words):
        at = 0
        for c in word:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = nxt
        ends[at] = k
    root = {0: 0} | dict.fromkeys(children[0].values(), 1)
    stack = [(c, node, root) for c, node in children[0].items()]
    while stack:
        c, node, above = stack.pop()
        active: dict[int, int] = {}
        for other, d in above.items():
            if d == 0:
                active[other] = 1  # c is inserted
            for e, child in children[other].items():
                if e == c:
                    if active.get(child, 2) > d:
                        active[child] = d
                elif d == 0:
                    active.setdefault(child, 1)  # c is replaced
        # What follows a node at distance zero is at distance one: a character of the other is left out.
        for other in [o for o, d in active.items() if d == 0]:
            for child in children[other].values():
                active.setdefault(child, 1)
        if ends[node] >= 0:
            for other, d in active.items():
                if d == 1 and ends[other] >= 0 and other < node:
                    yield ends[node], ends[other]
        stack.extend((e, child, active) for e, child in children[node].items())


def part_pairs(shorter: int, head: int, tail: int, words: list[str]):
    """The pairs of places in a part's words that belong to it. The trie begins at the end that the words share."""
    middles = [w[head : len(w) - tail][:: -1 if tail > head else 1] for w in words]
    for x, y in trie_pairs(middles):
        a, b = words[x], words[y]
        if min(len(a), len(b)) == shorter and belongs(shorter, head, tail, next((k for k in range(shorter) if a[k] != b[k]), shorter)):
            yield x, y


def pairs(parted: DataFrame) -> DataFrame:
    """(word, near, near_n) of each word of the parts and each word near it, both ways, once each."""

    def run(batches):
        from itertools import groupby

        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*KEY, "word", "n")), strict=True)

        found: tuple[list, list, list] = ([], [], [])

        def out():
            record = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["word", "near", "near_n"])
            for column in found:
                column.clear()
            return record

        for key, group in groupby(rows(), key=lambda r: r[:4]):
            part = list(group)
            if len(part) > 1:
                words = [r[4] for r in part]
                for x, y in part_pairs(*key[:3], words):
                    for column, both in zip(found, ((words[x], words[y]), (words[y], words[x]), (part[y][5], part[x][5])), strict=True):
                        column.extend(both)
            if len(found[0]) >= PASSED_ON:
                yield out()
        yield out()

    return parted.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, "word string, near string, near_n long")


# Forms and roots ------------------------------------------------------------------------------------


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(from, root) of each word with a form, from a written table of (word, form): the last word that its forms lead to.

    Each round doubles the steps taken; as a form is ``TIMES`` as frequent as its word, chains are short.
    """
    at, k = forms.select(F.col("word").alias("from"), F.col("form").alias("root")), 0
    while True:
        onward = at.select(F.col("from").alias("of"), F.col("root").alias("further"))
        step = at.join(onward, F.col("root") == F.col("of"), "left")
        step = materialize(step.select("from", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{folder}/roots-{k}")
        at, k = step.select("from", "root"), k + 1
        if not step.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n) of distinct words.

    n_near counts the words that differ by exactly one inserted, deleted or replaced code point. form is
    the most frequent of them, the first in code-point order of equals, if its n is at least ``times``
    the word's, else null. root is the word that forms lead to in the end, the word itself if it has none.
    Words are neither null nor empty and ``times`` is above 1; an empty table gives no rows; other columns are left out.
    """
    folder = scratch_dir(words.sparkSession)
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), f"{folder}/words")
    found = pairs(parts(words, folder, most)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("best"))
    known = words.join(found.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    known = known.withColumn("best", F.when(-F.col("best.order") >= times * F.col("n"), F.col("best")))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))
    known = materialize(known, f"{folder}/forms")
    last = roots(known.where("form is not null"), folder)
    return known.join(last, F.col("word") == F.col("from"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, their near words and forms."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
