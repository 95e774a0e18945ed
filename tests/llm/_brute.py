"""Plain Python versions of the operators, for comparison; and small inputs with awkward rows."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " ", "\n\n", "a", "É", "the end", "x " * 120, "one two three four five six " * 40, "same line\nsame line\nsame line", "tab\tvt\x0bff\x0ccr\rend", "#$% && <b>|*", "été nbsp word"]


def frame(spark, rows):
    """(doc_id, text, lang, source, n_chars) of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return out, out[0] < 50 or 100 * out[4] > 50 * out[0]


def without_repeated_runs(rows, min_words):
    """Texts of (key, text) rows, in order, without any run of lines of enough words that stands at an earlier place too."""
    flat = [[(at, " ".join(x.lower().split()), len(WORD.findall(x))) for at, x in enumerate((text or "").split("\n")) if WORD.search(x)] for _, text in rows]
    out = []
    for d, (_, text) in enumerate(rows):
        own, gone = flat[d], [False] * len(flat[d])
        for i in range(len(own)):
            for e in range(d + 1):
                for m in range(len(flat[e]) if e < d else i):
                    k = 0
                    while i + k < len(own) and m + k < len(flat[e]) and own[i + k][1] == flat[e][m + k][1]:
                        k += 1
                    if k and sum(x[2] for x in own[i : i + k]) >= min_words:
                        gone[i : i + k] = [True] * k
        # Blank lines between two lines that go, go too.
        lost = {at for i in range(len(own)) if gone[i] for at in range(own[i][0], own[i + 1][0] if i + 1 < len(own) and gone[i + 1] else own[i][0] + 1)}
        out.append(text if not lost else "\n".join(x for at, x in enumerate(text.split("\n")) if at not in lost))
    return out


def clashing(df, names):
    """``df`` with columns of these names, all of the value 'x'."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))


def same_rows(a, b):
    """The same rows, in any order."""
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def groups(values, linked):
    """Smallest index reachable from each, where linked(a, b)."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def by(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[n] for n in names)].append(r)
    return out
