"""Fill-in-middle: a text's middle part is moved to its end, marked by sentinels.

One Aho-Corasick automaton goes over each whole text and finds its events: the ASCII white space at which
the class of a character changes, and the sentinels. What lies between two events is a gap without
either, so its units follow from its length: as many code points as it is long, one word, or no line
end. A table of the gaps' first units and places is all that the lookup of a unit by its rank needs.

A sentinel in a text would make the result ambiguous; such a text stays plain.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, small_batches, unboxed
from .tokens import texts

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: The characters at which a unit may end, and the marks of sentinels among the events.
CHANGES = {"char": " \t\n\x0b\x0c\r", "word": " \t\n\x0b\x0c\r", "line": "\n", "none": ""}
SENTINEL = 1
#: Of a hundred texts so many stay plain, and of a hundred others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: Events taken from the automaton at a time.
EVENTS = 1 << 16


class Scan:
    """A text's events, and the places of its units: code points (``char``), runs without white space (``word``) or ``line``.

    ``none`` finds sentinels only.
    """

    def __init__(self, text: str, unit: str = "char"):
        self.size, found = len(text), automaton(unit).iter(text)
        ends, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while some := list(islice(found, EVENTS)):
            pairs = np.array(some, np.int64)
            ends.append(pairs[:, 0])
            kinds.append(pairs[:, 1])
        end, kind = np.concatenate(ends), np.concatenate(kinds)
        #: Places of the class-changing characters, and (place, sentinel) of the sentinels.
        self.changes = end[kind == 0]
        self.sentinels = [(int(e) + 1 - len(SENTINELS[k - SENTINEL]), SENTINELS[k - SENTINEL]) for e, k in zip(end[kind > 0], kind[kind > 0], strict=True)]
        start = np.concatenate([[0], self.changes + 1])
        gap = np.concatenate([self.changes, [self.size]]) - start
        if unit == "word":
            start = start[gap > 0]
        # The number of the first unit of each gap, and of all units.
        self.start, self.first = start, start if unit == "char" else np.arange(len(start))
        self.n = self.size if unit == "char" else len(start) - (unit == "line" and not gap[-1])

    def place(self, rank: int) -> int:
        """The code point at which the unit of a rank begins; the text's end for the number of all."""
        if rank >= self.n:
            return self.size
        k = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.start[k] + rank - self.first[k])

    def in_word(self, place: int) -> bool:
        """Whether a cut at a place parts two characters other than white space."""
        k = int(np.searchsorted(self.changes, place - 1))
        return 0 < place < self.size and not (k < len(self.changes) and self.changes[k] <= place)


@lru_cache
def automaton(unit: str):
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        out.add_word(c, 0)
    for k, sentinel in enumerate(SENTINELS):
        out.add_word(sentinel, SENTINEL + k)
    out.make_automaton()
    return out


def moved(text: str, name: str, unit: str = "char", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST):
    """(units, form, cuts, output) of a text; ``name`` is hashed for where it is cut and whether it is moved.

    cuts are the code points at which the prefix and the middle end, None if the text stays plain.
    """
    h = np.frombuffer(sha256(name.encode()).digest()[:16], ">u4").tolist()
    scan = Scan(text, unit)
    if not text or scan.sentinels or h[2] % 100 >= 100 - plain:
        return scan, "plain", None, text
    a, b = (scan.place(r) for r in sorted(x % (scan.n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return scan, "spm", (a, b), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return scan, "psm", (a, b), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def unmoved(output: str, form: str) -> str:
    """The text that ``moved`` made an output of a form from."""
    if form == "plain":
        return output
    (_, _), (second, _), (last, _) = Scan(output, "none").sentinels
    one, two, middle = output[len(PREFIX) : second], output[second + len(SUFFIX) : last], output[last + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def transform(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The output of each row: doc (a struct of the columns ``keep``), n (units), form, prefix_chars,
    middle_chars (code points), cuts_in_word (how many of its cuts part a word) and output.

    Where a text is cut follows from ``<seed>:<key>``, so reruns agree and repeated rows are cut alike; a
    null key counts as an empty one. A null or empty text is empty and plain. A plain text has null
    chars and cuts. Texts of any length go through whole; an empty table gives no rows; columns may have
    any name.
    """
    rows = boxed(docs).select(F.struct(*unboxed(keep)).alias("doc"), F.concat(F.lit(f"{seed}:"), F.coalesce(inside(key).cast("string"), F.lit(""))).alias("name"), inside(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, forms, prefix, middle, words, outputs = [], [], [], [], [], []
            for body, name in zip(texts(batch, "text"), batch.column("name").to_pylist(), strict=True):
                scan, form, cuts, output = moved(body.decode() if body else "", name, unit, plain, suffix_first)
                n.append(scan.n)
                forms.append(form)
                prefix.append(cuts and cuts[0])
                middle.append(cuts and cuts[1] - cuts[0])
                words.append(cuts and sum(map(scan.in_word, cuts)))
                outputs.append(output)
            columns = [batch.column("doc"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(words, pa.int64()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "form", "prefix_chars", "middle_chars", "cuts_in_word", "output"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, cuts_in_word long, output string"
    return rows.mapInArrow(run, schema)


def restored(moved_rows: DataFrame) -> DataFrame:
    """Add ``restored``, the text rebuilt from ``output`` and ``form``, to a frame of ``transform``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            back = [unmoved(o.decode(), f) for o, f in zip(texts(batch, "output"), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, "restored"])

    return moved_rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved_rows.schema) + ", restored string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their middles moved and put back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        out = restored(transform(docs, ["doc_id"]))
        return out.select(inside("doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"), "cuts_in_word")


def _h(k: int) -> str:
    return f"CAST('0x' || substr(s, {8 * k + 1}, 8) AS UBIGINT)"


_CLEAN = "NOT contains(t, '<P>') AND NOT contains(t, '<S>') AND NOT contains(t, '<M>')"
_IN_WORD = "CASE WHEN {0} > 0 AND {0} < n AND regexp_matches(substr(t, {0}, 2), '^[^\\x20\\x09-\\x0D]{{2}}$') THEN 1 ELSE 0 END"
#: DuckDB SQL for the query's rows.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST({_h(0)} % (n + 1) AS BIGINT) AS c1, CAST({_h(1)} % (n + 1) AS BIGINT) AS c2, CASE WHEN t = '' OR NOT ({_CLEAN}) OR {_h(2)} % 100 >= {100 - PLAIN} THEN 'plain' WHEN {_h(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256, CAST(CASE WHEN form <> 'plain' THEN {_IN_WORD.format("a")} + {_IN_WORD.format("b")} END AS BIGINT) AS cuts_in_word FROM p"""
