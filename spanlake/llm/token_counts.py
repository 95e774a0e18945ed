"""Token counts by pre-tokens, without token ids.

A byte-level tokenizer first cuts a text into pre-tokens, and no token crosses one. So each distinct
pre-token of the corpus is encoded once, for its number of tokens; these numbers are joined to how
often each document has each pre-token, and summed. No ids are kept or moved.

Pre-tokens that many documents have would make hot keys of that join. Up to ``HOT`` of them, those most
frequent in a sample of documents, are encoded first and their numbers sent to all tasks, which add
them up at once; all others are joined. Where a pre-token is counted doesn't change what it counts.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, scratch_dir, unboxed
from .tokens import texts

#: About how many documents are read for the hot pre-tokens, how many of these are sent, and the characters of the longest.
SAMPLE, HOT, HOT_CHARS = 20_000, 300_000, 64
LIMIT = 1024
#: Pre-tokens of one call of the tokenizer.
CALL = 5000


class Pieces:
    """Cuts texts into pre-tokens and counts the tokens of each, by a ``tokenizers`` file of byte-level BPE.

    Other kinds of file (with a normaliser, another pre-tokenizer, or added tokens that strip what is
    around them) are refused with a ValueError. Truncation and padding are switched off; added tokens in
    a text are one token each.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        odd = spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
        if odd or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} can't be counted by pre-tokens")
        #: Texts of these characters only are cut by the same pattern here; the classes of others may differ between libraries.
        self.usual = regex.compile(r"[\t-\r\x20-\x7e\xa1-ɏ]*+")
        self.pattern = regex.compile(PATTERN)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None

    def __call__(self, text: str) -> tuple[int, list[str]]:
        """The number of added tokens in a text, and its pre-tokens."""
        parts = self.added.split(text) if self.added else [text]
        if self.usual.fullmatch(text):
            return len(parts) - 1, [p for part in parts for p in self.pattern.findall(part)]
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return len(parts) - 1, [part[a:b] for part in parts for _, (a, b) in cut(part)]

    def sizes(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        out = []
        for k in range(0, len(pieces), CALL):
            out += map(len, self.tokenizer.encode_batch_fast(pieces[k : k + CALL], add_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's cutter, kept between tasks."""
    return Pieces(path)


def counted(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, size) of a frame of distinct pre-tokens: the tokens of each."""

    def run(batches):
        import pyarrow as pa

        cutter = pieces(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(cutter.sizes(batch.column("piece").to_pylist()), pa.int64())], ["piece", "size"])

    return distinct.select("piece").mapInArrow(run, "piece string, size long")


def hot_pieces(rows: DataFrame, tokenizer: str, sample: int = SAMPLE, hot: int = HOT) -> dict[str, int]:
    """The tokens of the pre-tokens that the most rows of a sample have, ``hot`` at most, of ``HOT_CHARS`` at most."""
    share = sample / max(1, rows.count())
    some = rows.sample(share, seed=1) if share < 1 else rows  # by row, as copies may be a third of all

    def run(batches):
        import pyarrow as pa

        cutter = pieces(tokenizer)
        for batch in batches:
            seen: Counter[str] = Counter()
            for body in texts(batch, "text"):
                seen.update(set(cutter(body.decode())[1]) if body else ())
            short = [(p, n) for p, n in seen.items() if len(p) <= HOT_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["piece", "n"])

    met = some.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    top = met.orderBy(F.desc("n"), "piece").limit(hot)
    found = counted(top, tokenizer).toArrow()  # HOT rows at most
    return dict(zip(found["piece"].to_pylist(), found["size"].to_pylist(), strict=True))


def frequencies(rows: DataFrame, tokenizer: str, known: dict[str, int]) -> DataFrame:
    """(row, doc, n_bytes, n, pieces, times) of each row of (doc, text): a number of its own, the bytes of its
    text, the tokens of its added tokens and ``known`` pre-tokens, and its other pre-tokens with how often each stands.

    The numbers of a plan that runs again may differ: write it.
    """
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        cutter, sizes, row = pieces(tokenizer), sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            n_bytes, n, own, times, ends = [], [], [], [], [0]
            for body in texts(batch, "text"):
                total, cut = cutter(body.decode()) if body else (0, [])
                for piece, k in Counter(cut).items():
                    size = sizes.get(piece)
                    if size is None:
                        own.append(piece)
                        times.append(k)
                    else:
                        total += size * k
                n_bytes.append(len(body or b""))
                n.append(total)
                ends.append(len(own))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(own, pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
            numbers = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([numbers, batch.column("doc"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), *lists], ["row", "doc", "n_bytes", "n", "pieces", "times"])

    return rows.mapInArrow(run, f"row long, doc {rows.schema['doc'].dataType.simpleString()}, n_bytes long, n long, pieces array<string>, times array<long>")


def count_tokens(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The tokens of each row's whole text: doc (a struct of the columns ``keep``), n_bytes, n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens; repeated rows come out as often as they stand; an
    empty table gives no rows; columns may have any name.
    """
    folder = scratch_dir(docs.sparkSession)
    rows = boxed(docs).select(F.struct(*unboxed(keep)).alias("doc"), inside(text).alias("text"))
    known = materialize(frequencies(rows, tokenizer, hot_pieces(rows, tokenizer)), f"{folder}/frequencies")
    each = known.select("row", F.explode(F.arrays_zip("pieces", "times")).alias("p")).select("row", F.col("p.pieces").alias("piece"), F.col("p.times").alias("times"))
    sizes = materialize(counted(each.select("piece").distinct(), tokenizer), f"{folder}/sizes")
    rest = each.join(sizes, "piece").groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * F.col("size")).alias("more"))
    out = known.select("row", "doc", "n_bytes", "n").join(rest, F.col("row") == F.col("of"), "left")
    total = F.col("n") + F.coalesce("more", F.lit(0).cast("long"))
    return out.select("doc", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json")).select(inside("doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
