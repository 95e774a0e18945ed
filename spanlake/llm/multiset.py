"""Homomorphic multiset hash of a document's paragraphs.

A paragraph (a line that has a word) hashes to a wide vector of 32-bit integers, and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2**32. So the order of paragraphs doesn't
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. The first is drawn uniformly from the paragraph's hash, so that different
multisets get different sums. The second counts the paragraph's 3-word shingles, each +1 or -1 in one
of its lanes: sums of such vectors keep their angles, so the cosine of two documents' second parts
estimates the share of text that they have in common, from the fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import texts

#: 32-bit lanes of the two parts.
EQUAL, LIKE = 32, 256
WORDS_KEPT, CHUNK = 250_000, 1 << 18


class Hasher:
    """Vectors of paragraphs and documents; one a worker, as it remembers the hashes of words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.words
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = xxh64_intdigest(w, 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def document(self, text: bytes | None) -> np.ndarray:
        """The sum of the vectors of a text's paragraphs. No paragraph: zero."""
        equal, like = np.zeros(EQUAL, np.uint32), np.zeros(LIKE, np.int64)
        for line in (text or b"").split(b"\n"):
            words = line.split()
            if not words:
                continue
            equal += np.frombuffer(b"".join(hashlib.blake2b(b" ".join(words), digest_size=64, person=bytes([k])).digest() for k in range(EQUAL // 16)), "<u4")
            for a in range(0, max(1, len(words) - 2), CHUNK):
                h = self._hashes(words[a : a + CHUNK + 2])
                h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:] * np.uint64(0x165667B19E3779F9) if len(h) > 2 else h.sum(keepdims=True)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                lane, up = (h >> np.uint64(40)).astype(np.int64) % LIKE, (h >> np.uint64(39) & np.uint64(1)).astype(np.int64)
                like += np.bincount(lane * 2 + up, minlength=2 * LIKE).reshape(-1, 2) @ np.array([-1, 1])
        return np.concatenate([equal, like.astype(np.uint32)])


_hasher: list[Hasher] = []


def vector(text: bytes | None) -> np.ndarray:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0].document(text)


def insert(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    """The fingerprint with one more paragraph."""
    return fingerprint + vector(paragraph)


def delete(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    """The fingerprint with one such paragraph fewer."""
    return fingerprint - vector(paragraph)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints. Without a shingle on either side nothing else is alike."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EQUAL:].view(np.int32).astype(np.float64) for v in (a, b))
    scale = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / scale))) if scale else 0.0


def as_string(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row's whole text; a null text counts as empty. Repeated rows come out
    as often, an empty table gives no rows, other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([as_string(vector(t)) for t in texts(batch, "text")], pa.string())], ["key", "fingerprint"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, place, key, text): rows in contiguous parts by key, each part ended by a copy of what follows it.

    Keys are numbers. Cut points are their quantiles; the copy is the first row of the next part that has one, and
    of the first part after the last. Rows of equal key lie in one part, in order of their texts'
    hashes; null keys come first.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("key", F.array(*(F.lit(k / parts) for k in range(1, parts))), 100 * parts)).first()[0]
    bounds = sorted({float(c) for c in cuts or []})
    tie = F.xxhash64("text")
    ranked = rows.withColumn("as_double", F.col("key").cast("double"))
    if bounds:
        bucket = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="as_double", outputCol="bucket", handleInvalid="keep")
        ranked = bucket.transform(ranked).withColumn("part", F.when(F.col("key").isNull(), -1).otherwise(F.col("bucket").cast("int"))).drop("bucket")
    else:
        ranked = ranked.withColumn("part", F.lit(-1))
    ranked = ranked.drop("as_double")
    order = F.struct("key", tie.alias("tie"))
    firsts = [r.part for r in ranked.select("part").distinct().orderBy("part").collect()]  # a row a part
    if not firsts:
        return ranked.select("part", F.lit(False).alias("copy"), "key", "text")
    least = ranked.groupBy("part").agg(F.min(order).alias("first"))
    before = F.create_map(*(F.lit(v) for k, p in enumerate(firsts) for v in (p, firsts[k - 1])))
    heads = F.broadcast(least.select(F.col("part").alias("of"), F.col("first.key").alias("head"), F.col("first.tie").alias("head_tie"), F.element_at(before, F.col("part")).alias("before")))  # a row a part
    found = ranked.join(heads, (F.col("part") == F.col("of")) & F.col("key").eqNullSafe(F.col("head")) & (tie == F.col("head_tie")), "left")
    own = F.struct("part", F.lit(False).alias("copy"))
    sent = found.select(F.explode(F.when(F.col("of").isNotNull(), F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("copy")))).otherwise(F.array(own))).alias("to"), "key", "text")
    return sent.select("to.part", "to.copy", "key", "text")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with the fingerprint of its edited text and of the next row's: see the query's contract.

    Of a part's rows only the one before is held. Rows of one key and one text are next to one another.
    A row alone in its table is followed by itself. Null texts count as empty, null keys come first, ties are in order of
    their texts' hashes, repeated rows come out as often, an empty table gives no rows; other columns are ignored, whatever their names.
    """
    sent = with_next(docs, key, text)
    kind = sent.schema["key"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column("part").to_pylist(), batch.column("copy").to_pylist(), batch.column("key").to_pylist(), texts(batch, "text"), strict=True)

        def pairs():
            """(key, text, vector, next text, next vector); copies only follow, and only the first of a part's copies counts."""
            last = None
            for part, copy, k, body in rows():
                if last and last[0] != part:
                    last = None
                if copy and last is None:
                    continue
                own = vector(body)
                if last:
                    yield last[1], last[2], last[3], body, own
                last = None if copy else (part, k, body, own)

        out: list[tuple] = []
        for k, body, own, after, after_own in pairs():
            points = body.decode()
            half = len(points) // 2
            changed = (points[: len(points) - half] + after.decode()[:half]).encode()
            new = vector(changed)
            out.append((k, len(points), hashlib.sha256(changed).hexdigest(), as_string(own), as_string(new), likeness(own, new), likeness(own, after_own)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(sent.schema["key"].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    laid = sent.withColumn("tie", F.xxhash64("text")).repartition("part").sortWithinPartitions("part", "copy", "key", "tie").select("part", "copy", "key", "text")
    return laid.mapInArrow(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
