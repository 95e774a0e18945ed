"""Best-fit packing of token sequences by exact-complement hashing.

Only how many pieces there are of each length matters to a packing, and lengths end at the
capacity. So Spark counts pieces a length, the plan is made from at most ``capacity`` counts, and
Spark deals the pieces out: the r-th piece of a length takes the r-th place that the plan has for it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, scratch_dir
from .tokens import encoder, texts


@dataclass
class Plan:
    """Patterns: (lengths of a sequence's pieces, how many sequences have them)."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def places(self) -> np.ndarray:
        """Rows (length, first rank, pieces a sequence, first sequence, offset), in order of length and rank.

        A pattern that has a length m times gives it m places in each of its sequences, side by side.
        """
        rows, taken, sequence = [], Counter(), 0
        for lengths, times in self.patterns:
            offset = 0
            for length, m in sorted(Counter(lengths).items(), reverse=True):
                rows.append((length, taken[length], m, sequence, offset))
                taken[length] += m * times
                offset += length * m
            sequence += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


class _Sums:
    """Which available lengths fill a gap exactly: one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap < len(self.counts) and self.counts[gap] > 0 else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the largest longer length, which is ``most`` at most."""
        top, low = min(gap - 1, len(self.counts) - 1, most or gap), (gap + 1) // 2
        if top < low:
            return None
        longer = np.arange(top, low - 1, -1)
        free = np.minimum(self.counts[longer], self.counts[gap - longer]) > 0
        free &= (longer != gap - longer) | (self.counts[longer] > 1)
        return (int(longer[i]), gap - int(longer[i])) if free[i := int(free.argmax())] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in range(min(gap - 2, len(self.counts) - 1), (gap + 2) // 3 - 1, -1):
            if self.counts[a] > 0:
                self.counts[a] -= 1
                found = self.pair(gap - a, a)
                self.counts[a] += 1
                if found:
                    return (a, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts`` pieces of each length, 1 to ``capacity``, into as few sequences as it can.

    From the longest length down, combinations that fill the gap exactly are used up: single
    lengths before pairs before triples, each as often as the pieces last. What no combination
    fills is packed best-fit, longest first, into the fullest sequence that has room.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out, sums = Plan(capacity), _Sums(left)
    if left[capacity]:
        out.patterns.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rest: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            gap = capacity - length
            found = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            left[length] += 1
            if not found:
                rest.append((length, int(left[length])))
                break
            used = Counter((length, *found))
            times = min(int(left[k]) // m for k, m in used.items())
            for k, m in used.items():
                left[k] -= m * times
            out.patterns.append(((length, *found), times))
        left[length] = 0
    # Best fit over what is left: open sequences by room, as (pieces, how many sequences).
    room: dict[int, list[list]] = {}
    for length, n in rest:
        for space in sorted(s for s in room if s >= length):
            while n and room.get(space):
                pieces, times = room[space].pop()
                m = space // length
                full = min(times, n // m)
                parts = [(m, full)] + ([(n % m, 1)] if full < times and n % m else [])
                if full == 0 and n < m:
                    parts = [(n, 1)]
                done = 0
                for each, k in parts:
                    if k:
                        room.setdefault(space - each * length, []).append([pieces + (length,) * each, k])
                        n, done = n - each * k, done + k
                if done < times:
                    room[space].append([pieces, times - done])
            if not n:
                break
        if n:
            m = capacity // length
            for each, k in ((m, n // m), (n % m, 1)):
                if each and k:
                    room.setdefault(capacity - each * length, []).append([(length,) * each, k])
    out.patterns += [(tuple(pieces), times) for groups in room.values() for pieces, times in groups]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, by_word: bool = True) -> DataFrame:
    """Each document's ids and then ``end_id``, cut every ``capacity`` ids.

    Returns (key, piece, start, length, ids_crc32, chunk, nth) and, ``with_ids``, ids: array<int>;
    nth numbers the pieces of a length within a chunk, which is what one task made.
    """

    def cut(batches):
        import pyarrow as pa

        encode = encoder(tokenizer, by_word)
        end = np.array(end_id, encode.dtype).tobytes()
        chunk, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for row, raw in enumerate(encode.many(texts(batch, "text"))):
                ids = np.frombuffer(raw + end, encode.dtype)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for c, v in (("row", row), ("piece", piece), ("start", start), ("length", len(own)), ("ids_crc32", zlib.crc32(own.astype("<u4").tobytes())), ("nth", seen[len(own)])):
                        out[c].append(v)
                    seen[len(own)] += 1
                    if with_ids:
                        out["ids"].append(own.astype("i4"))
            of = {c: pa.array(out[c], t) for c, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))}
            of = {"key": batch.column("key").take(pa.array(out["row"], pa.int64()))} | of | {"chunk": pa.array([chunk] * len(out["row"]), pa.int32()), "nth": pa.array(out["nth"], pa.int64())}
            yield pa.RecordBatch.from_pydict(of | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {}))

    rows = boxed(docs).select(inside(key).alias("key"), inside(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, chunk int, nth long"
    return rows.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Give each piece of a table with length, chunk and nth its sequence_id and offset.

    The table must be a written one: chunk and nth are read more than once. Pieces of equal length
    change places freely, so ties and repeated rows need no order; no pieces give no rows.
    """
    spark = cut.sparkSession
    each = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = plan(counts, capacity).places()
    shared = spark.sparkContext.broadcast(places)  # some rows for each length: bounded by the capacity

    def find(batches):
        import pyarrow as pa

        table = shared.value
        # One sorted key for length and rank: ranks of all lengths laid end to end.
        most = int(table[:, 1].max(initial=0)) + 1
        starts = table[:, 0] * most + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * most + np.minimum(rank, most - 1), "right") - 1
            _, first, m, sequence, offset = table[at].T
            k = rank - first
            new = {"sequence_id": pa.array(sequence + k // np.maximum(m, 1)), "offset": pa.array(offset + k % np.maximum(m, 1) * length)}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "rank"} | new)

    ranked = cut.join(bases, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "chunk", "nth")
    kept = [f for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(find, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns a row a piece: (key, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A null or empty text is its end id alone; documents longer than the capacity are cut, the last
    piece may be shorter; repeated rows and null keys are documents like any other; an empty table
    gives no rows; a caller's columns may have any name.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, key, text, with_ids), f"{scratch_dir(docs.sparkSession)}/pieces")
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return place(cut, capacity).select(F.col("key").alias(key), *names)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` with production parameters."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
