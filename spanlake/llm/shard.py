"""Sharding by fixed virtual slots (DataFrame functions only).

A record is hashed into one of ``n_slots`` slots, for good. Bytes and rows are summed a slot. A
slot map, a stored table of (version, slot, shard), says where slots live: version 1 deals the slots
round robin, and each later version is the one before with a few slots moved. Sizes are balanced by
such an edit, and so is a grown number of shards. The map has ``n_slots`` rows however large the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, scratch_dir

N_SLOTS = 4096
#: A slot's rows are numbered in so many parts.
PARTS = 16
#: A shard may be this share above or below the mean before slots move.
TOLERANCE = 0.001


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 1: slots dealt round robin."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalanced(shard_of: list[int], load: list[int], n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until no shard is further than ``tolerance`` from the mean, or no move helps.

    Each edit moves, from the fullest shard to the emptiest, the slot that narrows their gap most;
    slots that needn't move stay. ``n_shards`` may exceed the shards in use: new ones then fill up.
    """
    shard_of, totals = list(shard_of), [0] * n_shards
    for slot, shard in enumerate(shard_of):
        totals[shard] += load[slot]
    mean = sum(totals) / n_shards
    for _ in range(4 * len(shard_of)):
        high, low = max(range(n_shards), key=lambda s: (totals[s], -s)), min(range(n_shards), key=lambda s: (totals[s], s))
        gap = totals[high] - totals[low]
        if totals[high] <= mean * (1 + tolerance) and totals[low] >= mean * (1 - tolerance):
            break
        movable = [slot for slot, shard in enumerate(shard_of) if shard == high and 0 < load[slot] < gap]
        if not movable:
            break
        slot = min(movable, key=lambda k: (abs(gap - 2 * load[k]), k))
        shard_of[slot] = low
        totals[high] -= load[slot]
        totals[low] += load[slot]
    return shard_of


def by_slot(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    """(slot, name): a row for each of the values, which are as many as slots."""
    listed = F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", name))


def save(spark: SparkSession, folder: str, version: int, shard_of: list[int]) -> None:
    """Add a version to the slot map kept in ``folder``; versions that are there stay as they are."""
    rows = by_slot(spark, shard_of, "shard").select(F.lit(version).alias("version"), "slot", F.col("shard").cast("int").alias("shard"))
    rows.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[int]]:
    """A version of the map, the newest one if none is named: its number, and the shard of each slot."""
    rows = spark.read.schema("slot int, shard int, version int").parquet(folder)
    wanted = version or rows.agg(F.max("version")).first()[0]
    found = rows.where(F.col("version") == wanted).orderBy("slot").collect()  # a row a slot
    if not found:
        raise ValueError(f"the slot map has no version {wanted}")
    return wanted, [r.shard for r in found]


def slotted(docs: DataFrame, n_slots: int, key: str, text: str, path: str) -> DataFrame:
    """(key, size, text_crc32, virtual_slot, part) of each row, written: its slot by key and text, and one of a slot's parts."""
    rows = boxed(docs)
    body = F.coalesce(inside(text), F.lit(""))
    rows = rows.select(inside(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("virtual_slot", F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(n_slots)).cast("int"))
    return materialize(rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")), path)


def rebalance(spark: SparkSession, folder: str, loads: list[int], n_shards: int, tolerance: float = TOLERANCE) -> int:
    """Edit the newest version of the map for these bytes a slot and so many shards; returns the version to use.

    A new version is saved only if a slot moves.
    """
    version, before = load(spark, folder)
    after = rebalanced(before, loads, n_shards, tolerance)
    if after == before:
        return version
    save(spark, folder, version + 1, after)
    return version + 1


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """Place every row in a shard so that the shards' bytes are near equal.

    Returns (key, size, text_crc32, virtual_slot, shard, position): size is the UTF-8 bytes of the
    text plus 1, position counts from 0 without gaps within a shard, slot by slot. ``maps`` is the
    folder of a slot map; its newest version is loaded, edited where the loads ask for it and saved as
    the next one, so that slots that needn't move stay where they were at the last call. Without
    it the map begins round robin, in a new folder. One call at a time may edit a folder's map.

    Null keys hash like any value; a null text counts as empty; an empty table gives no rows;
    repeated rows each get a place of their own; a caller's columns may have any name. Rows equal in
    key and text lie in one slot: if they hold more than a shard's share of all bytes, their shard exceeds the mean.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    rows = slotted(docs, n_slots, key, text, f"{folder}/rows")
    loads, counts = [0] * n_slots, {}
    for r in rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # n_slots x PARTS rows at most
        loads[r.virtual_slot] += r["size"]
        counts[r.virtual_slot, r.part] = r.n
    if maps is None:
        maps = f"{folder}/slot_map"
        save(spark, maps, 1, first_map(n_slots, n_shards))
    _, shard_of = load(spark, maps, rebalance(spark, maps, loads, n_shards))
    base, seen = [], [0] * n_shards  # rows of the shard in parts before
    for slot in range(n_slots):
        for part in range(PARTS):
            base.append(seen[shard_of[slot]])
            seen[shard_of[slot]] += counts.get((slot, part), 0)
    current = by_slot(spark, base, "base").select((F.col("slot") / PARTS).cast("int").alias("virtual_slot"), (F.col("slot") % PARTS).alias("part"), "base")
    current = current.join(F.broadcast(by_slot(spark, shard_of, "shard").withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
    # A part's rows are numbered in one task, however many rows a slot has; its base makes that the place in the shard.
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("key", "size", "text_crc32"))
    placed = rows.withColumn("place", place).join(F.broadcast(current), ["virtual_slot", "part"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "virtual_slot", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("place") - 1).alias("position"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law of near-equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
