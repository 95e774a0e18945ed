"""Near copies by similarity of word shingles, for the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of 5-word shingles is at least 0.8.
Candidates come from two sides and each is checked by its sets. SimHash fingerprints of the shingles
are linked by anchor-point covering, as in ``simhash``. At a similarity of 0.8 fingerprints differ by
some 10 bits of 64, beyond any radius whose replicas can be paid for, so the others are found by their
shingles: put in any one order, two sets this much alike share one of the first n // 5 + 1 of each.
So no pair is missed. The order puts shingles that a sample shows to be frequent last, which keeps
the sets that share a first shingle few.

The pairs of sets that share a first shingle are not all made, since only the groups count. Each
shingle has a hub, the set in which it comes earliest: of a text and its copies that is the text, as a
copy's own shingles come first in it. All others are compared with the hub, and what is alike is one group.
Only between sets that still lie in different groups are the other pairs compared: first with a second
hub, and so on while that joins groups and more pairs than rows are left, then all.

Most pairs only share a passage. An odd sketch of each set, a bit for the parity of each hash bucket,
tells them at a hundredth of the set's size: two sets differ by no less than their sketches do. A
sketch folded to 256 bits goes with the rows, so that such pairs aren't made at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import boxed, forget, inside, materialize, scratch_dir, small_side, unboxed
from .tokens import texts

WIDTH, SEED = 5, 42
#: Documents in the sample that orders the shingles, how often one must be met there, and how many are kept.
SAMPLE, SAMPLE_MIN, SAMPLE_KEPT = 10_000, 3, 200_000
#: Words of a sketch folded to the length that all have.
SHORT = 4
#: Pairs a row that are compared without another hub.
PAIRS_A_ROW = 50
#: Sets that a task remembers as met.
SEEN = 1_000_000


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of the hashes of a text's shingles; a shorter text is one, a wordless one has none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = max(1, len(words) - WIDTH + 1)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + WIDTH]), SEED) for i in range(runs)), np.uint64, runs))


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sets(rows: DataFrame) -> DataFrame:
    """(t1, t2, hs) of (t1, t2, text): the shingles of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), _lists([shingles(x) for x in texts(batch, "text")])], ["t1", "t2", "hs"])

    return rows.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, hs array<long>")


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), by hash, of the most frequent shingles of a sample of the texts."""
    step = max(1, rows.count() // SAMPLE)
    some = sets(rows.where(F.pmod("t1", F.lit(step)) == 0)).select(F.explode("hs").alias("h"))
    top = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_MIN).orderBy(F.desc("n"), "h").limit(SAMPLE_KEPT).toArrow()
    hashes, counts = np.asarray(top["h"]).view(np.uint64), np.asarray(top["n"])
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def odd_sketch(hs: np.ndarray) -> np.ndarray:
    """For a set of n hashes 64-bit words of n bits or up to twice as many, a power of two and ``SHORT`` words at
    least: whether each bit's hashes are odd in number."""
    bits = max(64 * SHORT, 64 << max(0, (len(hs) - 1).bit_length() - 6))
    return np.packbits(np.bincount((hs & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def sketched(rows: DataFrame) -> DataFrame:
    """(t1, t2, fp, own, n, odd, prefix): SimHash, hash of the set, its size, odd sketch and first shingles in the common order,
    the last for one row of a set in each task."""
    hashes, counts = frequent(rows)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for batch in batches:
            fp, own, size, odd, first = [], [], [], [], []
            for hs in (shingles(x) for x in texts(batch, "text")):
                bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fp.append(int.from_bytes(np.packbits(2 * bits > len(hs), bitorder="little").tobytes(), "little"))
                own.append(xxh64_intdigest(hs.tobytes(), SEED) if len(hs) else 0)
                size.append(len(hs))
                odd.append(odd_sketch(hs))
                rank = np.zeros(len(hs), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, hs), len(hashes) - 1)
                    rank = np.where(hashes[at] == hs, counts[at], 0)
                # A set that the task has met before has given its first shingles; if it has been forgotten it gives them again.
                if len(seen) >= SEEN:
                    seen.clear()
                first.append(hs[:0] if own[-1] in seen else hs[np.lexsort((hs, rank))[: len(hs) // 5 + 1]])
                seen.add(own[-1])
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, own)]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *longs, pa.array(size, pa.int32()), _lists(odd), _lists(first)], ["t1", "t2", "fp", "own", "n", "odd", "prefix"])

    return rows.mapInArrow(run, "t1 long, t2 long, fp long, own long, n int, odd array<long>, prefix array<long>")


def _sided(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in columns))


#: Of sets of n_a and n_b shingles: neither is too small for the other; and if a shingle is the first that they share, what is
#: left of either from its place on may be enough. So a pair is made at the first one, and at few others.
SIZES = "5L * n_a >= 4L * n_b AND 5L * n_b >= 4L * n_a"
MET = ("h", "own", "at", "n", "of")
ENOUGH = "9L * least(n_a - at_a, n_b - at_b) >= 4L * (n_a + n_b)"


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): the pairs a < b of sets whose fingerprints are linked, from a written table of classes."""
    edges = simhash.links(classes.select("fp").distinct(), halves=True)
    near = edges.join(_sided(classes, "a", "fp", "own", "n"), F.col("a") == F.col("fp_a")).join(_sided(classes, "b", "fp", "own", "n"), F.col("b") == F.col("fp_b"))
    return near.where(SIZES).select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b"))


def by_hub(met: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b): the pairs a < b of each set of ``met`` (h, own, at, n, of) and the hub of a shingle it has, if of another group."""
    near = _sided(met, "a", *MET).join(_sided(hubs, "b", *MET), F.col("h_a") == F.col("h_b")).where(f"of_a <> of_b AND {SIZES} AND {ENOUGH}")
    return near.select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b")).distinct()


def hubs_of(met: DataFrame) -> DataFrame:
    """(h, own, at, n, of): of each shingle the set in which it comes earliest."""
    return met.groupBy("h").agg(F.min(F.struct("at", "own", "n", "of")).alias("hub")).select("h", "hub.*")


def folded(odd: str, words) -> Column:
    """An odd sketch at half its length, if it is longer than ``words``."""
    return F.when(F.size(odd) > words, F.zip_with(F.slice(odd, 1, words), F.slice(odd, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(odd))


def may_be_alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of ``pairs``, all of which fit in size, but those whose sketches differ by more than sets of a similarity of 0.8 may."""
    both = pairs.join(_sided(classes, "a", "own", "n", "odd"), F.col("a") == F.col("own_a")).join(_sided(classes, "b", "own", "n", "odd"), F.col("b") == F.col("own_b"))
    words = F.least(F.size("odd_a"), F.size("odd_b"))
    unlike = F.zip_with(folded("odd_a", words), folded("odd_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return both.where(9 * F.aggregate(unlike, F.lit(0), lambda n, k: n + k) <= F.col("n_a") + F.col("n_b")).select("a", "b")


def shorts(classes: DataFrame) -> DataFrame:
    """(of_class, s0, s1, ...): each set's sketch folded to ``SHORT`` words."""
    word = lambda k: F.aggregate(F.filter("odd", lambda x, i: i % SHORT == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return classes.select(F.col("own").alias("of_class"), *(word(k).alias(f"s{k}") for k in range(SHORT)))


def between_groups(left: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the pairs a < b of sets of different groups that share a shingle of ``left`` and whose short sketches may be alike."""
    known = left.join(shorts(classes), F.col("own") == F.col("of_class"))
    x, y = (_sided(known, side, *MET, *(f"s{k}" for k in range(SHORT))) for side in "ab")
    unlike = " + ".join(f"bit_count(s{k}_a ^ s{k}_b)" for k in range(SHORT))
    near = F.expr(f"own_a < own_b AND of_a <> of_b AND {SIZES} AND {ENOUGH} AND 9L * ({unlike}) <= n_a + n_b")
    return x.join(y, (F.col("h_a") == F.col("h_b")) & near).select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).distinct()


def alike(pairs: DataFrame, classes: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """The pairs whose sets have a similarity of 0.8 or more, written."""
    pairs = materialize(may_be_alike(pairs, classes), f"{folder}/sketches-alike")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    keys = materialize(classes.join(wanted, F.col("own") == F.col("of"), "left_semi").select("own", F.col("text.t1").alias("k1"), F.col("text.t2").alias("k2")), f"{folder}/wanted")
    body = rows.join(small_side(keys.select("k1", "k2")), (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left_semi")
    found = sets(body).dropDuplicates(["t1", "t2"]).join(keys, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).select("own", "hs")
    found = materialize(found, f"{folder}/sets")
    both = pairs.join(_sided(found, "a", "own", "hs"), F.col("a") == F.col("own_a")).join(_sided(found, "b", "own", "hs"), F.col("b") == F.col("own_b"))
    shared = F.size(F.array_intersect("hs_a", "hs_b")).cast("long")
    out = materialize(both.where(9 * shared >= 4 * (F.size("hs_a") + F.size("hs_b"))).select("a", "b"), f"{folder}/alike")
    for done in ("sets", "wanted", "sketches-alike"):
        forget(rows.sparkSession, f"{folder}/{done}")
    return out


def groups(known: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """(node, label): the sets that are alike, or linked by such as are, and their group's least one.

    ``known`` is a ``sketched`` table of ``rows``, written to ``folder``/sketched; it goes as soon as it isn't needed, and so does
    what each round has written on its way.
    """
    spark = known.sparkSession
    classes = known.groupBy("own").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.min(F.struct("t1", "t2")).alias("text"))
    classes = materialize(classes, f"{folder}/classes")
    post = known.select("own", "n", F.posexplode("prefix").alias("at", "h"))
    several = post.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("of"))
    met = materialize(post.join(small_side(materialize(several, f"{folder}/several")), F.col("h") == F.col("of"), "left_semi").distinct().withColumn("of", F.col("own")), f"{folder}/met")
    forget(spark, f"{folder}/sketched")
    hubs = materialize(hubs_of(met), f"{folder}/hubs-0")
    tried = materialize(by_fingerprint(classes).union(by_hub(met, hubs)).distinct(), f"{folder}/pairs-0")
    found = alike(tried, classes, rows, f"{folder}/0")
    k, new, before = 0, found, f"{folder}/met"
    while True:
        k += 1
        labels = simhash.components(found)
        grouped = met.drop("of").join(labels, F.col("own") == F.col("node"), "left").withColumn("of", F.coalesce("label", "own")).drop("node", "label")
        # The hubs have been compared with all. Of the others, those of shingles whose sets lie in several groups are left.
        rest = materialize(grouped.join(hubs.select("h", "own"), ["h", "own"], "left_anti").select(*MET), f"{folder}/rest-{k}")
        mixed = rest.groupBy("h").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("h")
        left = materialize(rest.join(small_side(materialize(mixed, f"{folder}/mixed-{k}")), "h", "left_semi"), f"{folder}/left-{k}")
        forget(spark, before)
        forget(spark, f"{folder}/rest-{k}")
        before = f"{folder}/left-{k}"
        size = left.groupBy("h", "of").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"))
        total = size.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs")).first()
        if not total.pairs:
            return labels
        hubs = materialize(hubs_of(left), f"{folder}/hubs-{k}")
        more = total.pairs > PAIRS_A_ROW * total.rows and new.limit(1).count() > 0
        pairs = by_hub(left, hubs) if more else between_groups(left, classes)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), f"{folder}/pairs-{k}")
        new = alike(pairs, classes, rows, f"{folder}/{k}")
        found, tried, met = found.union(new), tried.union(pairs), left
        if not more:
            return simhash.components(found)


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each group linked by similarity the row with the smallest key stays.

    Of equal keys the least by a 128-bit hash of the text stays, and of rows equal in both one. A null
    key stays only where its group has no other. Null, empty and wordless texts are alike. Columns stay
    as they came and may have any name; an empty table gives no rows.
    """
    folder, box = scratch_dir(docs.sparkSession), boxed(docs)
    body = F.coalesce(inside(text), F.lit(""))
    place = {"p0": inside(key).isNull(), "p1": inside(key), "t1": F.xxhash64(body), "t2": F.xxhash64(F.lit(1), body)}
    bodies = box.select(place["t1"].alias("t1"), place["t2"].alias("t2"), body.alias("text"))
    sketches = materialize(sketched(bodies), f"{folder}/sketched")
    known = materialize(sketches.select("t1", "t2", "own"), f"{folder}/known")
    labels = groups(sketches, bodies, folder)
    # Each text's group, for the texts of groups with several rows; the rest of the table is never moved.
    grouped = known.join(labels, F.col("own") == F.col("node"), "left").select("t1", "t2", F.coalesce("label", "own").alias("label"))
    many = grouped.groupBy("label").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("label").alias("of"))
    of_text = grouped.join(many, F.col("label") == F.col("of"), "left_semi").distinct()
    of_text = small_side(materialize(of_text.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "label"), f"{folder}/groups"))
    rows = box.withColumns(place).join(of_text, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    order = F.struct("p0", "p1", "t1", "t2")
    least = rows.where("label is not null").groupBy(F.col("label").alias("of")).agg(F.min(order).alias("least"))
    first = rows.where("label is not null").join(small_side(materialize(least, f"{folder}/least")), F.col("label") == F.col("of"))
    for c in place:
        first = first.where(F.col(c).eqNullSafe(F.col("least").getField(c)))
    first = first.dropDuplicates(list(place))
    return rows.where("label is null").select(*unboxed(docs.columns)).union(first.select(*unboxed(docs.columns)))
