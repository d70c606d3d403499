"""Near-duplicate records: MinHash banding on word n-gram sets, every candidate verified on the full sets.

1. One Python pass turns each text into its n-gram set's name (128 bits), ``bands`` band hashes of ``rows`` MinHash
   values each and a sketch of 128 bits, one of each of the first 128 MinHash values. ``rows`` is the largest number for
   which ``max_bands`` bands still reach the target recall at the threshold. Both follow from arguments alone, never from
   the table, so two records are a candidate pair whatever else there is. Chance collisions fall with ``rows``, and grow
   with the square of the table: sets of common words and collections beyond some millions of records should be given 30
   to 64 bands.
2. Records with the same set are one class; only its least id goes on, so a group of exact copies costs one row.
3. Classes are shuffled on (band, hash) and joined there, ``SLICE`` bands at a time, so that the shuffle files of one
   slice alone are on disk; the sketch drops nearly all chance collisions inside the join. A bucket with more than
   ``HOT`` classes is not enumerated: its classes leave for an exact prefix-filter join (two sets that reach the
   threshold share one of their ``n - ceil(t n) + 1`` rarest n-grams), so no bucket, however large, is paired up and
   none is capped. There, sets only meet sets of a similar size, a list of many sets is split by a salt, and a bitmap of
   parities bounds from below how many n-grams differ: pairs that cannot reach the threshold are dropped in the join,
   without loss. The lists are joined in as many turns as keep the rows of one turn below ``TURN`` a set.
4. Candidate classes alone are read again, and each pair is verified by the exact Jaccard similarity of its sets.

Defined results: null and empty texts and sets below ``min_size`` match nothing; texts are used whole; identical sets
have similarity 1; ties do not arise, a pair either reaches the threshold or not; an empty table gives no pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.llm.words import WORD, WordHashes, mix, set_sums
from litquarry.session import materialise

MAX_BANDS = 20
SKETCH_BITS = 128
HOT = 20_000
LIST = 20_000  # longer lists of the prefix-filter join are split
SLICE = 8  # bands joined at once
TURN, LEAST_TURN = 12, 1_000_000  # rows a set, and in all, that the prefix-filter join shuffles at once
RARITY_SLOTS = 1 << 18  # n-grams are counted in so many slots to order them by rarity
CHUNK = 1_000  # sets hashed at once, so that their hashes stay in the processor's cache
SLOTS, MOST_SLOTS = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Banding:
    threshold: float
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands

    @property
    def sketch_least(self) -> int:
        """Sketch bits that must agree: the mean at the threshold less 4.5 standard deviations."""
        p = (1 + self.threshold) / 2
        return math.floor(SKETCH_BITS * p - 4.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def choose_banding(threshold: float = 0.8, recall: float = 0.999, max_bands: int = MAX_BANDS) -> Banding:
    """The most rows (fewest chance collisions) with which at most ``max_bands`` bands reach the recall."""
    best = Banding(threshold, max_bands, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= max_bands:
            best = Banding(threshold, bands, rows)
    return best


def grams(text: str, n: int) -> set[str]:
    """Distinct word n-grams; a text of fewer than n words is one gram."""
    words = WORD.findall(text.lower())
    if n == 1:
        return set(words)
    return {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _signatures(banding: Banding, n: int, min_size: int):
    total = banding.bands * banding.rows
    seeds = [int(s) for s in np.random.default_rng(20_24).integers(1, 2**62, max(total, SKETCH_BITS))]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in (b.iloc[i:i + CHUNK] for b in batches for i in range(0, len(b), CHUNK)):
            sets = [grams(t, n) if t else () for t in batch["text"]]
            keep = np.array([len(s) >= min_size for s in sets], bool)
            kept = [s for s, k in zip(sets, keep) if k]
            if not kept:
                continue
            sizes = np.fromiter(map(len, kept), "int64", len(kept))
            flat = np.fromiter((hashes[w] for s in kept for w in s), "uint64", int(sizes.sum()))
            starts = np.r_[0, sizes.cumsum()[:-1]]
            k1, k2 = set_sums(flat, starts)
            bands = np.empty((len(kept), banding.bands), "int32")
            words = np.zeros((len(kept), 2), "uint64")
            key = np.zeros(len(kept), "uint64")
            for i, s in enumerate(seeds):
                least = np.minimum.reduceat(mix(flat, s), starts)
                if i < SKETCH_BITS:
                    words[:, i // 64] |= ((least >> np.uint64(40)) & np.uint64(1)) << np.uint64(i % 64)
                if i < total:
                    key = mix(key ^ least, 0x2545F4914F6CDD1D)
                    if (i + 1) % banding.rows == 0:
                        bands[:, i // banding.rows] = (key >> np.uint64(32)).astype("uint32").view("int32")
                        key = np.zeros(len(kept), "uint64")
            sketch = words.view("int64")
            yield pd.DataFrame({"id": batch["id"].to_numpy()[keep], "k1": k1, "k2": k2, "n": sizes, "s1": sketch[:, 0],
                                "s2": sketch[:, 1], "bands": list(bands)})

    return sign


def signatures(texts: DataFrame, banding: Banding, *, n: int, min_size: int) -> DataFrame:
    """(id, k1, k2, n, s1, s2, bands) of every (id, text) with a large enough set."""
    return texts.mapInPandas(_signatures(banding, n, min_size), "id long, k1 long, k2 long, n long, s1 long, s2 long, bands array<int>")


def _agree(a: str, b: str) -> Column:
    return SKETCH_BITS - F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) - F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))


def hot_keys(rows: DataFrame, hot: int, expected: int = 0) -> DataFrame:
    """Keys of more than ``hot`` rows. Counted in a bounded number of slots first; only full slots are looked into.

    ``expected`` is about how many rows there are: slots are added so that a usual slot stays far from full.
    """
    slots = SLOTS
    while slots < MOST_SLOTS and expected > slots * hot / 8:
        slots *= 2
    slot = F.pmod(F.col("key"), F.lit(slots))
    full = rows.groupBy(slot.alias("slot")).count().filter(F.col("count") > hot).select("slot")
    return rows.join(F.broadcast(full), slot == F.col("slot"), "left_semi").groupBy("key").count().filter(F.col("count") > hot).select("key")


def candidate_pairs(classes: DataFrame, banding: Banding, hot: int = HOT, records: int = 0) -> tuple[DataFrame, DataFrame]:
    """(distinct candidate pairs a < b of class ids, ids of the classes in hot buckets)."""
    exploded = classes.select("id", "s1", "s2", F.posexplode("bands").alias("band", "h"))
    rows = exploded.select("id", "s1", "s2", "band", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("h").cast("long")).alias("key"))
    crowded_keys = materialise(hot_keys(rows.select("key"), hot, records * banding.bands), "hot-keys")
    cool, crowded = rows, rows.select("id").limit(0)
    if not crowded_keys.isEmpty():
        cool = rows.join(crowded_keys, "key", "left_anti")
        crowded = materialise(rows.join(crowded_keys, "key", "left_semi").select("id").distinct(), "crowded")
    found = []
    for first in range(0, banding.bands, SLICE):
        part = cool.filter((F.col("band") >= first) & (F.col("band") < first + SLICE)).drop("band")
        a, b = part.alias("a"), part.alias("b")
        near = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (_agree("a", "b") >= banding.sketch_least)
        found.append(materialise(a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "slice"))
    return functools.reduce(DataFrame.unionAll, found).distinct(), crowded


def _prefixes(counts: np.ndarray, threshold: float, most: int):
    """Rows of the rarest n-grams of each set, with its bitmap: a bit is the parity of the n-grams that fall on it."""

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["h"].map(len) > 0]
            if not len(batch):
                continue
            n = np.fromiter(map(len, batch["h"]), "int64", len(batch))
            flat, row, starts = np.concatenate(batch["h"].to_list()).astype("int64"), np.repeat(np.arange(len(n)), n), np.r_[0, n.cumsum()[:-1]]
            bit = (flat >> 20) & 127
            one = np.uint64(1) << (bit % 64).astype("uint64")
            low, high = (np.bitwise_xor.reduceat(np.where(bit // 64 == k, one, np.uint64(0)), starts).view("int64") for k in (0, 1))
            df = counts[flat % len(counts)]
            order = np.lexsort((flat, df, row))
            at = np.arange(len(flat)) - starts[row]
            keep = at < (n - np.ceil(threshold * n - 1e-9) + 1)[row]
            of = row[keep]
            yield pd.DataFrame({"id": batch["id"].to_numpy()[of], "n": n[of], "i": at[keep], "g": flat[order][keep],
                                "parts": -(-df[order][keep] // most), "low": low[of], "high": high[of]})

    return prefix


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among (id, grams): pairs that share one of their rarest grams. Rarity is counted over all sets.

    N-grams are ordered by the count of their slot, then by hash: any order that all sets share is exact.
    """
    hashed = sets.select("id", F.transform("grams", lambda g: F.xxhash64(g)).alias("h"))
    counted = hashed.select(F.explode("h").alias("g")).groupBy(F.pmod("g", F.lit(RARITY_SLOTS)).alias("slot")).count().toArrow()
    counts = np.zeros(RARITY_SLOTS, "int64")
    counts[counted["slot"].to_numpy()] = counted["count"].to_numpy()
    rows = hashed.mapInPandas(_prefixes(counts, threshold, LIST), "id long, n int, i int, g long, parts int, low long, high long")
    # sets that reach the threshold are in the same class of sizes or in neighbouring ones
    sized = materialise(rows.withColumn("size", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).cast("int")), "prefixes")
    whole = sized.agg(F.sum(2 * F.col("parts") + 1).alias("rows"), F.countDistinct("id").alias("sets")).first()
    turns = math.ceil((whole.rows or 1) / max(TURN * whole.sets, LEAST_TURN))
    columns = ("id", "n", "i", "g", "low", "high")
    b = sized.select(*columns, "size", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    each = sized.select(*columns, "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    mine = lambda side, turn: side.filter(F.pmod(F.xxhash64("g", "salt"), F.lit(turns)) == turn)
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    # past the places of the common gram, what is left of both sets must still do
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    left = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    # every bit that differs is a gram at least that one of the two sets has alone
    apart = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.salt") == F.col("b.salt"))
    # the first common gram in the order bounds the overlap; at later ones the bound is only lower, and one passing is enough
    near = same & smaller & (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (left >= needed) & (apart <= F.col("a.n") + F.col("b.n") - 2 * needed)
    found = []
    for turn in range(turns):
        a = mine(each, turn).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
        pairs = a.alias("a").join(mine(b, turn).alias("b"), near)
        found.append(materialise(pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct(), "turn"))
    return functools.reduce(DataFrame.unionAll, found).distinct()


def _gram_sets(texts: DataFrame, n: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "grams": [list(grams(t, n)) if t else [] for t in batch["text"]]})

    return texts.mapInPandas(read, "id long, grams array<string>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets reach the threshold, by exact intersection."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
    # compared in whole numbers: i / (s - i) >= threshold, without rounding at the threshold itself
    similarity = F.col("i") / (F.col("s") - F.col("i"))
    return scored.filter(F.col("i") + 1e-9 >= threshold * (F.col("s") - F.col("i"))).select("a", "b", similarity.alias("similarity"))


def near_duplicate_classes(
    texts: DataFrame, *, threshold: float = 0.8, recall: float = 0.999, n: int = 5, min_size: int = 1, hot: int = HOT, max_bands: int = MAX_BANDS
) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id; pairs: a, b, similarity between class ids) of a table (id, text).

    Every record with a large enough set has one member row; copies are not paired with each other.
    """
    records = texts.count()
    banding = choose_banding(threshold, recall, max_bands)
    signed = materialise(signatures(texts, banding, n=n, min_size=min_size), "signatures")
    # the least id stands for its class: whichever side of the self-join asks, it is the same record
    least = signed.groupBy("k1", "k2").agg(F.min(F.struct("id", "s1", "s2", "bands")).alias("c"))
    classes = materialise(least.select("k1", "k2", "c.*"), "classes")
    members = signed.select("id", "k1", "k2").join(classes.select("k1", "k2", F.col("id").alias("class_id")), ["k1", "k2"]).select("id", "class_id")
    pairs, crowded = candidate_pairs(classes.drop("k1", "k2"), banding, hot, records)
    found = materialise(pairs, "candidates")
    wanted = found.select(F.col("a").alias("id")).unionAll(found.select(F.col("b").alias("id"))).distinct()
    if not crowded.isEmpty():
        sets = materialise(_gram_sets(texts.join(wanted.unionAll(crowded).distinct(), "id", "left_semi"), n), "sets")
        more = prefix_pairs(sets.join(crowded, "id", "left_semi"), threshold)
        found = materialise(found.unionAll(more).distinct(), "candidates")
    else:
        sets = materialise(_gram_sets(texts.join(wanted, "id", "left_semi"), n), "sets")
    return members, materialise(verify(found, sets, threshold), "near-pairs")


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All record pairs (a < b): members of one class, and members of two classes that form a pair."""
    left = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return across.unionAll(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
