"""Filling fixed-capacity containers: best-two-fit packing.

A container is filled greedily, always with the largest item that still fits. Then its smallest item is taken out
and, if two unpacked items fit the widened gap more tightly than it did, they replace it. The next container follows.

Items are spread evenly over shards by a hash of their row, each shard of about ``SHARD_ITEMS`` items is packed by one
task, and a shard works on sizes alone, so no task grows with the table. Only texts larger than a container are split:
into full containers and one rest, which is packed like any item.

Defined results: an item without tokens lies in the first container of its shard; equal sizes are taken in the order
of their ids; repeated rows are packed each; an empty table gives no containers.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000
MAX_SPECS = 1_000


class _Stock:
    """Unpacked items by size: which sizes are there, and the items of each."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.items: dict[int, list[int]] = defaultdict(list)
        for i in np.argsort(-np.arange(len(sizes))):  # so that pop() yields the first row of a size first
            self.items[int(sizes[i])].append(int(i))
        self.sizes = sorted(self.items)
        self.capacity = capacity
        self._below: np.ndarray | None = None

    def largest(self, gap: int) -> int:
        """The largest size that fits, 0 if none."""
        k = bisect.bisect_right(self.sizes, gap)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        own = self.items[size]
        item = own.pop()
        if not own:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
            self._below = None
        return item

    def give(self, size: int, item: int) -> None:
        if not self.items[size]:
            bisect.insort(self.sizes, size)
            self._below = None
        self.items[size].append(item)

    def best_two(self, gap: int) -> tuple[int, int]:
        """The two sizes with the largest sum that fits; (0, 0) if no two fit."""
        if not self.sizes or 2 * self.sizes[0] > gap:
            return 0, 0
        if self._below is None:  # for every gap, the largest size within it
            there = np.zeros(self.capacity + 1, "int64")
            there[self.sizes] = self.sizes
            self._below = np.maximum.accumulate(there)
        a = np.array(self.sizes[: bisect.bisect_right(self.sizes, gap - self.sizes[0])], "int64")
        b = self._below[np.minimum(gap - a, a)]  # the smaller of the two, or as large
        # a size with one item cannot be taken twice
        twice = (b == a) & np.array([len(self.items[int(x)]) < 2 for x in a])
        b[twice] = self._below[a[twice] - 1]
        total = np.where(b > 0, a + b, 0)
        k = int(total.argmax())
        return (int(a[k]), int(b[k])) if total[k] else (0, 0)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are 1..capacity."""
    stock = _Stock(sizes, capacity)
    container = np.full(len(sizes), -1, "int64")
    number = 0
    while stock.sizes:
        gap, inside = capacity, []
        while size := stock.largest(gap):
            inside.append((size, stock.take(size)))
            gap -= size
        if gap and len(inside) > 1:
            size, item = inside[-1]  # filled from the largest on, so the last is the smallest
            a, b = stock.best_two(gap + size)
            if a + b > size:
                inside[-1:] = [(a, stock.take(a)), (b, stock.take(b))]
                stock.give(size, item)
        for _, item in inside:
            container[item] = number
        number += 1
    return container


def _pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["id", "item"], kind="stable")
    capacity, shard = int(rows["capacity"].iloc[0]), int(key[1])
    full = (rows["tokens"] // capacity).to_numpy("int64")
    rest = (rows["tokens"] % capacity).to_numpy("int64")
    split = rows["tokens"].to_numpy("int64") > capacity
    full = np.where(split, full, 0)
    rest = np.where(split, rest, rows["tokens"].to_numpy("int64"))
    container = np.zeros(len(rows), "int64")
    some = rest > 0
    container[some] = pack(rest[some], capacity)
    first_free = int(container[some].max()) + 1 if some.any() else 0
    pieces = np.repeat(np.arange(len(rows)), full)
    nth = np.arange(len(pieces)) - np.repeat(np.r_[0, full.cumsum()[:-1]], full)
    ids = rows["id"].to_numpy()
    last = some | (full == 0)  # the rest of a split item, or the whole item, empty ones included
    out = pd.DataFrame({
        "id": np.r_[ids[pieces], ids[last]],
        "piece_no": np.r_[nth, full[last]] + 1,
        "number": np.r_[first_free + np.arange(len(pieces)), container[last]],
        "first_token": np.r_[nth * capacity, full[last] * capacity],
        "n_tokens": np.r_[np.full(len(pieces), capacity), rest[last]],
    })
    out["spec_name"] = key[0]
    out["container_id"] = (shard << 32) + out.pop("number")
    return out[["spec_name", "id", "piece_no", "container_id", "first_token", "n_tokens"]]


PACKED = "spec_name string, id long, piece_no long, container_id long, first_token long, n_tokens long"


def pack_table(sizes: DataFrame, specs: DataFrame, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of every item (id, tokens; materialised) for every spec (spec_name, capacity_tokens).

    One row per piece: spec_name, id, piece_no, container_id, first_token, n_tokens.
    """
    # by id alone, so that containers do not depend on files and partitions; rows of repeated ids are told apart by their place
    unique = sizes.groupBy("id").count().filter("count > 1").isEmpty()
    numbered = sizes.select("id", "tokens", (F.xxhash64("id") if unique else F.xxhash64("id", F.monotonically_increasing_id())).alias("item"))
    shards = max(1, math.ceil(sizes.count() / shard_items))
    rows = specs.filter("capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    # every item goes into one container of every spec: a stated, bounded list, exploded, not joined
    wanted = F.array(*(F.struct(F.lit(r.spec_name).alias("spec_name"), F.lit(r.capacity).alias("capacity")) for r in rows))
    spec = "struct<spec_name: string, capacity: bigint>"
    items = numbered.withColumn("shard", F.pmod("item", F.lit(shards))).select("*", F.explode(wanted.cast(f"array<{spec}>")).alias("s")).select("*", "s.*").drop("s")
    return items.groupBy("spec_name", "shard").applyInPandas(_pack_shard, PACKED)
