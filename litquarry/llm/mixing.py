"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The total is the largest at which every source can give its share: the least of ``tokens * max_repeats / share``. It is
cut into equal-token blocks: at least ``BLOCKS``, and so many that a block is at most one ``BLOCKS_A_SHARD``-th of what
the average shard of any source has to give, however many shards there are. Blocks go to sources one by one by the
highest quotient ``share / (2k + 1)``; the blocks of a source go to its shards in the same way by the shards' tokens. What
a block holds beyond what a shard can give is handed on to shards with tokens left, so no token of a quota is lost.
Within a shard the documents lie in a seeded order, and its quota is met by whole passes over the shard and one partial
pass that takes, in that order, every document that still fits the quota.

A shard holds about ``SHARD_DOCS`` documents of one source, so a source with a third of all rows is many shards. Only
token totals by (source, shard) come to the driver, at most ``MAX_SHARDS`` a source whatever the table; beyond
``SHARD_DOCS * MAX_SHARDS`` (1.3 thousand million) documents of one source its shards grow, by sizes alone, not texts.

Defined results: documents without tokens are never used; a source without any cannot give a share and is left out, the
others keep their proportions, and its reached share is 0; sources compare without case and outer spaces; a null target
is no target; the same seed gives the same selection.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 20_000
BLOCKS_A_SHARD = 16
SHARD_DOCS = 20_000
MAX_SHARDS = 65_536
MAX_TARGETS = 10_000


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2k + 1); ties go to the first. ``most`` bounds each.

    A divisor d gives w / d, rounded, to each; that is what the quotients above d / 2 give, so a divisor that gives nearly
    all seats is found by bisection and only the last few seats go out one by one.
    """
    w = np.array(weights, "float64").clip(min=0)
    bound = np.array(most, "float64") if most is not None else np.full(len(w), np.inf)
    if not len(w) or not w.any() or seats <= 0:
        return [0] * len(w)
    given = lambda d: np.minimum(np.floor(w / d + 0.5), bound)
    low, high = w[w > 0].min() / (seats + 1), 2 * w.max() + w.sum()
    if given(low).sum() > seats:
        for _ in range(200):
            d = (low * high) ** 0.5
            low, high = (d, high) if given(d).sum() > seats else (low, d)
            if high <= low * (1 + 1e-15):
                break
        got = given(high)
    else:
        got = given(low)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if w[i] > 0 and got[i] < bound[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < bound[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def shard_quotas(tokens: Sequence[int], repeats: int, seats: int, block: float) -> list[int]:
    """Tokens each shard of a source gives: its blocks, less what it has not, which goes to shards with tokens left."""
    offer = [t * repeats for t in tokens]
    blocks = sainte_lague(tokens, seats, [int(o / block) + 1 for o in offer])
    quota = [min(round(k * block), o) for k, o in zip(blocks, offer, strict=True)]
    missing = min(round(seats * block), sum(offer)) - sum(quota)
    for i, o in enumerate(offer):
        if missing <= 0:
            break
        more = min(missing, o - quota[i])
        quota[i] += more
        missing -= more
    return quota


def _key(column: str):
    return F.lower(F.trim(F.col(column)))


SELECTED = "mix_name string, source string, id long, uses long, tokens long"


def _partial_pass(seed: int):
    """Uses of each document of one shard in one mix."""

    def select(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = [xxhash.xxh3_64_intdigest(f"{seed}:{i}") for i in rows["id"]]
        rows = rows.assign(order=order).sort_values(["order", "id"], kind="stable")
        left, uses = int(rows["rest"].iloc[0]), []
        for tokens in rows["tokens"]:
            uses.append(int(tokens <= left))
            left -= tokens if tokens <= left else 0
        rows["uses"] = (rows["passes"] + uses).clip(upper=rows["most"])
        rows = rows[rows["uses"] > 0]
        return pd.DataFrame({"mix_name": key[0], "source": key[1], "id": rows["id"], "uses": rows["uses"], "tokens": rows["tokens"]})

    return select


def mix(sizes: DataFrame, targets: DataFrame, *, seed: int = 7, blocks: int = BLOCKS, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """(selection: mix_name, source, id, uses, tokens; report: mix_name, source, target_share, max_repeats, ...).

    ``sizes`` (id, source, tokens) must be materialised. ``targets`` has mix_name, source, target_share, max_repeats.
    """
    spark = sizes.sparkSession
    wanted = [r for r in targets.filter("target_share > 0 AND max_repeats > 0").limit(MAX_TARGETS + 1).collect()]
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    docs = sizes.filter("tokens > 0").withColumn("src", _key("source"))
    counts = {r.src: r.n for r in docs.filter(F.col("src").isin(sorted({(r.source or "").strip().lower() for r in wanted})))
              .groupBy("src").agg(F.count("*").alias("n")).collect()}
    shards = {s: min(MAX_SHARDS, -(-n // shard_docs)) for s, n in counts.items()}
    plan = spark.createDataFrame([(s, n) for s, n in shards.items()], "src string, n_shards int")
    placed = docs.join(F.broadcast(plan), "src").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("n_shards")).cast("int"))
    totals: dict[str, dict[int, int]] = {}
    for r in placed.groupBy("src", "shard").agg(F.sum("tokens").alias("t")).collect():
        totals.setdefault(r.src, {})[r.shard] = r.t
    quotas = []
    by_mix: dict[str, list] = {}
    for r in wanted:
        by_mix.setdefault(r.mix_name, []).append(r)
    for name, rows in sorted(by_mix.items()):
        rows = [r for r in rows if totals.get((r.source or "").strip().lower())]
        if not rows:
            continue
        of = {r.source: totals[r.source.strip().lower()] for r in rows}
        share = sum(r.target_share for r in rows)
        total = min(sum(of[r.source].values()) * r.max_repeats * share / r.target_share for r in rows)
        least = min(sum(of[r.source].values()) * r.max_repeats / len(of[r.source]) for r in rows)
        block = max(1.0, min(total / blocks, least / BLOCKS_A_SHARD))
        for r, seats in zip(rows, sainte_lague([r.target_share for r in rows], int(total / block)), strict=True):
            parts = sorted(of[r.source].items())
            tokens = [t for _, t in parts]
            for (shard, t), quota in zip(parts, shard_quotas(tokens, int(r.max_repeats), seats, block), strict=True):
                if quota:
                    quotas.append((name, r.source, r.source.strip().lower(), shard, quota // t, quota % t, int(r.max_repeats)))
    quota = spark.createDataFrame(quotas, "mix_name string, mix_source string, src string, shard int, passes long, rest long, most int")
    # the quota table has at most targets x MAX_SHARDS small rows; joined, not broadcast by force
    laid = placed.select("id", "src", "shard", "tokens").join(quota, ["src", "shard"])
    selection = laid.groupBy("mix_name", "mix_source", "shard").applyInPandas(_partial_pass(seed), SELECTED)
    reached = selection.groupBy("mix_name", "source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("tokens_used"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    whole = reached.groupBy("mix_name").agg(F.sum("tokens_used").alias("mix_tokens"))
    report = (
        targets.select("mix_name", "source", "target_share", "max_repeats").join(reached, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
        .select("mix_name", "source", "target_share", "max_repeats", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
                F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
                F.coalesce(F.col("tokens_used") / F.col("mix_tokens"), F.lit(0.0)).alias("share_reached"))
    )
    return selection, report
