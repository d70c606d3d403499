"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Claims are (group, field, source, value). The model is the usual one for fusing conflicting sources:

* a source ``s`` is right with probability ``A(s)``; a wrong value is one of ``N_FALSE`` equally likely ones, so a
  vote counts ``ln(N_FALSE * A / (1 - A))``;
* two sources that share *false* values more often than accuracy explains are probably copies; the Bayes factor of
  "dependent" against "independent" uses the counts of shared true, shared false and differing values;
* a vote is discounted by the probability that it was copied from a better source voting for the same value;
* accuracies, dependences and value posteriors are re-estimated in ``ROUNDS`` turns.

The value with the largest posterior survives, field by field. A *preference order* over the values (longest abstract,
most trusted feed, ...) enters as the prior: a value's log-prior is ``strength`` times its place in that order among the
values of the item, so each place multiplies the prior odds by ``exp(strength)``. With ``strength=0`` the prior is flat and
votes decide. ``strength=None`` takes the least finite strength that outweighs the largest vote the estimated accuracies
allow (all sources for one value, none for the other): then a stated total order holds whatever the votes. Exact ties of
the posterior go to the order, and of the records that say the surviving value the first in the order stands for it.

Places come from a range-partitioned sort over all items, so a group that holds a third of all rows is spread over
tasks; all else per group is a partially aggregated ``groupBy``. What comes to the driver is one number per source and
per pair of sources; the number of sources is checked against ``MAX_SOURCES``.

Defined results: a null or unusable value is no claim; a field without a usable value gives no row; a record without a
known source claims under the source '' and ranks last in trust; repeated rows count once per source and value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.session import materialise

N_FALSE = 100  # false values an item can take
COPY_RATE = 0.8  # share of its values a copier copies
PRIOR_DEPENDENT = 0.1
START_ACCURACY = 0.8
ROUNDS = 3
MAX_SOURCES = 200


def _sources_by_value(claims: DataFrame) -> DataFrame:
    """(group, field, value) -> the distinct sources claiming it: at most MAX_SOURCES, so the set is bounded."""
    return claims.groupBy("group_id", "field_name", "value_key").agg(F.sort_array(F.collect_set("src")).alias("srcs"))


def _pair_counts(sets: DataFrame, *counts: Column) -> DataFrame:
    """For every two sources of a set, the sums of ``counts``."""
    pairs = F.expr("flatten(transform(srcs, (a, i) -> transform(slice(srcs, i + 2, size(srcs)), b -> struct(a AS s1, b AS s2))))")
    return sets.withColumn("p", F.explode(pairs)).groupBy("p.s1", "p.s2").agg(*counts)


def _map(values: Mapping[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.lit(float(v)) for v in values.values())))


def _weights(accuracy: Mapping[str, float], dependent: Mapping[tuple[str, str], float], sets: DataFrame) -> DataFrame:
    """Adds the vote count of every value: each source's log weight, discounted by copying from better sources."""
    order = sorted(accuracy, key=lambda s: (-accuracy[s], s))
    total: Column = F.lit(0.0)
    for i, s in enumerate(order):
        vote = math.log(N_FALSE * accuracy[s] / (1 - accuracy[s]))
        independent: Column = F.lit(1.0)
        for better in order[:i]:
            p = dependent.get((min(s, better), max(s, better)), 0.0)
            if p > 1e-9:
                independent = independent * F.when(F.array_contains("srcs", better), 1 - COPY_RATE * p).otherwise(1.0)
        total = total + F.when(F.array_contains("srcs", s), F.lit(vote) * independent).otherwise(0.0)
    return sets.withColumn("votes", total)


def _posteriors(voted: DataFrame) -> DataFrame:
    """Softmax of the votes within each item, shifted by the item's largest vote; unclaimed false values count too."""
    item = ["group_id", "field_name"]
    peak = voted.groupBy(*item).agg(F.max("votes").alias("peak"))
    shifted = voted.join(peak, item).withColumn("e", F.exp(F.col("votes") - F.col("peak")))
    total = shifted.groupBy(*item).agg((F.sum("e") + N_FALSE * F.exp(-F.first("peak"))).alias("total"))
    return shifted.join(total, item).withColumn("posterior", F.col("e") / F.col("total")).drop("peak", "e", "total")


def _dependence(kt: float, kf: float, kd: float, a: float) -> float:
    """Probability that two sources of mean accuracy ``a`` are dependent."""
    t, f = a * a, (1 - a) ** 2 / N_FALSE
    d = max(1e-9, 1 - t - f)
    c = COPY_RATE
    ratio = kt * math.log((a * c + t * (1 - c)) / t) + kf * math.log(((1 - a) * c + f * (1 - c)) / f) + kd * math.log(1 - c)
    odds = math.log(PRIOR_DEPENDENT / (1 - PRIOR_DEPENDENT)) + ratio
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def estimate(claims: DataFrame) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float]]:
    """(values with votes and posterior, accuracy by source, probability of dependence by pair of sources)."""
    sets = materialise(_sources_by_value(claims), "claims")
    names = [r[0] for r in claims.select("src").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before fusing")
    accuracy = dict.fromkeys(sorted(names), START_ACCURACY)
    dependent: dict[tuple[str, str], float] = {}
    # exploded before they are collected: at most MAX_SOURCES names an item, however many values it has
    said = sets.select("group_id", "field_name", F.explode("srcs").alias("s")).groupBy("group_id", "field_name")
    items = said.agg(F.array_sort(F.collect_set("s")).alias("srcs"))
    both = {(r.s1, r.s2): r.n for r in _pair_counts(items, F.count("*").alias("n")).collect()}
    for _ in range(ROUNDS):
        scored = _posteriors(_weights(accuracy, dependent, sets))
        shared = _pair_counts(scored, F.sum("posterior").alias("t"), F.sum(1 - F.col("posterior")).alias("f")).collect()
        right = scored.select(F.explode("srcs").alias("s"), "posterior").groupBy("s").agg(F.avg("posterior").alias("a")).collect()
        accuracy |= {r.s: min(0.99, max(0.01, r.a)) for r in right}
        dependent = {
            (r.s1, r.s2): _dependence(r.t, r.f, max(0.0, both[r.s1, r.s2] - r.t - r.f), (accuracy[r.s1] + accuracy[r.s2]) / 2)
            for r in shared
        }
    return _posteriors(_weights(accuracy, dependent, sets)), accuracy, dependent


def _most_votes(accuracy: Mapping[str, float]) -> float:
    """The largest difference of two values' votes: every source that counts for a value votes for one of them."""
    votes = [math.log(N_FALSE * a / (1 - a)) for a in accuracy.values()]
    return sum(v for v in votes if v > 0) - sum(v for v in votes if v < 0)


def fuse(claims: DataFrame, order: list[str], *, strength: float | None = None) -> DataFrame:
    """The surviving record of every (group, field): group_id, field_name, record_id, posterior.

    ``claims`` has group_id, field_name, record_id, src, value_key and the columns of ``order``, each to be maximised,
    the first first. The order must end in a column that is unique within a group, so that no tie is left.
    """
    if strength is not None and strength < 0:
        raise ValueError(f"strength: {strength}")
    item, key = ["group_id", "field_name"], ["group_id", "field_name", "value_key"]
    values, accuracy, _ = estimate(claims)
    step = 1 + _most_votes(accuracy) if strength is None else float(strength)
    # of the records that say a value, the first in the order stands for it
    best = claims.groupBy(*key).agg(F.max(F.struct(*order, F.col("record_id").alias("__id"))).alias("b"))
    sorts = [*item, *(F.col(f"b.{c}") for c in order)]
    placed = best.join(values.select(*key, "votes"), key).repartitionByRange(*sorts).sortWithinPartitions(*sorts)
    # increasing along the order within an item; the width of the steps between two places is at least one
    placed = materialise(placed.select(*item, F.col("b.__id").alias("record_id"), "votes", F.monotonically_increasing_id().alias("place")), "placed")
    first = placed.groupBy(*item).agg(F.min("place").alias("first"))
    scored = placed.join(first, item).withColumn("log_posterior", step * (F.col("place") - F.col("first")) + F.col("votes"))
    top = scored.groupBy(*item).agg(F.max(F.struct("log_posterior", "place", "record_id")).alias("t"))
    # the values nobody claims have the place before the first
    unclaimed = N_FALSE * F.exp(-step - F.first("t.log_posterior"))
    total = scored.join(top, item).groupBy(*item).agg(
        F.first("t").alias("t"), (F.sum(F.exp(F.col("log_posterior") - F.col("t.log_posterior"))) + unclaimed).alias("total"))
    return total.select(*item, "t.record_id", (1 / F.col("total")).alias("posterior"))


def preferred(claims: DataFrame, order: list[str]) -> DataFrame:
    """The record of every (group, field) that a total order prefers: group_id, field_name, record_id.

    What ``fuse`` gives with a prior that outweighs all votes, without estimating votes that cannot change it.
    """
    top = claims.groupBy("group_id", "field_name").agg(F.max(F.struct(*order, F.col("record_id").alias("__id"))).alias("b"))
    return top.select("group_id", "field_name", F.col("b.__id").alias("record_id"))
