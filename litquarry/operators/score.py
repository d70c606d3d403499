"""Scoring against weighted term profiles, classification by ordered rules, ranking.

Everything is a literal expression generated from the configuration and evaluated in one pass; nothing shuffles until
:func:`rank`. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.config import Topics
from litquarry.functions.text import count_terms, folded, has_term
from litquarry.session import materialise

MOST_HITS = 4  # term hits of one profile that count
PREPRINT_EVIDENCE, LEGACY_RELEVANCE, NEGATIVE_RELEVANCE = -3, -8, -2
WITH_ABSTRACT, WITHOUT_ABSTRACT, WITH_IDENTIFIER = 1, -3, 1


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def haystack() -> Column:
    """Title, abstract, type and category in one text, so that a phrase may run across their borders."""
    return F.concat_ws(" ", _text("title"), _text("abstract"), _text("publication_type"), _text("category"))


def with_haystack(papers: DataFrame) -> DataFrame:
    return papers.withColumn("__hay", haystack()).withColumn("__low", folded(F.col("__hay")))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _overlap(profiles: Column, ids: tuple[str, ...]) -> Column:
    return F.arrays_overlap(profiles, F.array(*map(F.lit, ids))) if ids else F.lit(False)


def profile_hits(topics: Topics) -> list[tuple[str, int, Column]]:
    """(id, weight, number of terms that occur) of each profile, over a frame made by with_haystack."""
    hay, low = F.col("__hay"), F.col("__low")
    return [(p.id, p.weight, count_terms(hay, low, list(p.terms))) for p in topics.profiles]


def score(papers: DataFrame, topics: Topics) -> DataFrame:
    """Adds matched_profiles, relevance_score, evidence_score, total_score and decision."""
    base = with_haystack(papers)
    hits = profile_hits(topics)
    counted = base.withColumns({f"__h{k}": h for k, (_, _, h) in enumerate(hits)})
    hay, low = F.col("__hay"), F.col("__low")
    profiles = F.array_compact(F.array(*(F.when(F.col(f"__h{k}") > 0, F.lit(i)) for k, (i, _, _) in enumerate(hits)))) if hits else F.array().cast("array<string>")
    gained = [F.when(F.col(f"__h{k}") > 0, w + F.least(F.col(f"__h{k}"), F.lit(MOST_HITS))).otherwise(0) for k, (_, w, _) in enumerate(hits)]
    evidence = [F.when(has_term(F.lower(hay), low, t), v).otherwise(0) for t, v in topics.evidence.items()]
    present = lambda c: F.length(_text(c)) > 0
    scored = counted.withColumns({
        "matched_profiles": profiles,
        "__gain": reduce(lambda a, b: a + b, gained, F.lit(0)) + NEGATIVE_RELEVANCE * count_terms(hay, low, list(topics.negative_terms)),
        "__evidence": reduce(lambda a, b: a + b, evidence, F.lit(0)),
        "__anchored": _any([has_term(hay, low, t) for t in topics.anchors]),
    })
    roles, own = topics.roles, F.col("matched_profiles")
    stale = _overlap(own, roles.legacy) & ~_overlap(own, roles.primary)
    scored = scored.withColumns({
        "relevance_score": (F.col("__gain") + F.when(stale, LEGACY_RELEVANCE).otherwise(0)).cast("int"),
        "evidence_score": (
            F.col("__evidence") + F.when(F.coalesce("is_preprint", F.lit(False)), PREPRINT_EVIDENCE).otherwise(0)
            + F.when(present("abstract"), WITH_ABSTRACT).otherwise(WITHOUT_ABSTRACT)
            + F.when(present("doi") | present("pmid") | present("pmcid"), WITH_IDENTIFIER).otherwise(0)
        ).cast("int"),
    }).withColumn("total_score", F.col("relevance_score") + F.col("evidence_score"))
    scored = scored.withColumn("decision", decision(topics, F.col("__anchored")))
    return scored.drop("__hay", "__low", "__gain", "__evidence", "__anchored", *(f"__h{k}" for k in range(len(hits))))


def decision(topics: Topics, anchored: Column) -> Column:
    """Class of a record by the first rule that applies; the rules' order is part of their meaning."""
    own, total, roles = F.col("matched_profiles"), F.col("total_score"), topics.roles
    core = _overlap(own, roles.core) & anchored
    broad = _overlap(own, roles.broad) & ~_overlap(own, roles.core + roles.not_broad)
    enough, some = total >= topics.min_score, total >= 1
    rules = [
        (_overlap(own, roles.legacy) & ~core & some, "watchlist"),
        (_overlap(own, roles.legacy) & ~core, "skip"),
        (F.coalesce("is_preprint", F.lit(False)) & enough, "preprint_watch"),
        (enough & (core | broad), "digest"),
        (some, "watchlist"),
    ]
    first = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        first = first.when(condition, name)
    return first.otherwise("skip")


def rank(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1: digest first, then total downwards, peer-reviewed first, title, order of arrival.

    A global numbering without a global task: the order's columns alone are range-partitioned and sorted, numbered inside
    each partition, and shifted by the sizes of the partitions before, of which there are as many as partitions. The
    numbered rows are a written table, since a second sampling of the ranges could cut them elsewhere. Pass scores that
    are cheap to read twice (a written table); texts do not move unless a later step asks for them.
    """
    order = ["late", "down", "is_preprint", "lower_title", "ord"]
    keys = scored.select(
        (F.col("decision") != "digest").cast("int").alias("late"), (-F.col("total_score")).alias("down"), "is_preprint",
        F.lower(F.coalesce("title", F.lit(""))).alias("lower_title"), "ord")
    # the full order is the range key, so that a frequent score does not fill one partition
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("ord", F.monotonically_increasing_id().alias("row"))
    numbered = materialise(placed, "ranked").select("ord", F.shiftright("row", 33).alias("part"), (F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    ranks = numbered.join(shift, "part").select("ord", (F.col("n") + F.col("before")).alias("rank"))
    return scored.join(ranks, "ord")
