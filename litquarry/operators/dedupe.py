"""Order-dependent deduplication on overlapping identifiers.

A record is a duplicate if any of its keys occurs in any earlier record, duplicates included: not the same as connected
components, where two records kept here could be joined through a later third. Per key only the first ``ord`` matters,
so it is one aggregation by key and one by record; a key that a third of all records share costs one partial minimum.

Records without any key are always unique. Nulls and blanks are no keys; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.functions.text import SPACE, normalize_title
from litquarry.session import materialise

IDENTIFIERS = ("pmid", "doi", "pmcid")
HOT = 100_000


def _identifier(name: str) -> Column:
    value = F.lower(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(value != "", F.concat(F.lit(f"{name}:"), value))


def _title_key() -> Column:
    title = normalize_title(F.col("title"))
    return F.when(title != "", F.concat(F.lit("title:"), title))


def paper_keys() -> Column:
    """array of the record's keys: pmid, doi and pmcid without case and outer space, and the normalised title."""
    return F.array_distinct(F.array_compact(F.array(*map(_identifier, IDENTIFIERS), _title_key())))


def dedupe_key() -> Column:
    """The one preferred key: pmid, else doi, else pmcid, else the title, even if that is empty."""
    return F.coalesce(*map(_identifier, IDENTIFIERS), F.concat(F.lit("title:"), normalize_title(F.col("title"))))


def late_records(papers: DataFrame) -> DataFrame:
    """``ord`` of the records of which some key occurs earlier.

    Only keys of several records can make one late; those and their first ``ord`` are a written table. A key of more than
    ``HOT`` records (one title of a third of all rows) would fill one task of the join: there are at most rows / HOT of
    them, so they are broadcast instead and their records stay where they are.
    """
    keyed = papers.select("ord", F.explode(paper_keys()).alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    hot = shared.filter(F.col("n") > HOT).select("key", "first")
    if hot.isEmpty():
        late = keyed.join(shared.select("key", "first"), "key")
    else:
        rest = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
        late = rest.join(shared.filter(F.col("n") <= HOT).select("key", "first"), "key").unionByName(keyed.join(F.broadcast(hot), "key"))
    return late.filter("first < ord").select("ord").distinct()


def mark_duplicates(papers: DataFrame) -> DataFrame:
    """``papers`` with ``is_duplicate`` added."""
    late = late_records(papers).withColumn("late", F.lit(True))
    return papers.join(late, "ord", "left").withColumn("is_duplicate", F.coalesce("late", F.lit(False))).drop("late")


def dedupe(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique records, duplicates)."""
    marked = mark_duplicates(papers)
    return marked.filter("NOT is_duplicate").drop("is_duplicate"), marked.filter("is_duplicate").drop("is_duplicate")
