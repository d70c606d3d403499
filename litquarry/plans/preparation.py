"""Queries of the general data-preparation operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.operators.packed import Grammar, unpack
from litquarry.operators.timestamps import normalise_dates
from litquarry.session import load, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose unambiguous date differs from the text as written."""
    papers = spread(load(spark, d, "papers", "paper_id", "pub_date", "pub_year", "source"))
    dated = normalise_dates(papers, load(spark, d, "feeds"))
    changed = F.col("date_norm").isNotNull() & ~F.col("date_norm").eqNullSafe(F.col("pub_date"))
    return dated.filter(changed).select("paper_id", "date_norm")


def paper_grammars() -> dict[str, Grammar]:
    return {
        "authors": Grammar("fallback"),
        "publication_type": Grammar("fallback"),
        "matched_profiles": Grammar("always", blank_separates=True),
    }


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed fields that hold two or more."""
    papers = spread(load(spark, d, "papers", "paper_id", "authors", "publication_type", "matched_profiles"))
    return unpack(papers, paper_grammars(), keep=("paper_id",), min_values=2).drop("malformed")


def p7_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Number of values, and of values read past a malformed quote or bracket, by field."""
    papers = spread(load(spark, d, "papers", "paper_id", "authors", "publication_type", "matched_profiles"))
    return unpack(papers, paper_grammars(), keep=("paper_id",)).groupBy("field_name").agg(
        F.count("*").alias("n_values"), F.count_if("malformed").alias("n_malformed"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p7_found, p7_malformed)}
