"""The log of scored records: a parquet table partitioned by day, upserted by replacing the day, and its CSV for readers of the file."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litquarry.session import drop_path

# The columns of the log, in order.
COLUMNS = ("date_seen", "title", "journal", "year", "doi", "pmid", "pmcid", "source", "publication_type", "is_preprint",
           "matched_profiles", "relevance_score", "evidence_score", "total_score", "decision", "url", "summary")
TYPES = {"is_preprint": T.BooleanType(), "relevance_score": T.IntegerType(), "evidence_score": T.IntegerType(), "total_score": T.IntegerType()}
#: ``rank`` keeps the order within a day; the schema is given on reading, or the day would be inferred as a date.
SCHEMA = T.StructType([T.StructField(c, TYPES.get(c, T.StringType())) for c in COLUMNS[1:]] + [T.StructField("rank", T.LongType()), T.StructField("date_seen", T.StringType())])


def log_rows(ranked: DataFrame, today: str) -> DataFrame:
    """The log's rows of one day."""
    return ranked.withColumns({"date_seen": F.lit(today), "matched_profiles": F.array_join("matched_profiles", ";")}).select(
        *(F.col(f.name).cast(f.dataType) for f in SCHEMA.fields))


def upsert(rows: DataFrame, path: str, today: str) -> None:
    """Replace the day's partition. A day without rows removes it, which a dynamic overwrite alone would not."""
    if rows.isEmpty():
        drop_path(rows.sparkSession, f"{path}/date_seen={today}")
        return
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_seen").parquet(path)


def replace_day(existing: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """The log after the upsert, as a query: other days as they were, and the day's new rows."""
    return existing.filter(~F.col("date_seen").eqNullSafe(F.lit(today))).unionByName(rows)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def export_csv(rows: DataFrame, target: str | Path, today: str) -> None:
    """Bring the CSV for readers of the file up to date: other days stay as they are, the day's rows follow in rank order.

    Only the day's rows leave Spark, a partition at a time; the file itself is copied line by line and replaced at the end.
    """
    csv.field_size_limit(2**31 - 1)  # titles and summaries are of any length
    target = Path(target)
    fresh = target.with_suffix(".new")
    with fresh.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        if target.exists():
            with target.open(newline="", encoding="utf-8") as old:
                for row in csv.DictReader(old):
                    if row["date_seen"] != today:
                        out.writerow([row[c] for c in COLUMNS])
        for r in rows.select(*COLUMNS, "rank").orderBy("rank").toLocalIterator():
            out.writerow(["" if v is None else v for v in r[:-1]])
    fresh.replace(target)
