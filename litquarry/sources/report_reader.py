"""Rendered reports read back: entries by section and position, counts, and the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litquarry.operators.report import QA_HEADING, SECTIONS

HEADINGS = {heading: name for name, heading, *_ in SECTIONS} | {"Preprints - not peer reviewed": "preprints"}
FIELDS = ("Source", "Journal", "Study type", "Matched profile", "Score", "Link", "Takeaway", "Limitations", "Confidence")


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of every line of the reports under a path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def _sectioned(lines: DataFrame) -> DataFrame:
    """Each line with the heading it stands under and the number of the entry it belongs to. A window runs over one file."""
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1_000)))
    so_far = Window.partitionBy("file").orderBy("n")
    placed = lines.withColumn("heading", F.last(heading, ignorenulls=True).over(so_far))
    within = Window.partitionBy("file", "heading").orderBy("n")
    return placed.withColumn("position", F.sum(F.col("line").startswith("### ").cast("int")).over(within))


def entries(lines: DataFrame) -> DataFrame:
    """One row per listed record: file, section, position, title and the labelled fields (null where absent)."""
    names = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))
    inside = _sectioned(lines).withColumn("section", names[F.col("heading")]).filter("section IS NOT NULL AND position > 0")
    title = F.when(F.col("line").startswith("### "), F.regexp_replace(F.substring("line", 5, 100_000), r"^\d+\. ", ""))
    pairs = inside.select("file", "section", "position", title.alias("title"), F.regexp_extract("line", r"^\*\*(.+?):\*\*", 1).alias("label"),
                          F.trim(F.regexp_extract("line", r"^\*\*.+?:\*\*(.*)$", 1)).alias("value"))
    picked = [F.max(F.when(F.col("label") == f, F.col("value"))).alias(f.lower().replace(" ", "_")) for f in FIELDS]
    return pairs.groupBy("file", "section", "position").agg(F.max("title").alias("title"), *picked)


def counts(lines: DataFrame) -> DataFrame:
    """(file, label, value) of the count lines."""
    own = _sectioned(lines).filter((F.col("heading") == QA_HEADING) & F.col("line").rlike("^- .*:"))
    return own.select("file", F.trim(F.regexp_extract("line", "^- (.*?):", 1)).alias("label"), F.trim(F.regexp_extract("line", "^- .*?:(.*)$", 1)).alias("value"))


def dates(lines: DataFrame) -> DataFrame:
    """(file, date) from the first date line."""
    dated = lines.filter(F.col("line").startswith("Date:"))
    return dated.groupBy("file").agg(F.trim(F.substring(F.min_by("line", "n"), 6, 100)).alias("date"))
