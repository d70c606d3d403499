"""Records from a JSON array of normalised objects; the position in the array is the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litquarry.schema import PAPER, as_papers

DERIVED = {"matched_profiles", "relevance_score", "evidence_score", "total_score", "decision", "summary", "limitations", "confidence"}
KNOWN = {f.name for f in PAPER.fields} - {"ord"} | DERIVED


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Strict: an unknown key or an absent title is an error, as both are mistakes in a hand-written file."""
    whole = spark.read.text(path, wholetext=True)
    maps = whole.select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("ord", "m"))
    bad = maps.select("ord", F.array_except(F.map_keys("m"), F.array(*map(F.lit, sorted(KNOWN)))).alias("unknown"),
                      F.map_contains_key("m", "title").alias("titled")).filter("size(unknown) > 0 OR NOT titled").first()
    if bad:
        raise TypeError(f"record {bad.ord}: unknown keys {bad.unknown}" if bad.unknown else f"record {bad.ord}: no title")
    record = T.StructType([f for f in PAPER.fields if f.name not in ("ord", "raw")])
    rows = whole.select(F.posexplode(F.from_json("value", T.ArrayType(record))).alias("ord", "r"))
    return as_papers(rows.select(F.col("ord").cast("long").alias("ord"), "r.*"))
