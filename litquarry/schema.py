"""The record schema shared by all sources. ``ord`` is the order of arrival; every source emits it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = ("title", "abstract", "journal", "year", "date", "doi", "pmid", "pmcid", "source", "url", "publication_type", "category")
PAPER = T.StructType(
    [T.StructField("ord", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("title", "abstract")]
    + [T.StructField("authors", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in TEXT_FIELDS[2:]]
    + [T.StructField("is_preprint", T.BooleanType()), T.StructField("raw", T.StringType())]
)


def as_papers(df: DataFrame) -> DataFrame:
    """The record columns of ``df``, in order: absent and null texts as '', absent lists as empty, no flag as false."""
    have = set(df.columns)
    cols = []
    for f in PAPER.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c.cast(f.dataType), F.array().cast(f.dataType))
        elif f.name == "is_preprint":
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        elif f.name in TEXT_FIELDS:
            c = F.coalesce(c.cast("string"), F.lit(""))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
