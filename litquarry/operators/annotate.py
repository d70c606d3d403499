"""Cautious rule-based annotations. Unlike scoring, these look for plain substrings and leave the category out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.functions.text import first_sentence

# Wording of the annotations.
NO_ABSTRACT = "No abstract available. Check the full text before interpreting."
CAUTION = " Interpretation should remain cautious because this is abstract-level surveillance."
UNCLEAR_TYPE = "Original/research article or unclear"
STUDY_TYPES = (
    (("guideline", "recommendation"), "Guideline / recommendation"),
    (("systematic review", "meta-analysis"), "Systematic review / meta-analysis"),
    (("randomized", "randomised"), "Randomized clinical trial"),
    (("cohort",), "Cohort study"),
    (("case report",), "Case report"),
    (("cell line", "in vitro"), "Preclinical / in vitro"),
)
LIMIT_PREPRINT = "Preprint; not peer reviewed."
LIMIT_NO_ABSTRACT = "No abstract available in fetched metadata."
LIMITS = (
    (("retrospective",), "Retrospective design may limit causal inference."),
    (("cell line", "in vitro", "mouse", "mice"), "Preclinical evidence; clinical applicability is uncertain."),
)
LIMIT_DEFAULT = "Only metadata/abstract reviewed; verify methods, effect size, and applicability in full text."
TRUSTED_TYPES = ("guideline", "systematic review", "meta-analysis")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _low() -> Column:
    return F.lower(F.concat_ws(" ", _text("title"), _text("abstract"), _text("publication_type")))


def _says(low: Column, parts: tuple[str, ...]) -> Column:
    found = low.contains(parts[0])
    for p in parts[1:]:
        found = found | low.contains(p)
    return found


def _preprint() -> Column:
    return F.coalesce(F.col("is_preprint"), F.lit(False))


def study_type(low: Column | None = None) -> Column:
    """First kind of study whose words occur; preprints are that first, the stated type comes last."""
    low = _low() if low is None else low
    kind = F.when(_preprint(), "Preprint")
    for parts, name in STUDY_TYPES:
        kind = kind.when(_says(low, parts), name)
    return kind.when(_text("publication_type") != "", F.col("publication_type")).otherwise(UNCLEAR_TYPE)


def limitations(low: Column | None = None) -> Column:
    """All cautions that apply, in fixed order, or the general one."""
    low = _low() if low is None else low
    said = F.concat_ws(
        " ", F.when(_preprint(), LIMIT_PREPRINT), F.when(_text("abstract") == "", LIMIT_NO_ABSTRACT),
        *(F.when(_says(low, parts), text) for parts, text in LIMITS))
    return F.when(said == "", LIMIT_DEFAULT).otherwise(said)


def confidence(kind: Column) -> Column:
    """Low for preprints; moderate for guidelines and reviews, and for anything with an abstract; else low."""
    return (
        F.when(_preprint(), "Low").when(_says(F.lower(kind), TRUSTED_TYPES), "Moderate")
        .when(_text("abstract") != "", "Moderate").otherwise("Low")
    )


def summary() -> Column:
    """First sentence of the abstract, or a notice, with the caution."""
    first = first_sentence(F.col("abstract"))
    return F.concat(F.when(first == "", NO_ABSTRACT).otherwise(first), F.lit(CAUTION))


def annotate(papers: DataFrame) -> DataFrame:
    """Adds study_type, summary, limitations and confidence."""
    low = papers.withColumn("__low", _low())
    typed = low.withColumns({"study_type": study_type(F.col("__low")), "limitations": limitations(F.col("__low")), "summary": summary()})
    return typed.withColumn("confidence", confidence(F.col("study_type"))).drop("__low")
