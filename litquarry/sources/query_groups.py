"""Search texts sent to the services, built from the profiles."""

from __future__ import annotations

from litquarry.config import CYTO, DIGITAL, GENERAL, GP, GUIDELINES, LAB, MOLECULAR, QUALITY, SURGICAL, TREATMENT, Topics
from litquarry.functions.text import build_query

MOST_TERMS = 18
# The anchor query, and the groups as (name, profiles, anchored, most terms).
ANCHOR = ("pathology", "histopathology", "surgical pathology", "diagnostic pathology", "cytopathology", "immunohistochemistry",
          "molecular pathology", "digital pathology", "laboratory medicine", "structured reporting")
GROUPS = (
    ("general_pathology", (GENERAL, SURGICAL), False, MOST_TERMS),
    ("molecular_digital_pathology", (MOLECULAR, DIGITAL), True, MOST_TERMS),
    ("cyto_lab_quality", (CYTO, LAB, QUALITY), False, MOST_TERMS),
    ("treatment_and_gp", (TREATMENT, GP), True, MOST_TERMS),
    ("guidelines_reviews", (GUIDELINES,), True, 10),
)


def query_groups(topics: Topics, groups=GROUPS, anchor: tuple[str, ...] = ANCHOR) -> dict[str, str]:
    """One search text per group: the first terms of its profiles, where anchored also one of the anchor terms."""
    out = {}
    for name, profiles, anchored, most in groups:
        own = build_query(topics.terms_of(*profiles)[:MOST_TERMS], most)
        out[name] = f"({build_query(list(anchor), 10)}) AND ({own})" if anchored else own
    return out
