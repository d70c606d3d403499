"""Typed configuration: profiles and lexicons as data, so that any vocabulary can be plugged in."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

# Evidence lexicon.
EVIDENCE = {
    "guideline": 5, "practice guideline": 5, "systematic review": 4, "meta-analysis": 4, "randomized": 4, "randomised": 4,
    "phase 3": 3, "phase iii": 3, "cohort": 2, "external validation": 3, "clinical trial": 3, "diagnostic accuracy": 2,
    "editorial": -3, "comment": -3, "letter": -2, "case report": -1, "mouse": -2, "mice": -2, "murine": -2, "rat model": -2,
    "cell line": -2, "in vitro": -2, "protocol": -1,
}
# Terms that anchor a text in the field.
ANCHORS = (
    "pathologist", "histopathology", "histologic", "surgical pathology", "diagnostic pathology", "anatomic pathology",
    "clinicopathologic", "pathologic diagnosis", "pathologic complete response", "pathologic response", "tumor classification",
    "WHO classification", "immunohistochemistry", "molecular pathology", "digital pathology", "whole slide imaging",
    "cytopathology", "cytology", "fine needle aspiration", "cell block", "laboratory medicine", "clinical pathology",
    "transfusion medicine", "synoptic report", "structured reporting", "interobserver agreement", "diagnostic reproducibility",
)
# Profile ids by role.
GENERAL, SURGICAL, MOLECULAR, DIGITAL, CYTO, LAB, QUALITY, TREATMENT, GP, GUIDELINES, LEGACY = (
    "general_pathology_research", "surgical_pathology_updates", "molecular_ihc_biomarkers", "digital_computational_pathology",
    "cytopathology_small_biopsy", "laboratory_medicine_transfusion", "pathology_quality_education_workflow",
    "novel_treatment_pathology_linked", "general_medical_gp_updates", "guidelines_reviews_high_level_evidence",
    "legacy_project_watch_low_priority",
)


@dataclass(frozen=True)
class Profile:
    id: str
    terms: tuple[str, ...]
    weight: int = 1


@dataclass(frozen=True)
class Roles:
    """Which profiles play which part in classification. PRIMARY gates the legacy penalty, CORE the decision; they differ."""

    primary: tuple[str, ...] = (GENERAL, SURGICAL, CYTO, LAB, QUALITY, GUIDELINES)
    core: tuple[str, ...] = (GENERAL, SURGICAL, DIGITAL, CYTO, LAB, QUALITY)
    broad: tuple[str, ...] = (GP,)
    not_broad: tuple[str, ...] = (MOLECULAR, TREATMENT)  # besides core: with one of these a record is not broad only
    specific: tuple[str, ...] = (GENERAL, SURGICAL, MOLECULAR, DIGITAL, CYTO, LAB, QUALITY, TREATMENT, GUIDELINES)
    legacy: tuple[str, ...] = (LEGACY,)


@dataclass(frozen=True)
class Topics:
    profiles: tuple[Profile, ...]
    negative_terms: tuple[str, ...] = ()
    evidence: dict[str, int] = field(default_factory=lambda: dict(EVIDENCE))
    anchors: tuple[str, ...] = ANCHORS
    roles: Roles = Roles()
    min_score: int = 4
    window_days: int = 7

    def terms_of(self, *ids: str) -> list[str]:
        """Terms of several profiles, without case-blind repeats, in order."""
        by_id = {p.id: p.terms for p in self.profiles}
        first: dict[str, str] = {}
        for i in ids:
            for t in by_id.get(i, ()):
                first.setdefault(t.lower(), t)
        return list(first.values())


@dataclass(frozen=True)
class Settings:
    # The title and note of a report without settings.
    title: str = "Daily General Pathology Research Digest"
    note: str = "Research surveillance and education only."


def load_topics(path: str | Path) -> Topics:
    """Read a topics file: profiles with terms and weights, negative terms, threshold and window."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    profiles = tuple(Profile(p["id"], tuple(p.get("terms", ())), int(p.get("weight", 1))) for p in raw.get("profiles", ()))
    return Topics(profiles, tuple(raw.get("negative_terms", ())), min_score=int(raw.get("min_digest_score", 4)),
                  window_days=int(raw.get("window_days", 7)))


def load_settings(path: str | Path) -> Settings:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    return Settings(raw.get("digest_title", Settings.title), raw.get("safety_note", Settings.note))
