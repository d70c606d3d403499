"""Topics in the vocabulary of the bundled test corpus, in the same roles as the domain's own."""

from __future__ import annotations

from litquarry.config import Profile, Roles, Topics

TOPICS = Topics(
    profiles=(
        Profile("tissue_core", ("grading", "staining", "necrosis", "mitoses", "follicular lesion", "spindle cell tumour", "staging"), 5),
        Profile("operative_tissue", ("core biopsy", "frozen section", "margin mapping", "soft tissue", "squamous carcinoma"), 5),
        Profile("molecular_stains", ("immunohistochemistry", "in situ hybridisation", "panel sequencing", "karyotyping", "mass spectrometry"), 5),
        Profile("slide_computing", ("deep learning", "whole slide scanning", "digital counting", "image registration", "spectral imaging"), 4),
        Profile("cell_samples", ("fine needle aspiration", "liquid cytology", "flow cytometry", "cell block review", "Cytology"), 4),
        Profile("lab_and_blood", ("serum assay", "transfusion need", "blood donors", "flow cytometry"), 3),
        Profile("quality_safety", ("turnaround time", "specimen rejection", "interobserver agreement", "proficiency round", "double reading"), 3),
        Profile("therapy_linked", ("treatment response", "overall survival", "toxicity", "disease-free interval"), 4),
        Profile("family_practice", ("primary care", "family medicine", "antibiotic use", "rural clinics", "outpatients"), 2),
        Profile("guidance_reviews", ("systematic review", "practice guideline", "scoping review", "consensus exercise"), 4),
        Profile("older_markers", ("revisited", "older patients", "karyotyping", "electron microscopy"), 1),
    ),
    negative_terms=("editorial", "simulation exercise", "case report", "erratum"),
    anchors=("immunohistochemistry", "cytology", "core biopsy", "frozen section", "histology", "grading", "interobserver agreement"),
    roles=Roles(
        primary=("tissue_core", "operative_tissue", "cell_samples", "lab_and_blood", "quality_safety", "guidance_reviews"),
        core=("tissue_core", "operative_tissue", "slide_computing", "cell_samples", "lab_and_blood", "quality_safety"),
        broad=("family_practice",),
        not_broad=("molecular_stains", "therapy_linked"),
        specific=("tissue_core", "operative_tissue", "molecular_stains", "slide_computing", "cell_samples", "lab_and_blood",
                  "quality_safety", "therapy_linked", "guidance_reviews"),
        legacy=("older_markers",),
    ),
    min_score=5,
)
