"""Sectioned top-k report, counts before the cut, and the rendered Markdown."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.config import Roles, Settings

# Sections with heading, number of entries, notice when empty, label of the count.
SECTIONS = (
    ("pathology", "Top peer-reviewed pathology papers", 10, "No peer-reviewed pathology papers met the digest threshold today.", "Peer-reviewed pathology digest items"),
    ("gp", "General medical / GP-useful updates", 5, "No GP-useful papers met the digest threshold today.", "GP-useful digest items"),
    ("preprints", "Preprints — not peer reviewed", 5, "No preprints met the watch threshold today.", "Preprint watch items"),
    ("watchlist", "Additional watchlist", 8, "No additional watchlist papers today.", "Watchlist items"),
)
QA_HEADING, QA_TOTAL = "Pipeline QA", "Total scored candidates"
NO_PROFILE = "No configured profile matched"


def broad_only(roles: Roles = Roles()) -> Column:
    """A broad profile and none of the specific ones. Not the test that classification uses."""
    own = F.col("matched_profiles")
    return F.arrays_overlap(own, F.array(*map(F.lit, roles.broad))) & ~F.arrays_overlap(own, F.array(*map(F.lit, roles.specific)))


def section(roles: Roles = Roles()) -> Column:
    """Section of a classified record; null for those that are not listed."""
    d = F.col("decision")
    return (
        F.when((d == "digest") & ~F.col("is_preprint"), F.when(broad_only(roles), "gp").otherwise("pathology"))
        .when(d.isin("preprint_watch", "digest") & F.col("is_preprint"), "preprints")
        .when(d == "watchlist", "watchlist")
    )


def section_topk(ranked: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The first k of each section by rank, with their position.

    Spark keeps at most k rows per section and task before the shuffle (a window group limit), so a section that holds a
    third of all records needs no large task.
    """
    placed = ranked.withColumn("section", section(roles)).filter("section IS NOT NULL")
    numbered = placed.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy("rank", "ord")))
    most = max(k for _, _, k, _, _ in SECTIONS)
    limit = F.coalesce(*(F.when(F.col("section") == s, k) for s, _, k, _, _ in SECTIONS))
    return numbered.filter(F.col("position") <= most).filter(F.col("position") <= limit)


def qa_counts(scored: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row: records scored, and records of each section before the cut."""
    s = section(roles)
    return scored.select(s.alias("s")).agg(
        F.count("*").alias("scored"), *(F.count_if(F.coalesce(F.col("s") == name, F.lit(False))).alias(name) for name, *_ in SECTIONS))


def entry_lines() -> Column:
    """Markdown of one listed record."""
    profiles = F.when(F.size("matched_profiles") > 0, F.array_join("matched_profiles", ", ")).otherwise(NO_PROFILE)
    url, doi = F.coalesce("url", F.lit("")), F.coalesce("doi", F.lit(""))
    link = F.when(url != "", url).when(doi != "", F.concat(F.lit("https://doi.org/"), doi))
    journal = F.when(F.coalesce("journal", F.lit("")) != "", F.col("journal")).otherwise("Unknown")
    score = F.format_string("%d = relevance %d + evidence %d", "total_score", "relevance_score", "evidence_score")
    field = lambda label, value, end: F.concat(F.lit(f"**{label}:** "), value, F.lit(end))
    return F.concat_ws(
        "\n", F.format_string("### %d. %s", F.col("position"), F.col("title")),
        field("Source", F.col("source"), "  "), field("Journal", journal, "  "), field("Study type", F.col("study_type"), "  "),
        field("Matched profile", profiles, "  "), field("Score", score, "  "), field("Link", link, "  "),
        field("Takeaway", F.col("summary"), ""), field("Limitations", F.col("limitations"), ""), field("Confidence", F.col("confidence"), ""), F.lit(""))


def render(ranked: DataFrame, today: str, settings: Settings = Settings(), roles: Roles = Roles(), listed: DataFrame | None = None) -> str:
    """The whole report. Only the listed records, at most 28, come to the driver; ``listed`` has them if already cut."""
    listed = (section_topk(ranked, roles) if listed is None else listed).select("section", "position", entry_lines().alias("lines")).orderBy("section", "position").collect()
    counts = qa_counts(ranked, roles).first()
    out = [f"# {settings.title}", f"Date: {today}", "", f"> {settings.note}", ""]
    for name, heading, _, empty, _ in SECTIONS:
        own = [r.lines for r in listed if r.section == name]
        out += [f"## {heading}", *(own or [empty]), ""]
    out += [f"## {QA_HEADING}", f"- {QA_TOTAL}: {counts.scored}", *(f"- {label}: {counts[name]}" for name, *_, label in SECTIONS)]
    return "\n".join(out).strip() + "\n"


def write_report(markdown: str, out_dir: str | Path, today: str) -> None:
    """Write the dated report and the latest one."""
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    for name in (f"{today}.md", "latest.md"):
        (folder / name).write_text(markdown, encoding="utf-8")
