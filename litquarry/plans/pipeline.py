"""The whole run: deduplicate, score, rank, annotate, report, log."""

from __future__ import annotations

from datetime import date
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from litquarry.config import Settings, Topics
from litquarry.operators.annotate import annotate
from litquarry.operators.dedupe import late_records
from litquarry.operators.report import render, section_topk, write_report
from litquarry.operators.score import rank, score
from litquarry.session import materialise
from litquarry.sources.log import export_csv, log_rows, upsert


class Run(NamedTuple):
    report: str
    ranked: DataFrame
    duplicates: DataFrame


SCORES = ("ord", "title", "is_preprint", "matched_profiles", "relevance_score", "evidence_score", "total_score", "decision")
KEYS = ("ord", "title", "doi", "pmid", "pmcid")


def ranked_scores(papers: DataFrame, topics: Topics) -> tuple[DataFrame, DataFrame]:
    """(scores and rank of the unique records, without their long texts; ord of the duplicates)."""
    late = late_records(papers.select(*KEYS))
    # scored where they are read: only the narrow scores meet the duplicates, no text moves
    scored = score(papers, topics).select(*SCORES).join(late, "ord", "left_anti")
    return rank(materialise(scored, "scored")), late


def listed_papers(papers: DataFrame, ranked: DataFrame, topics: Topics) -> DataFrame:
    """The records of the report with their texts: the cut is made on the scores, then the few rows fetch their texts."""
    top = section_topk(ranked, topics.roles).drop("title", "is_preprint")
    return annotate(papers.join(top, "ord"))


def ranked_papers(papers: DataFrame, topics: Topics) -> tuple[DataFrame, DataFrame]:
    """(unique records scored, ranked and annotated; duplicates)."""
    ranked, late = ranked_scores(papers, topics)
    return annotate(papers.join(ranked.drop("title", "is_preprint"), "ord")), papers.join(late, "ord", "left_semi")


def log_table_path(spark: SparkSession, data_dir: str | Path) -> str:
    """Address of the log's table: in ``data_dir``, which on a cluster must be a URI of a folder all executors share."""
    if "://" in str(data_dir):
        return f"{str(data_dir).rstrip('/')}/papers"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name the data folder as a URI that all executors share")
    return f"{Path(data_dir).resolve().as_uri()}/papers"


def run_pipeline(papers: DataFrame, topics: Topics, settings: Settings, out_dir: str | Path, data_dir: str | Path, today: str | None = None) -> Run:
    """Write the day's report and log. Report, counts and log all read the ranked records, so these are a written table.

    ``data_dir`` may be a URI; the CSV of the log is a file of the driver: beside the table, or with a URI in ``out_dir``.
    """
    today = today or date.today().isoformat()
    ranked, duplicates = ranked_papers(papers, topics)
    ranked = materialise(ranked, "annotated")
    markdown = render(ranked, today, settings, topics.roles)
    write_report(markdown, out_dir, today)
    folder = Path(out_dir if "://" in str(data_dir) else data_dir)
    folder.mkdir(parents=True, exist_ok=True)
    rows = log_rows(ranked, today)
    upsert(rows, log_table_path(ranked.sparkSession, data_dir), today)
    export_csv(rows, folder / "papers.csv", today)
    return Run(markdown, ranked, duplicates)
