"""Queries of the surveillance operators over the papers, documents and events tables."""

from __future__ import annotations

import json
import tempfile
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.config import CYTO, DIGITAL, GENERAL, GP, GUIDELINES, LAB, MOLECULAR, QUALITY, SURGICAL, TREATMENT, Profile, Topics, load_topics
from litquarry.functions import text
from litquarry.operators import annotate as notes
from litquarry.operators import dedupe as dd
from litquarry.operators import report, score
from litquarry.plans.pipeline import listed_papers, ranked_papers, ranked_scores
from litquarry.plans.vocabulary import TOPICS
from litquarry.schema import as_papers
from litquarry.session import load, materialise, spread
from litquarry.sources import log, payloads
from litquarry.sources.query_groups import query_groups

PROFILE_IDS = (GENERAL, SURGICAL, MOLECULAR, DIGITAL, CYTO, LAB, QUALITY, TREATMENT, GP, GUIDELINES)
AS_OF, DAY = "2024-01-15", "2026-01-01"


def papers_view(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The papers table in the record schema; the key is the order of arrival."""
    df = load(spark, d, "papers").withColumnsRenamed({"paper_id": "ord", "pub_year": "year", "pub_date": "date"})
    df = as_papers(df.drop("authors", "matched_profiles"))
    return df.select("ord", *columns) if columns else spread(df)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return papers_view(spark, d, "title").select("ord", text.normalize_title(F.col("title")).alias("normalized"))


def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return papers_view(spark, d, "abstract").select("ord", text.first_sentence(F.col("abstract")).alias("sentence"))


def shorten(spark: SparkSession, d: str) -> DataFrame:
    return papers_view(spark, d, "abstract").select("ord", text.shorten(F.col("abstract"), 420).alias("short"))


def truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.truncate(F.col("text"), 390).alias("cut"))


def split_authors(spark: SparkSession, d: str) -> DataFrame:
    split = load(spark, d, "papers", "paper_id", "authors").select("paper_id", text.split_authors(F.col("authors")).alias("a"))
    return split.select("paper_id", F.size("a").alias("n_authors"), F.array_join("a", "|").alias("joined"))


def query_builder(spark: SparkSession, d: str) -> DataFrame:
    """One search text per journal from its categories: the column form of the query builder."""
    by = load(spark, d, "papers", "journal", "category").filter("journal IS NOT NULL AND category IS NOT NULL")
    terms = by.groupBy("journal").agg(F.sort_array(F.collect_set("category")).alias("terms"))  # a handful of categories
    return terms.select("journal", text.query_column(F.col("terms"), 3).alias("query"))


def query_group_texts(spark: SparkSession, d: str) -> DataFrame:
    """The search groups of the corpus vocabulary."""
    groups = (("tissue", ("tissue_core", "operative_tissue"), False, 18), ("molecular", ("molecular_stains", "slide_computing"), True, 4))
    rows = query_groups(TOPICS, groups, ("grading", "core biopsy")).items()
    return spark.createDataFrame(list(rows), "group_name string, query string")


def paper_keys(spark: SparkSession, d: str) -> DataFrame:
    return papers_view(spark, d, "title", "doi", "pmid", "pmcid").select("ord", F.explode(dd.paper_keys()).alias("key"))


def dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return papers_view(spark, d, "title", "doi", "pmid", "pmcid").select("ord", dd.dedupe_key().alias("key"))


def dedupe_unique(spark: SparkSession, d: str) -> DataFrame:
    return dd.dedupe(papers_view(spark, d, "title", "doi", "pmid", "pmcid"))[0].select("ord", "title")


def dedupe_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dd.dedupe(papers_view(spark, d, "title", "doi", "pmid", "pmcid"))[1].select("ord", "title")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(papers_view(spark, d, "title", "abstract", "publication_type", "category", "doi", "pmid", "pmcid", "is_preprint"))


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every (record, term) that occurs, negative and evidence terms included."""
    hay = score.with_haystack(_texts(spark, d))
    terms = sorted({t for p in TOPICS.profiles for t in p.terms} | set(TOPICS.negative_terms) | set(TOPICS.evidence))
    found = F.array_compact(F.array(*(F.when(text.has_term(F.col("__hay"), F.col("__low"), t), F.lit(t)) for t in terms)))
    return hay.select("ord", F.explode(found).alias("term"))


def profile_match(spark: SparkSession, d: str) -> DataFrame:
    hay = score.with_haystack(_texts(spark, d))
    hits = F.array(*(F.struct(F.lit(i).alias("profile"), h.alias("hits")) for i, _, h in score.profile_hits(TOPICS)))
    return hay.select("ord", F.explode(hits).alias("p")).select("ord", "p.profile", F.col("p.hits").cast("long").alias("hits")).filter("hits > 0")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Relevance, evidence, total and class of every record."""
    return score.score(_texts(spark, d), TOPICS).select(
        "ord", F.array_join("matched_profiles", ";").alias("profiles"), "relevance_score", "evidence_score", "total_score", "decision")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    scored = score.score(_texts(spark, d), TOPICS).select("ord", "title", "is_preprint", "total_score", "decision")
    return score.rank(materialise(scored, "scored")).select("ord", "rank", "total_score", "decision")


def study_type(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("ord", notes.study_type().alias("study_type"))


def limitations(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("ord", notes.limitations().alias("limitations"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return notes.annotate(_texts(spark, d)).select("ord", "confidence", "summary")


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(scores of all records, the listed records with their texts)."""
    papers = papers_view(spark, d)
    ranked = ranked_scores(papers, TOPICS)[0]
    return ranked, listed_papers(papers, ranked, TOPICS)


def _report(spark: SparkSession, d: str) -> str:
    ranked, listed = _listed(spark, d)
    return report.render(ranked, DAY, roles=TOPICS.roles, listed=listed)


def section_topk(spark: SparkSession, d: str) -> DataFrame:
    """The listed records of each section after deduplication."""
    return _listed(spark, d)[1].select("section", "position", "ord", "total_score", "title")


def qa_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts before the cut, and the duplicates."""
    papers = papers_view(spark, d)
    late = dd.late_records(papers.select("ord", "title", "doi", "pmid", "pmcid")).withColumn("late", F.lit(True))
    scored = score.score(papers, TOPICS).select("ord", "decision", "is_preprint", "matched_profiles")
    scored = scored.join(late, "ord", "left").withColumn("is_duplicate", F.coalesce("late", F.lit(False)))
    kept = F.when(~F.col("is_duplicate"), F.coalesce(report.section(TOPICS.roles), F.lit("unlisted")))
    return scored.select(kept.alias("s"), "is_duplicate").agg(
        F.count("s").alias("scored"), *(F.count_if(F.coalesce(F.col("s") == name, F.lit(False))).alias(name) for name, *_ in report.SECTIONS),
        F.count("*").alias("fetched"), F.count_if("is_duplicate").alias("duplicates"))


def daily_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last seven days and the day itself: eight dates."""
    day = F.to_date("ts")
    inside = load(spark, d, "events", "event_id", "ts", "event_type").filter(day.between(F.date_sub(F.lit(AS_OF).cast("date"), 7), F.lit(AS_OF).cast("date")))
    return inside.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A log of two days of unique, ranked records after the second day was run again with the preprints only."""
    found = ranked_papers(papers_view(spark, d), TOPICS)[0]
    first = log.log_rows(found, "2025-12-31").unionByName(log.log_rows(found, DAY))
    again = log.replace_day(first, log.log_rows(found.filter("is_preprint"), DAY), DAY)
    return again.groupBy("date_seen", "source", "decision").agg(F.count("*").alias("n"), F.sum("total_score").alias("total"))


def log_table(spark: SparkSession, d: str) -> DataFrame:
    """The same through the partitioned table on disk, with the texts and ranks it holds."""
    from litquarry.session import delete_on_exit, table_path

    found = materialise(ranked_papers(papers_view(spark, d), TOPICS)[0], "annotated")
    path = table_path(spark, "log")
    for day, rows in (("2025-12-31", found), (DAY, found), (DAY, found.filter("is_preprint"))):
        log.upsert(log.log_rows(rows, day), path, day)
    delete_on_exit(spark, path)
    return log.read_log(spark, path).groupBy("date_seen", "source", "decision").agg(
        F.count("*").alias("n"), F.sum("total_score").alias("total"), F.sum(F.length("summary")).alias("summary_chars"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


def _payload(rows: DataFrame, key: str, body) -> DataFrame:
    return rows.select(F.col(key).alias("base"), F.to_json(body).alias("payload"))


def europe_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written as search answers and read back through the parser."""
    p = load(spark, d, "papers", "paper_id", "title", "abstract", "authors", "journal", "source", "pub_year", "pub_date", "doi", "pmid", "pmcid", "publication_type")
    record = F.struct("title", F.col("abstract").alias("abstractText"), F.col("journal").alias("journalTitle"), "source", F.col("pub_year").alias("pubYear"),
                      F.col("pub_date").alias("firstPublicationDate"), "doi", "pmid", "pmcid", F.col("authors").alias("authorString"), F.col("publication_type").alias("pubType"))
    return payloads.from_europe(_payload(p, "paper_id", F.struct(F.struct(F.array(record).alias("result")).alias("resultList")))).select(
        "ord", "title", "journal", "year", "date", "url", "publication_type", F.size("authors").alias("n_authors"))


def preprint_records(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "preprints")
    record = F.struct("title", "abstract", "authors", F.col("pub_date").alias("date"), "doi", "category")
    return payloads.from_preprints(_payload(p, "preprint_id", F.struct(F.array(record).alias("collection"))), "clinprint").select(
        "ord", "title", "journal", "year", "url", "category", "is_preprint", F.size("authors").alias("n_authors"))


def summary_records(spark: SparkSession, d: str) -> DataFrame:
    """Summary records: identifiers found by type, the journal's fallback, the year from the date."""
    p = load(spark, d, "papers", "paper_id", "title", "journal", "source", "pub_date", "doi", "pmid", "pmcid", "publication_type")
    ids = F.array(*(F.struct(F.lit(t).alias("idtype"), F.col(c).alias("value")) for t, c in (("DOI", "doi"), ("pmcid", "pmcid"))))
    record = F.struct("pmid", "title", F.col("journal").alias("fulljournalname"), "source", F.col("pub_date").alias("pubdate"), ids.alias("articleids"), F.array("publication_type").alias("pubtype"))
    return payloads.from_summaries(_payload(p, "paper_id", record)).select("ord", "journal", "year", "doi", "pmid", "pmcid", "url")


def article_xml(spark: SparkSession, d: str) -> DataFrame:
    """Records written as article sets and read back through the table function.

    Every article has a labelled, an unlabelled and an empty part of its abstract, text within markup, authors with and
    without a first name and a group, two types, a date of its own of which odd records leave out the year, and a cited
    article's identifier, which counts where the record has none.
    """
    p = load(spark, d, "papers", "paper_id", "title", "abstract", "authors", "journal", "pub_year", "pmid", "doi", "pmcid", "source", "category", "batch_no")
    # characters that XML forbids or reserves are written as spaces, on both sides of the comparison
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[<>&\x00-\x1f]", " ")

    def node(tag: str, *parts) -> Column:
        return F.concat(F.lit(f"<{tag}>"), *(F.lit(x) if x.startswith("<") else safe(x) for x in parts), F.lit(f"</{tag.split()[0]}>"))

    year = F.when(F.col("paper_id") % 2 == 0, node("Year", "pub_year")).otherwise("")
    own = F.concat(F.lit("<ArticleDate>"), year, F.lit("<Month>"), F.col("batch_no").cast("string"), F.lit("</Month><Day>7</Day></ArticleDate>"))
    doi = F.when(safe("doi") != "", node('ArticleId IdType="DOI"', "doi")).otherwise("")
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation>"), node("PMID", "pmid"), F.lit("<Article><Journal><JournalIssue><PubDate>"), node("Year", "pub_year"),
        F.lit("</PubDate></JournalIssue>"), node("Title", "journal"), F.lit("</Journal>"), node("ArticleTitle", "<i>", "title", "</i>"), F.lit("<Abstract>"),
        node('AbstractText Label="AIM"', "abstract"), F.lit('<AbstractText Label="NONE"> </AbstractText>'), node("AbstractText", "source"),
        F.lit("</Abstract><AuthorList><Author><ForeName>Ann</ForeName>"), node("LastName", "source"), F.lit("</Author><Author>"), node("LastName", "category"),
        F.lit("</Author><Author>"), node("CollectiveName", "journal"), F.lit("</Author><Author/></AuthorList><PublicationTypeList><PublicationType>Letter</PublicationType>"),
        node("PublicationType", "category"), F.lit("</PublicationTypeList>"), own, F.lit("</Article></MedlineCitation><PubmedData><ArticleIdList>"), doi,
        node('ArticleId IdType="pmc"', "pmcid"), F.lit('</ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/cited</ArticleId>'
                                                       "</ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"))
    read = payloads.from_article_sets(spark, p.select(F.col("paper_id").alias("base"), xml.alias("payload")))
    return read.select("ord", "title", "abstract", F.array_join("authors", "|").alias("names"), "journal", "year", "date", "doi", "pmid", "pmcid", "url", "publication_type")


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the rendered report."""
    lines = _report(spark, d).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def written_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of both files a report is written to, the day's and the latest."""
    with tempfile.TemporaryDirectory() as folder:  # files of the driver, read on the driver
        report.write_report(_report(spark, d), folder, DAY)
        lines = [(f.name, n, line) for f in sorted(Path(folder).iterdir()) for n, line in enumerate(f.read_text(encoding="utf-8").split("\n"))]
    return spark.createDataFrame(lines, "file string, n int, line string")


def report_entries(spark: SparkSession, d: str) -> DataFrame:
    """The report written, read back and parsed."""
    from litquarry.sources import report_reader as rr

    lines = report_text(spark, d).select(F.lit("report.md").alias("file"), "n", F.trim("line").alias("line"))
    return rr.entries(lines).select("section", F.col("position").cast("long").alias("position"), "title", "score", "confidence")


def report_facts(spark: SparkSession, d: str) -> DataFrame:
    """Date and counts of the report, written and read back."""
    from litquarry.sources import report_reader as rr

    lines = report_text(spark, d).select(F.lit("report.md").alias("file"), "n", F.trim("line").alias("line"))
    return rr.counts(lines).join(rr.dates(lines), "file").select("date", "label", "value")


def _numbered_topics() -> Topics:
    """The roles' own profiles, each with its name, twenty numbered terms, and its name again in capitals."""
    return Topics(tuple(Profile(i, (i.replace("_", " "), *(f"{i[:4]}{k}" for k in range(20)), i.replace("_", " ").upper())) for i in PROFILE_IDS))


def service_groups(spark: SparkSession, d: str) -> DataFrame:
    """The five groups the services are asked with."""
    return spark.createDataFrame(list(query_groups(_numbered_topics()).items()), "group_name string, query string")


def service_records(spark: SparkSession, d: str) -> DataFrame:
    """All requests of a live run through the data source, answered by a transport that repeats them."""
    from litquarry.sources.services import fetch_live

    rows = fetch_live(spark, _numbered_topics(), asof=date.fromisoformat(AS_OF), transport="litquarry.sources.echo.answer")
    return rows.select("ord", "title", "pmid", "source", "date", "category", "is_preprint", "url")


def fixture_records(spark: SparkSession, d: str) -> DataFrame:
    """The feeds, of which there are six, written as a fixture of records and read by the strict reader."""
    from litquarry.session import delete_on_exit, table_path
    from litquarry.sources.fixture import load_fixture

    feeds = load(spark, d, "feeds")
    record = F.struct(F.col("source").alias("title"), F.col("tz_name").alias("journal"), F.array("day_order", "source").alias("authors"), (F.col("trust_rank") > 3).alias("is_preprint"))
    path = table_path(spark, "fixture")
    feeds.agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value")).coalesce(1).write.text(path)
    delete_on_exit(spark, path)
    return load_fixture(spark, path).select("ord", "title", "journal", F.array_join("authors", "|").alias("names"), "abstract", "is_preprint")


def topics_file(spark: SparkSession, d: str) -> DataFrame:
    """The corpus vocabulary written as a topics file and read back: every term with its profile, weight and place."""
    raw = {"min_digest_score": TOPICS.min_score, "negative_terms": list(TOPICS.negative_terms),
           "profiles": [{"id": p.id, "weight": p.weight, "terms": list(p.terms)} | ({} if p.weight != 1 else {"label": "unread"}) for p in TOPICS.profiles]}
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver, read on the driver
        file = Path(folder, "topics.json")
        file.write_text(json.dumps(raw), encoding="utf-8")
        read = load_topics(file)
    rows = [(p.id, p.weight, k, t, read.min_score, read.window_days) for p in read.profiles for k, t in enumerate(p.terms)]
    return spark.createDataFrame(rows, "profile string, weight int, place int, term string, least_score int, days int")


def message(spark: SparkSession, d: str) -> DataFrame:
    from litquarry.notify import build_message

    return spark.createDataFrame(list(enumerate(build_message(_report(spark, d), "https://reports.example/latest").split("\n"))), "n int, line string")


NAMES = (clean_text, normalize_title, first_sentence, shorten, truncate, split_authors, query_builder, query_group_texts, service_groups, service_records, fixture_records, topics_file, paper_keys, dedupe_key,
         dedupe_unique, dedupe_duplicates, term_hits, profile_match, scores, ranked, study_type, limitations, summaries, section_topk, qa_counts,
         daily_window, log_upsert, log_table, europe_records, preprint_records, summary_records, article_xml, report_text, written_report, report_entries, report_facts, message)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
