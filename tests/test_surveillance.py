import csv
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litquarry import cli, notify, session
from litquarry.config import GENERAL, GP, GUIDELINES, LEGACY, MOLECULAR, Profile, Settings, Topics
from litquarry.operators import dedupe as dd
from litquarry.operators import report
from litquarry.operators.annotate import annotate
from litquarry.operators.dedupe import dedupe, dedupe_key
from litquarry.operators.score import rank, score
from litquarry.plans.pipeline import run_pipeline
from litquarry.schema import as_papers
from litquarry.sources import log
from litquarry.sources import report_reader as rr
from litquarry.sources.fixture import load_fixture
from litquarry.sources.query_groups import query_groups

TOPICS = Topics(
    (Profile(GENERAL, ("pathology", "surgical pathology", "grading"), 5), Profile(MOLECULAR, ("PCR", "ISH"), 5), Profile(GP, ("primary care",), 2),
     Profile(GUIDELINES, ("guideline",), 4), Profile(LEGACY, ("microRNA",), 1)),
    negative_terms=("mice",), min_score=5)


def papers(spark, rows):
    names = sorted({k for r in rows for k in r})
    schema = ", ".join(f"{n} {'boolean' if n == 'is_preprint' else 'long' if n == 'ord' else 'string'}" for n in ["ord", *names])
    return as_papers(spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], schema))


def scored(spark, *rows):
    return {r.ord: r for r in score(papers(spark, rows), TOPICS).collect()}


def test_scores(spark):
    got = scored(
        spark,
        {"title": "Grading in surgical", "abstract": "pathology of a cohort", "doi": "10.1/x"},
        {"title": "An established practice", "abstract": "nothing"},
        {"title": "A study in mice", "abstract": ""},
        {"title": "microRNA by qRT-PCR", "abstract": "cohort", "pmid": "1"},
        {"title": "PCR", "abstract": "a randomised trial of guideline use", "is_preprint": True},
        {"title": "A guideline in primary care", "abstract": "histopathology"},
    )
    # a phrase may run from the title into the abstract
    assert (got[0].matched_profiles, got[0].relevance_score, got[0].evidence_score, got[0].decision) == ([GENERAL], 8, 4, "digest")
    assert (got[1].matched_profiles, got[1].total_score, got[1].decision) == ([], 1, "watchlist")
    assert (got[2].relevance_score, got[2].evidence_score, got[2].decision) == (-2, -5, "skip")
    assert (got[3].matched_profiles, got[3].relevance_score, got[3].decision) == ([MOLECULAR, LEGACY], 0, "watchlist")
    assert got[4].decision == "preprint_watch"
    assert (got[5].decision, got[5].matched_profiles) == ("digest", [GP, GUIDELINES])


def test_empty_and_null(spark):
    one = scored(spark, {"title": None, "abstract": None})[0]
    assert (one.total_score, one.decision) == (-3, "skip")
    assert score(papers(spark, [{"title": "x"}]).limit(0), TOPICS).count() == 0


def test_ranks_are_stable(spark):
    rows = [{"title": "b", "abstract": "x"}, {"title": "a", "abstract": "x"}, {"title": "a", "abstract": "x"}, {"title": "PATHOLOGY guideline", "abstract": "histopathology"}]
    assert [r.ord for r in rank(score(papers(spark, rows), TOPICS)).orderBy("rank").collect()] == [3, 1, 2, 0]


KEYS = st.lists(st.tuples(st.sampled_from(["", "p1", "P1 ", "p2"]), st.sampled_from(["", "d1", "d2"]), st.sampled_from(["", "t one", "T-One", "t two"])), max_size=8)


@settings(max_examples=12, deadline=None)
@given(KEYS)
def test_dedupe_against_a_loop(spark, rows):
    seen, late = set(), []
    for i, (p, d, t) in enumerate(rows):
        own = {("p", p.strip().lower())} if p.strip() else set()
        own |= {("d", d)} if d else set()
        title = "".join(c for c in t.lower() if c.isalnum() or c.isspace())
        own |= {("t", title)} if title else set()
        late += [i] if own & seen else []
        seen |= own
    unique, dup = dedupe(papers(spark, [{"pmid": p, "doi": d, "title": t} for p, d, t in rows] or [{"title": ""}]).filter(F.col("ord") < len(rows)))
    assert sorted(r.ord for r in dup.collect()) == late
    assert sorted(r.ord for r in unique.collect()) == [i for i in range(len(rows)) if i not in late]


def test_preferred_key(spark):
    df = papers(spark, [{"doi": " 10.1/A ", "title": "x"}, {"title": "X-y"}, {"title": ""}])
    assert [r.k for r in df.select("ord", dedupe_key().alias("k")).orderBy("ord").collect()] == ["doi:10.1/a", "title:xy", "title:"]


def test_annotations(spark):
    rows = [{"title": "guidelines", "abstract": ""}, {"title": "x", "abstract": "In vitro, retrospective. Second one", "publication_type": "Letter"}, {"title": "x", "abstract": "y", "is_preprint": True}]
    a, b, c = annotate(papers(spark, rows)).orderBy("ord").collect()
    assert (a.study_type, a.confidence, a.limitations) == ("Guideline / recommendation", "Moderate", "No abstract available in fetched metadata.")
    assert a.summary.startswith("No abstract available.")
    assert b.study_type == "Preclinical / in vitro" and b.summary.startswith("In vitro, retrospective. Interpretation")
    assert b.limitations.split(". ")[0] == "Retrospective design may limit causal inference"
    assert (c.study_type, c.confidence) == ("Preprint", "Low")


RECORDS = [
    {"title": "Surgical pathology grading guideline", "abstract": "Histopathology was graded. More.", "doi": "10.1/a", "journal": "J", "source": "S"},
    {"title": "A trial in primary care", "abstract": "A randomized cohort.", "pmid": "7", "source": "S", "url": "https://x.example/7"},
    {"title": "Molecular PCR panel", "abstract": "A randomised study", "source": "medrxiv", "is_preprint": True},
    {"title": "microRNA", "abstract": "cohort", "pmid": "9", "source": "S"},
    {"title": "mice", "source": "S"},
    {"title": "Other words", "doi": "10.1/A", "source": "S"},
]


@pytest.fixture
def files(tmp_path):
    raw = {"min_digest_score": 5, "profiles": [{"id": p.id, "weight": p.weight, "terms": list(p.terms)} for p in TOPICS.profiles], "negative_terms": ["mice"]}
    for name, value in (("fixture", RECORDS), ("topics", raw), ("settings", {"digest_title": "Report", "safety_note": "Note"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    return tmp_path


def args(files, day):
    return ["--fixture", f"{files}/fixture.json", "--topics", f"{files}/topics.json", "--settings", f"{files}/settings.json",
            "--out-dir", f"{files}/out", "--data-dir", f"{files}/data", "--date", day]


def test_run_twice_and_another_day(spark, files, capsys):
    for day in ("2026-01-01", "2026-01-01", "2026-01-02"):
        assert cli.main(args(files, day), spark) == 0
    assert "QA: fetched=6 scored=5 duplicates=1" in capsys.readouterr().out
    markdown = (files / "out/latest.md").read_text()
    assert markdown == (files / "out/2026-01-02.md").read_text() and markdown.startswith("# Report\nDate: 2026-01-02\n")
    assert "- Total scored candidates: 5" in markdown and "**Link:** https://doi.org/10.1/a" in markdown
    rows = (files / "data/papers.csv").read_text().splitlines()
    assert len(rows) == 11 and rows[0].split(",") == list(log.COLUMNS)
    message = notify.build_message(markdown, "https://r.example")
    assert "1. Surgical pathology grading guideline" in message and "Full digest: https://r.example" in message and len(message) < 3900
    lines = rr.report_lines(spark, f"{files}/out/2026-01-01.md")
    assert {(r.section, r.title) for r in rr.entries(lines).collect()} >= {("pathology", "Surgical pathology grading guideline"), ("gp", "A trial in primary care")}
    assert rr.dates(lines).first().date == "2026-01-01" and rr.counts(lines).filter("label = 'Total scored candidates'").first().value == "5"


def test_empty_day_leaves_no_old_rows(spark, files):
    cli.main(args(files, "2026-01-01"), spark)
    nothing = load_fixture(spark, f"{files}/fixture.json").limit(0)
    run = run_pipeline(nothing, TOPICS, Settings(), files / "out", files / "data", "2026-01-01")
    assert "No additional watchlist papers today." in run.report and run.ranked.count() == 0
    assert len((files / "data/papers.csv").read_text().splitlines()) == 1


def test_fixture_is_strict(spark, tmp_path):
    for bad in ([{"title": "a", "colour": "b"}], [{"abstract": "b"}]):
        (tmp_path / "f.json").write_text(json.dumps(bad))
        with pytest.raises(TypeError):
            load_fixture(spark, str(tmp_path / "f.json"))


def test_cli_needs_a_source(spark):
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_topk_and_counts(spark):
    rows = [{"title": f"pathology {i:02d}", "abstract": "histopathology guideline"} for i in range(13)]
    ranked = annotate(rank(score(papers(spark, rows), TOPICS)))
    assert [r.position for r in report.section_topk(ranked).orderBy("position").collect()] == list(range(1, 11))
    assert report.qa_counts(ranked).first().asDict() == {"scored": 13, "pathology": 13, "gp": 0, "preprints": 0, "watchlist": 0}


def test_query_groups():
    got = query_groups(TOPICS)
    assert list(got) == ["general_pathology", "molecular_digital_pathology", "cyto_lab_quality", "treatment_and_gp", "guidelines_reviews"]
    assert got["general_pathology"] == 'pathology OR "surgical pathology" OR grading' and got["guidelines_reviews"].endswith(") AND (guideline)")
    many = Topics((Profile(GENERAL, tuple(f"t{i}" for i in range(30))),))
    assert query_groups(many)["general_pathology"].count(" OR ") == 17
    assert Topics((Profile("a", ("X", "x", "y")),)).terms_of("a") == ["X", "y"]


def test_message_without_credentials(monkeypatch, capsys, tmp_path):
    for k in ("TELEGRAM_BOT_TOKEN", "TELEGRAM_CHAT_ID"):
        monkeypatch.delenv(k, raising=False)
    assert notify.main([]) == 0
    monkeypatch.setenv("TELEGRAM_BOT_TOKEN", "t")
    monkeypatch.setenv("TELEGRAM_CHAT_ID", "c")
    (tmp_path / "r.md").write_text("Date: 2026-01-01\n")
    sent = []
    assert notify.main(["--digest", str(tmp_path / "r.md")], lambda url, form: sent.append(form) or {"ok": True}) == 0
    assert sent[0]["chat_id"] == "c" and "No items met the threshold today." in sent[0]["text"]
    with pytest.raises(SystemExit):
        notify.main(["--digest", str(tmp_path / "r.md")], lambda url, form: {"ok": False})


def test_csv_keeps_other_days_and_any_text(spark, tmp_path):
    found = annotate(rank(score(papers(spark, [{"title": 'A "quoted",\nlong ' + "x" * 200_000}, {"title": "b"}]), TOPICS)))
    target = tmp_path / "papers.csv"
    for day, rows in (("2026-01-02", found), ("2026-01-01", found), ("2026-01-02", found.filter("title = 'b'")), ("2026-01-03", found.limit(0))):
        log.export_csv(log.log_rows(rows, day), target, day)
    got = list(csv.DictReader(target.open(newline="", encoding="utf-8")))
    assert [(r["date_seen"], len(r["title"])) for r in got] == [("2026-01-01", 200_017), ("2026-01-01", 1), ("2026-01-02", 1)] and not list(tmp_path.glob("*.new"))


def test_a_hot_key_is_one_key(spark, monkeypatch):
    """Keys of more records than the bound are broadcast; the result is that of the plain join."""
    rows = [{"title": "same title", "doi": f"10.1/{i % 7}"} for i in range(60)] + [{"title": f"own {i}", "pmid": str(i % 9)} for i in range(30)] + [{"title": ""}] * 3
    df = papers(spark, rows)
    plain = sorted(r.ord for r in dd.late_records(df).collect())
    monkeypatch.setattr(dd, "HOT", 10)
    assert sorted(r.ord for r in dd.late_records(df).collect()) == plain == [*range(1, 60), *range(69, 90)]


def test_tables_written_by_several_threads(spark):
    """The setting they share is as before once all are done, and results can be collected again."""
    before = spark.conf.get(session.CLEANUP_KEY, None)
    df = spark.range(1_000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda k: session.materialise(df.filter(f"k <> {k}"), "threads"), range(6)))
    assert [t.count() for t in tables] == [6] * 6 and spark.conf.get(session.CLEANUP_KEY, None) == before
    assert sorted(df.collect()) == sorted(df.collect())
    table, n = session.materialise_counted(df, "counted")
    assert n == table.count() == 7 and session.materialise_counted(df.limit(0), "none")[1] == 0
