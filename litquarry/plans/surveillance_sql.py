"""The surveillance queries in SQL, written apart from the expression generator. The vocabulary is shared as data only."""

from __future__ import annotations

from litquarry.plans.vocabulary import TOPICS

# The Unicode white-space characters.
S = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
W = r"[\p{L}\p{N}_]"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{S}+', ' ', 'g'))"


def _title(expr: str) -> str:
    return _clean(rf"regexp_replace(lower(coalesce({expr}, '')), '[^\p{{L}}\p{{N}}{S[1:-1]}]', '', 'g')")


def _authors(expr: str) -> str:
    flat = _clean(expr)
    part = lambda sep: f"list_filter(list_transform(string_split({flat}, '{sep}'), lambda x: trim(x)), lambda x: x <> '')"
    return (f"CASE WHEN {flat} = '' THEN []::VARCHAR[] WHEN contains({flat}, ';') THEN {part(';')} "
            f"WHEN contains({flat}, ',') AND len(string_split({flat}, ',')) <= 8 THEN {part(',')} ELSE [{flat}] END")


def _strip(column: str) -> str:
    return f"lower(regexp_replace(coalesce({column}, ''), '^{S}+|{S}+$', '', 'g'))"


KEYS = "keys AS (" + " UNION ".join(
    [f"SELECT paper_id AS ord, '{c}:' || {_strip(c)} AS key FROM papers WHERE {_strip(c)} <> ''" for c in ("pmid", "doi", "pmcid")]
    + [f"SELECT paper_id AS ord, 'title:' || {_title('title')} AS key FROM papers WHERE {_title('title')} <> ''"]) + ")"
SEEN = f"""{KEYS}, firsts AS (SELECT key, min(ord) AS f FROM keys GROUP BY key),
 dups AS (SELECT DISTINCT ord FROM keys JOIN firsts USING (key) WHERE f < ord)"""

HAY = """hay AS MATERIALIZED (SELECT paper_id AS ord, coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(publication_type, '') || ' ' || coalesce(category, '') AS h,
 coalesce(abstract, '') AS abstract, coalesce(doi, '') || coalesce(pmid, '') || coalesce(pmcid, '') AS ids, coalesce(is_preprint, false) AS is_preprint,
 coalesce(title, '') AS title, source, coalesce(publication_type, '') AS publication_type FROM papers)"""


def _re(term: str) -> str:
    return f"(^|[^\\p{{L}}\\p{{N}}_]){f'{S}+'.join(t.replace('-', '[-]') for t in term.split())}($|[^\\p{{L}}\\p{{N}}_])"


def _found(name: str, columns: str, rows: list[tuple[str, str]], text: str = "h") -> str:
    """Table of (ord, columns): the rows whose term occurs. One branch a term, so that each pattern is a constant."""
    each = [f"SELECT ord, {values} FROM hay WHERE regexp_matches({text}, {_q(_re(term))}, 'i')" for term, values in rows]
    return f"{name}(ord, {columns}) AS ({' UNION ALL '.join(each)})"


PROFILE_TERMS = _found("terms", "pos, profile, weight, term", [
    (t, f"{k}, {_q(p.id)}, {p.weight}, {_q(t)}") for k, p in enumerate(TOPICS.profiles) for t in p.terms])
EVIDENCE = _found("evidence", "term, v", [(t, f"{_q(t)}, {v}") for t, v in TOPICS.evidence.items()], "lower(h)")
NEGATIVE = _found("negative", "term", [(t, _q(t)) for t in TOPICS.negative_terms])
ANCHORS = _found("anchors", "term", [(t, _q(t)) for t in TOPICS.anchors])
HITS = "hits AS (SELECT ord, pos, profile, weight, count(*) AS n FROM terms GROUP BY ALL)"


def _in(ids: tuple[str, ...]) -> str:
    return f"list_has_any(profiles, [{', '.join(map(_q, ids))}])"


R = TOPICS.roles
SCORED = f"""{HAY}, {PROFILE_TERMS}, {EVIDENCE}, {NEGATIVE}, {ANCHORS}, {HITS},
 gains AS (SELECT ord, sum(weight + least(n, 4)) AS gain, list(profile ORDER BY pos) AS profiles FROM hits GROUP BY ord),
 lost AS (SELECT ord, count(*) AS k FROM negative GROUP BY ord),
 proof AS (SELECT ord, sum(v) AS e FROM evidence GROUP BY ord),
 anchored AS (SELECT DISTINCT ord FROM anchors),
 parts AS (SELECT hay.*, coalesce(profiles, []) AS profiles, coalesce(gain, 0) - 2 * coalesce(k, 0) AS gain,
   coalesce(e, 0) - CASE WHEN is_preprint THEN 3 ELSE 0 END + CASE WHEN abstract <> '' THEN 1 ELSE -3 END + CASE WHEN ids <> '' THEN 1 ELSE 0 END AS ev,
   anchored.ord IS NOT NULL AS anchor
   FROM hay LEFT JOIN gains USING (ord) LEFT JOIN lost USING (ord) LEFT JOIN proof USING (ord) LEFT JOIN anchored USING (ord)),
 summed AS (SELECT *, gain - CASE WHEN {_in(R.legacy)} AND NOT {_in(R.primary)} THEN 8 ELSE 0 END AS rel FROM parts),
 judged AS (SELECT *, rel + ev AS total, {_in(R.core)} AND anchor AS core, {_in(R.broad)} AND NOT {_in(R.core + R.not_broad)} AS broad FROM summed),
 scored AS (SELECT *, CASE WHEN {_in(R.legacy)} AND NOT core THEN CASE WHEN total >= 1 THEN 'watchlist' ELSE 'skip' END
   WHEN is_preprint AND total >= {TOPICS.min_score} THEN 'preprint_watch' WHEN total >= {TOPICS.min_score} AND (core OR broad) THEN 'digest'
   WHEN total >= 1 THEN 'watchlist' ELSE 'skip' END AS decision FROM judged)"""
SECTIONED = f"""sectioned AS (SELECT *, CASE WHEN decision = 'digest' AND NOT is_preprint THEN CASE WHEN {_in(R.broad)} AND NOT {_in(R.specific)} THEN 'gp' ELSE 'pathology' END
   WHEN decision IN ('digest', 'preprint_watch') AND is_preprint THEN 'preprints' WHEN decision = 'watchlist' THEN 'watchlist' END AS section
   FROM scored WHERE ord NOT IN (SELECT ord FROM dups))"""
ORDER = "decision <> 'digest', -total, is_preprint, lower(title), ord"

LOW = "lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(publication_type, ''))"
KIND = f"""CASE WHEN coalesce(is_preprint, false) THEN 'Preprint' WHEN regexp_matches({LOW}, 'guideline|recommendation') THEN 'Guideline / recommendation'
 WHEN regexp_matches({LOW}, 'systematic review|meta-analysis') THEN 'Systematic review / meta-analysis' WHEN regexp_matches({LOW}, 'randomi[sz]ed') THEN 'Randomized clinical trial'
 WHEN regexp_matches({LOW}, 'cohort') THEN 'Cohort study' WHEN regexp_matches({LOW}, 'case report') THEN 'Case report'
 WHEN regexp_matches({LOW}, 'cell line|in vitro') THEN 'Preclinical / in vitro'
 WHEN coalesce(publication_type, '') <> '' THEN publication_type ELSE 'Original/research article or unclear' END"""
CONFIDENCE = f"""CASE WHEN coalesce(is_preprint, false) THEN 'Low' WHEN regexp_matches(lower({KIND}), 'guideline|systematic review|meta-analysis') THEN 'Moderate'
 WHEN coalesce(abstract, '') <> '' THEN 'Moderate' ELSE 'Low' END"""
FLAT = _clean("abstract")
FIRST = rf"""CASE WHEN regexp_matches({FLAT}, '^.+?[.!?] ') THEN regexp_extract({FLAT}, '^(.+?[.!?]) ', 1)
 ELSE substr({FLAT}, 1, 280) || CASE WHEN length({FLAT}) > 280 THEN '...' ELSE '' END END"""
LIMITS = f"""concat_ws(' ', CASE WHEN coalesce(is_preprint, false) THEN 'Preprint; not peer reviewed.' END,
 CASE WHEN coalesce(abstract, '') = '' THEN 'No abstract available in fetched metadata.' END,
 CASE WHEN contains({LOW}, 'retrospective') THEN 'Retrospective design may limit causal inference.' END,
 CASE WHEN regexp_matches({LOW}, 'cell line|in vitro|mouse|mice') THEN 'Preclinical evidence; clinical applicability is uncertain.' END)"""
LIMITATIONS = f"CASE WHEN {LIMITS} = '' THEN 'Only metadata/abstract reviewed; verify methods, effect size, and applicability in full text.' ELSE {LIMITS} END"
SUMMARY = f"""CASE WHEN {FLAT} = '' THEN 'No abstract available. Check the full text before interpreting.' ELSE {FIRST} END
 || ' Interpretation should remain cautious because this is abstract-level surveillance.'"""
DAYS = "SELECT '2025-12-31' AS date_seen, * FROM placed UNION ALL SELECT '2026-01-01', * FROM placed WHERE is_preprint"
LOGGED = f"""WITH {SEEN}, {SCORED}, placed AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM scored WHERE ord NOT IN (SELECT ord FROM dups)), days AS ({DAYS})
 SELECT date_seen, source, decision, count(*) AS n, CAST(sum(total) AS BIGINT) AS total"""
LISTED = f"""{SEEN}, {SCORED}, {SECTIONED}, placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {ORDER}) AS position FROM sectioned WHERE section IS NOT NULL),
 entries AS (SELECT section, position, coalesce(p.title, '') AS title, coalesce(p.source, '') AS source, CASE WHEN coalesce(journal, '') = '' THEN 'Unknown' ELSE journal END AS journal,
   {KIND.replace('publication_type', 'p.publication_type').replace('title', 'p.title').replace('abstract', 'p.abstract').replace('is_preprint', 'p.is_preprint')} AS kind,
   CASE WHEN len(profiles) = 0 THEN 'No configured profile matched' ELSE array_to_string(profiles, ', ') END AS profiles,
   CAST(total AS VARCHAR) || ' = relevance ' || CAST(rel AS VARCHAR) || ' + evidence ' || CAST(ev AS VARCHAR) AS score,
   CASE WHEN coalesce(url, '') <> '' THEN url WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi END AS link, takeaway, limits, sure
   FROM placed JOIN (SELECT paper_id AS ord, title, abstract, publication_type, is_preprint, source, journal, url, doi FROM papers) p USING (ord)
   JOIN (SELECT paper_id AS ord, {SUMMARY} AS takeaway, {LIMITATIONS} AS limits, {CONFIDENCE} AS sure FROM papers) a USING (ord)
   WHERE position <= CASE section WHEN 'pathology' THEN 10 WHEN 'watchlist' THEN 8 ELSE 5 END),
 counted(label, k, v) AS (SELECT 'Total scored candidates', 0, count(*) FROM sectioned UNION ALL SELECT 'Peer-reviewed pathology digest items', 1, count(*) FILTER (section = 'pathology') FROM sectioned
   UNION ALL SELECT 'GP-useful digest items', 2, count(*) FILTER (section = 'gp') FROM sectioned UNION ALL SELECT 'Preprint watch items', 3, count(*) FILTER (section = 'preprints') FROM sectioned
   UNION ALL SELECT 'Watchlist items', 4, count(*) FILTER (section = 'watchlist') FROM sectioned)"""
# Heading of each section of the report, and what stands there if it is empty.
HEADINGS = (("pathology", "Top peer-reviewed pathology papers", "No peer-reviewed pathology papers met the digest threshold today."),
            ("gp", "General medical / GP-useful updates", "No GP-useful papers met the digest threshold today."),
            ("preprints", "Preprints — not peer reviewed", "No preprints met the watch threshold today."),
            ("watchlist", "Additional watchlist", "No additional watchlist papers today."))
NL = "chr(10)"
BLOCK = f"""concat_ws({NL}, '### ' || CAST(position AS VARCHAR) || '. ' || title, '**Source:** ' || source || '  ', '**Journal:** ' || journal || '  ', '**Study type:** ' || kind || '  ',
 '**Matched profile:** ' || profiles || '  ', '**Score:** ' || score || '  ', '**Link:** ' || link || '  ', '**Takeaway:** ' || takeaway, '**Limitations:** ' || limits,
 '**Confidence:** ' || sure, '')"""
PIECES = " UNION ALL ".join(
    f"""SELECT {k}, {_q('## ' + heading)} || {NL} || coalesce((SELECT string_agg({BLOCK}, {NL} ORDER BY position) FROM entries WHERE section = '{name}'), {_q(empty)}) || {NL}"""
    for k, (name, heading, empty) in enumerate(HEADINGS, 1))
REPORT = f"""WITH {LISTED}, pieces(k, t) AS (SELECT 0, '# Daily General Pathology Research Digest' || {NL} || 'Date: 2026-01-01' || {NL} || {NL} || '> Research surveillance and education only.' || {NL}
   UNION ALL {PIECES}
   UNION ALL SELECT 9, '## Pipeline QA' || {NL} || (SELECT string_agg('- ' || label || ': ' || CAST(v AS VARCHAR), {NL} ORDER BY k) FROM counted)),
 whole AS (SELECT string_split(string_agg(t, {NL} ORDER BY k) || {NL}, {NL}) AS lines FROM pieces)
 SELECT CAST(i - 1 AS INTEGER) AS n, lines[i] AS line FROM whole, range(1, len(lines) + 1) r(i)"""
SHORT = f"CASE WHEN length(trim(takeaway)) <= 420 THEN trim(takeaway) ELSE rtrim(substr(trim(takeaway), 1, 417)) || '...' END"
ENTRY = f"""concat_ws({NL}, CAST(position AS VARCHAR) || '. ' || trim(title), trim(journal) || CASE WHEN trim(source) <> '' THEN ' | ' || trim(source) ELSE '' END || ' | Score ' || score,
 'Takeaway: ' || {SHORT}, 'Link: ' || trim(link), '')"""
SAID = " UNION ALL ".join(
    f"SELECT {k}, '{label}:' || {NL} || coalesce((SELECT string_agg({ENTRY}, {NL} ORDER BY position) FROM entries WHERE section = '{name}' AND position <= {most}), 'No items met the threshold today.') || {NL}"
    for k, (name, label, most) in enumerate((("pathology", "Top pathology", 3), ("gp", "GP-useful highlight", 1), ("preprints", "Preprint highlight", 1)), 1))
GLANCE = " || ' | ' || ".join(f"'{short} ' || (SELECT CAST(v AS VARCHAR) FROM counted WHERE k = {k})" for short, k in (("GP", 2), ("Preprints", 3), ("Watchlist", 4)))
MESSAGE = f"""WITH {LISTED}, pieces(k, t) AS (SELECT 0, 'Daily Pathology Digest - 2026-01-01' || {NL} UNION ALL {SAID}
   UNION ALL SELECT 8, 'At a glance: ' || {GLANCE} || {NL} || 'Full digest: https://reports.example/latest' || {NL}
   UNION ALL SELECT 9, 'Research surveillance only; verify full text before changing practice.'),
 joined AS (SELECT string_agg(t, {NL} ORDER BY k) AS m FROM pieces),
 whole AS (SELECT string_split(CASE WHEN length(m) <= 3900 THEN m ELSE rtrim(substr(m, 1, 3880), ' ' || {NL}) || {NL} || '...continued in digest' END, {NL}) AS lines FROM joined)
 SELECT CAST(i - 1 AS INTEGER) AS n, lines[i] AS line FROM whole, range(1, len(lines) + 1) r(i)"""
SAFE = lambda c: f"regexp_replace(coalesce({c}, ''), '[<>&\\x00-\\x1f]', ' ', 'g')"
PLAIN = lambda c: _clean(f"regexp_replace(coalesce({c}, ''), '[<>&\\x00-\\x1f]', ' ', 'g')")


def oracle_sql() -> dict[str, str]:
    find = lambda c: f"coalesce({c}, '')"
    first = lambda *cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ", '')"
    doi_url = "CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi ELSE '' END"
    anchor = 'grading OR "core biopsy"'
    tissue = [t for p in TOPICS.profiles[:2] for t in p.terms]
    molecular = [t for i in ("molecular_stains", "slide_computing") for p in TOPICS.profiles if p.id == i for t in p.terms][:4]
    joined = lambda ts: " OR ".join(f'"{t}"' if " " in t else t for t in ts)
    return {
        "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
        "normalize_title": f"SELECT paper_id AS ord, {_title('title')} AS normalized FROM papers",
        "first_sentence": f"SELECT paper_id AS ord, {FIRST} AS sentence FROM papers",
        "shorten": f"SELECT paper_id AS ord, CASE WHEN length({FLAT}) <= 420 THEN {FLAT} ELSE rtrim(substr({FLAT}, 1, 417)) || '...' END AS short FROM papers",
        "truncate": f"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 390 THEN coalesce(text, '')
            ELSE regexp_replace(substr(text, 1, 370), '{S}+$', '') || chr(10) || '...continued in digest' END AS cut FROM documents""",
        "split_authors": f"SELECT paper_id, CAST(len(a) AS INTEGER) AS n_authors, array_to_string(a, '|') AS joined FROM (SELECT paper_id, {_authors('authors')} AS a FROM papers)",
        "query_builder": """SELECT journal, array_to_string(list_transform(list_filter(t, lambda x: trim(x) <> '')[1:3], lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END), ' OR ') AS query
            FROM (SELECT journal, list(DISTINCT category ORDER BY category) AS t FROM papers WHERE journal IS NOT NULL AND category IS NOT NULL GROUP BY journal)""",
        "query_group_texts": f"""SELECT * FROM (VALUES ('tissue', {_q(joined(tissue))}), ('molecular', {_q(f'({anchor}) AND ({joined(molecular)})')})) t(group_name, query)""",
        "paper_keys": f"WITH {KEYS} SELECT ord, key FROM keys",
        "dedupe_key": f"SELECT paper_id AS ord, CASE " + " ".join(f"WHEN {_strip(c)} <> '' THEN '{c}:' || {_strip(c)}" for c in ("pmid", "doi", "pmcid"))
            + f" ELSE 'title:' || {_title('title')} END AS key FROM papers",
        "dedupe_unique": f"WITH {SEEN} SELECT paper_id AS ord, coalesce(title, '') AS title FROM papers WHERE paper_id NOT IN (SELECT ord FROM dups)",
        "dedupe_duplicates": f"WITH {SEEN} SELECT paper_id AS ord, coalesce(title, '') AS title FROM papers WHERE paper_id IN (SELECT ord FROM dups)",
        "term_hits": f"""WITH {HAY}, {PROFILE_TERMS}, {EVIDENCE}, {NEGATIVE}
            SELECT ord, term FROM terms UNION SELECT ord, term FROM evidence UNION SELECT ord, term FROM negative""",
        "profile_match": f"WITH {HAY}, {PROFILE_TERMS}, {HITS} SELECT ord, profile, n AS hits FROM hits",
        "scores": f"""WITH {SCORED} SELECT ord, array_to_string(profiles, ';') AS profiles, CAST(rel AS INTEGER) AS relevance_score, CAST(ev AS INTEGER) AS evidence_score,
            CAST(total AS INTEGER) AS total_score, decision FROM scored""",
        "ranked": f"WITH {SCORED} SELECT ord, row_number() OVER (ORDER BY {ORDER}) AS rank, CAST(total AS INTEGER) AS total_score, decision FROM scored",
        "study_type": f"SELECT paper_id AS ord, {KIND} AS study_type FROM papers",
        "limitations": f"SELECT paper_id AS ord, {LIMITATIONS} AS limitations FROM papers",
        "summaries": f"SELECT paper_id AS ord, {CONFIDENCE} AS confidence, {SUMMARY} AS summary FROM papers",
        "section_topk": f"""WITH {SEEN}, {SCORED}, {SECTIONED}, placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {ORDER}) AS position FROM sectioned WHERE section IS NOT NULL)
            SELECT section, CAST(position AS INTEGER) AS position, ord, CAST(total AS INTEGER) AS total_score, title FROM placed
            WHERE position <= CASE section WHEN 'pathology' THEN 10 WHEN 'watchlist' THEN 8 ELSE 5 END""",
        "report_entries": f"""WITH {SEEN}, {SCORED}, {SECTIONED}, placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {ORDER}) AS position FROM sectioned WHERE section IS NOT NULL)
            SELECT section, position, trim(placed.title) AS title, CAST(total AS VARCHAR) || ' = relevance ' || CAST(rel AS VARCHAR) || ' + evidence ' || CAST(ev AS VARCHAR) AS score, confidence
            FROM placed JOIN (SELECT paper_id AS ord, {CONFIDENCE} AS confidence FROM papers) USING (ord)
            WHERE position <= CASE section WHEN 'pathology' THEN 10 WHEN 'watchlist' THEN 8 ELSE 5 END""",
        "qa_counts": f"""WITH {SEEN}, {SCORED}, {SECTIONED} SELECT count(*) AS scored, count(*) FILTER (section = 'pathology') AS pathology, count(*) FILTER (section = 'gp') AS gp,
            count(*) FILTER (section = 'preprints') AS preprints, count(*) FILTER (section = 'watchlist') AS watchlist,
            (SELECT count(*) FROM papers) AS fetched, (SELECT count(*) FROM dups) AS duplicates FROM sectioned""",
        "daily_window": """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
            WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-15' GROUP BY ALL""",
        "log_upsert": f"{LOGGED} FROM days GROUP BY ALL",
        "log_table": f"""{LOGGED}, CAST(sum(length(summary)) AS BIGINT) AS summary_chars, min(rank) AS first_rank, max(rank) AS last_rank
            FROM days JOIN (SELECT paper_id AS ord, {SUMMARY} AS summary FROM papers) USING (ord) GROUP BY ALL""",
        "report_text": REPORT,
        "written_report": f"SELECT file, n, line FROM ({REPORT}), (VALUES ('2026-01-01.md'), ('latest.md')) f(file)",
        "report_facts": f"WITH {LISTED} SELECT '2026-01-01' AS date, label, CAST(v AS VARCHAR) AS value FROM counted",
        "message": MESSAGE,
        "service_groups": _service_groups(),
        "service_records": _service_records(),
        "fixture_records": """SELECT row_number() OVER (ORDER BY source) - 1 AS ord, source AS title, tz_name AS journal, day_order || '|' || source AS names, '' AS abstract,
            trust_rank > 3 AS is_preprint FROM feeds""",
        "topics_file": "SELECT * FROM (VALUES " + ", ".join(f"({_q(p.id)}, {p.weight}, {k}, {_q(t)}, {TOPICS.min_score}, 7)" for p in TOPICS.profiles for k, t in enumerate(p.terms))
            + ") t(profile, weight, place, term, least_score, days)",
        "europe_records": f"""SELECT paper_id AS ord, {_clean('title')} AS title, {_clean(first('journal', 'source'))} AS journal, {find('pub_year')} AS year, {first('pub_date', 'pub_year')} AS date,
            CASE WHEN coalesce(pmid, '') <> '' THEN 'https://europepmc.org/article/MED/' || pmid ELSE {doi_url} END AS url, {_clean('publication_type')} AS publication_type,
            CAST(len({_authors('authors')}) AS INTEGER) AS n_authors FROM papers""",
        "preprint_records": f"""SELECT preprint_id AS ord, {_clean('title')} AS title, 'clinprint' AS journal, substr({find('pub_date')}, 1, 4) AS year, {doi_url} AS url,
            {find('category')} AS category, true AS is_preprint, CAST(len({_authors('authors')}) AS INTEGER) AS n_authors FROM preprints""",
        "summary_records": f"""SELECT paper_id AS ord, {_clean(first('journal', 'source'))} AS journal, substr({find('pub_date')}, 1, 4) AS year, {find('doi')} AS doi, {find('pmid')} AS pmid, {find('pmcid')} AS pmcid,
            CASE WHEN coalesce(pmid, '') <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS url FROM papers""",
        "article_xml": f"""SELECT paper_id AS ord, {PLAIN('title')} AS title,
            concat_ws(' ', CASE WHEN {PLAIN('abstract')} <> '' THEN 'AIM: ' || {PLAIN('abstract')} END, nullif({PLAIN('source')}, '')) AS abstract,
            concat_ws('|', trim('Ann ' || {PLAIN('source')}), nullif({PLAIN('category')}, ''), nullif({PLAIN('journal')}, '')) AS names,
            {PLAIN('journal')} AS journal, {PLAIN('pub_year')} AS year, CASE WHEN {PLAIN('pub_year')} <> '' THEN {PLAIN('pub_year')} || '-' || CASE WHEN batch_no < 10 THEN '0' ELSE '' END
              || CAST(batch_no AS VARCHAR) || '-07' ELSE '' END AS date,
            CASE WHEN {SAFE('doi')} <> '' THEN {PLAIN('doi')} ELSE '10.9/cited' END AS doi, {PLAIN('pmid')} AS pmid, {PLAIN('pmcid')} AS pmcid,
            CASE WHEN {PLAIN('pmid')} <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || {PLAIN('pmid')} || '/' ELSE '' END AS url,
            concat_ws(', ', 'Letter', nullif({PLAIN('category')}, '')) AS publication_type FROM papers""",
    }


def _service_groups() -> str:
    """The groups by set operations on (profile, place, term): the first 18 terms of a group's profiles without case-blind repeats."""
    # The anchor terms, and each group's profiles, whether it is anchored, its number of terms.
    anchor = ("pathology", "histopathology", "surgical pathology", "diagnostic pathology", "cytopathology", "immunohistochemistry",
              "molecular pathology", "digital pathology", "laboratory medicine", "structured reporting")
    from litquarry import config as c

    groups = (("general_pathology", (c.GENERAL, c.SURGICAL), 0, 18), ("molecular_digital_pathology", (c.MOLECULAR, c.DIGITAL), 1, 18),
              ("cyto_lab_quality", (c.CYTO, c.LAB, c.QUALITY), 0, 18), ("treatment_and_gp", (c.TREATMENT, c.GP), 1, 18), ("guidelines_reviews", (c.GUIDELINES,), 1, 10))
    members = ", ".join(f"({_q(name)}, {anchored}, {most}, {k}, {_q(i)})" for name, own, anchored, most in groups for k, i in enumerate(own))
    quoted = lambda t: f"CASE WHEN contains({t}, ' ') THEN '\"' || {t} || '\"' ELSE {t} END"
    base = " OR ".join(f'"{t}"' if " " in t else t for t in anchor)
    return f"""WITH member(g, anchored, most, k, id) AS (VALUES {members}),
 term AS (SELECT g, anchored, most, k * 100 + j AS place, CASE j WHEN 0 THEN replace(id, '_', ' ') WHEN 21 THEN upper(replace(id, '_', ' ')) ELSE substr(id, 1, 4) || CAST(j - 1 AS VARCHAR) END AS t
   FROM member, range(22) r(j)),
 first AS (SELECT g, anchored, most, t, place FROM (SELECT *, row_number() OVER (PARTITION BY g, lower(t) ORDER BY place) AS nth FROM term) WHERE nth = 1),
 cut AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY place) AS nth FROM first)
 SELECT g AS group_name, CASE WHEN any_value(anchored) = 1 THEN {_q(f'({base}) AND (')} || string_agg({quoted('t')}, ' OR ' ORDER BY place) || ')'
   ELSE string_agg({quoted('t')}, ' OR ' ORDER BY place) END AS query FROM cut WHERE nth <= most GROUP BY g"""


def _service_records() -> str:
    """What the requests of a live run carry, for the eight days to the day asked for and ten records a query."""
    days = "'2024-01-08' AS first, '2024-01-15' AS last"
    order = "CASE group_name WHEN 'general_pathology' THEN 0 WHEN 'molecular_digital_pathology' THEN 1 WHEN 'cyto_lab_quality' THEN 2 WHEN 'treatment_and_gp' THEN 3 ELSE 4 END"
    return f"""WITH asked AS (SELECT {order} AS k, query, {days} FROM ({_service_groups()})),
 searched AS (SELECT k, CAST(length('(' || query || ') AND (' || first || ':' || last || '[edat])') AS VARCHAR) AS found FROM asked),
 article AS (SELECT k, 0 AS i, found AS pmid FROM searched UNION ALL SELECT k, 1, '10' FROM searched)
 SELECT CAST(k * 2000000 + i AS BIGINT) AS ord, 'Record ' || pmid AS title, pmid, 'PubMed' AS source, '' AS date, '' AS category, false AS is_preprint, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url FROM article
 UNION ALL SELECT k * 2000000 + 1000000, '(' || query || ') AND FIRST_PDATE:[' || first || ' TO ' || last || ']', '10', 'Europe PMC', '', '', false, 'https://europepmc.org/article/MED/10' FROM asked
 UNION ALL SELECT 10000000 + j * 1000000, server || ' from 2024-01-08 to 2024-01-15', '', server, '2024-01-08', 'all', true, '' FROM (VALUES (0, 'medrxiv'), (1, 'biorxiv')) t(j, server)"""
