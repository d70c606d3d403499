"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

GROUPS = """e AS (SELECT left_id AS a, right_id AS b FROM match_links WHERE left_id <> right_id UNION SELECT right_id, left_id FROM match_links WHERE left_id <> right_id),
 reach(id, other) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
 grp AS (SELECT id AS paper_id, min(other) AS group_id FROM reach GROUP BY id)"""
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
FLAT = f"trim(regexp_replace(coalesce(abstract, ''), '{WS}', ' ', 'g'))"
TYPE_BARE = r"trim(regexp_replace(lower(coalesce(publication_type, '')), '[\"\[\];|]+', ' ', 'g'))"
SURVIVORS = f"""WITH RECURSIVE {GROUPS},
 said AS (SELECT group_id, paper_id, fetched_at, coalesce(trust_rank, 2147483647) AS trust, {FLAT} AS flat, pmcid, {TYPE_BARE} AS kind, p.source FROM grp JOIN papers p USING (paper_id)
   LEFT JOIN feeds f ON lower(trim(p.source)) = lower(trim(f.source))),
 claims AS (SELECT group_id, 'abstract' AS field_name, length(flat) AS n, trust, fetched_at, paper_id FROM said WHERE len(string_split(flat, ' ')) >= 5
   UNION ALL SELECT group_id, 'pmcid', 0, trust, fetched_at, paper_id FROM said WHERE regexp_matches(pmcid, '[1-9]')
   UNION ALL SELECT group_id, 'publication_type', 0, trust, fetched_at, paper_id FROM said WHERE kind NOT IN ('', 'n/a', 'na', 'none', 'null', '-', 'unknown', 'unspecified')
   UNION ALL SELECT group_id, 'source', 0, trust, fetched_at, paper_id FROM said WHERE trim(source) <> '')
 SELECT group_id, field_name, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY n DESC, trust, fetched_at DESC, paper_id) AS k FROM claims) WHERE k = 1"""


def _words(expr: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}]+'))"


NEAR = f"""WITH sets AS (SELECT paper_id AS id, {_words("concat_ws(' ', title, abstract)")} AS w FROM papers), big AS (SELECT id, w, len(w) AS n FROM sets WHERE len(w) >= 30),
 one AS (SELECT id, n, unnest(w) AS x FROM big),
 shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.id < b.id AND b.n <= a.n * 1.25 AND a.n <= b.n * 1.25 GROUP BY a.id, b.id)
 SELECT a AS paper_id_a, b AS paper_id_b FROM shared WHERE k * 10 >= 8 * (na + nb - k)"""

CLASSES = f"""WITH sets AS (SELECT paper_id AS id, list_sort({_words("concat_ws(' ', title, abstract)")}) AS w FROM papers), big AS (SELECT id, w, len(w) AS n FROM sets WHERE len(w) >= 30),
 named AS (SELECT id, w, n, min(id) OVER (PARTITION BY w) AS class_id FROM big), reps AS (SELECT * FROM named WHERE id = class_id), one AS (SELECT id, n, unnest(w) AS x FROM reps),
 shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.id <> b.id AND b.n <= a.n * 1.25 AND a.n <= b.n * 1.25 GROUP BY a.id, b.id),
 links AS (SELECT a AS class_id, count(*) AS n_links FROM shared WHERE k * 10 >= 8 * (na + nb - k) GROUP BY a)
 SELECT id AS paper_id, class_id, coalesce(n_links, 0) AS n_links FROM named LEFT JOIN links USING (class_id)"""
PLACED = """SELECT spec_name, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_broken, 0::BIGINT AS n_split_small FROM pack_specs"""
KEPT = """SELECT mix_name, source, target_share, true AS within_share, true AS within_repeats, (SELECT count(*) FROM documents d WHERE lower(trim(d.source)) = lower(trim(t.source))
  AND length(d.text) > 0) > 0 AS has_documents FROM mix_targets t"""

DOI = r"regexp_replace(regexp_extract(lower(doi), '(10\.(?s:.*))', 1), '[\s\p{P}]+$', '')"
PMID = r"regexp_replace(regexp_replace(coalesce(pmid, ''), '[^0-9]', '', 'g'), '^0+', '')"
REPEATS = f"""WITH everything AS (SELECT paper_id AS id, 0 AS seq, title, {DOI} AS doi, {PMID} AS pmid FROM papers UNION ALL SELECT incoming_id, batch_no, title, {DOI}, {PMID} FROM incoming),
 sets AS (SELECT id, seq, {_words("coalesce(title, '')")} AS w FROM everything), big AS (SELECT *, len(w) AS n FROM sets WHERE len(w) >= 6), one AS (SELECT id, seq, n, unnest(w) AS x FROM big),
 shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.seq < b.seq GROUP BY a.id, b.id)
 SELECT a AS known_id, b AS incoming_id FROM shared WHERE k * 10 >= 8 * (na + nb - k)
 UNION SELECT a.id, b.id FROM everything a JOIN everything b ON a.doi = b.doi AND a.seq < b.seq WHERE a.doi <> '' AND NOT starts_with(a.doi, '10.0000/')
 UNION SELECT a.id, b.id FROM everything a JOIN everything b ON a.pmid = b.pmid AND a.seq < b.seq WHERE a.pmid <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH RECURSIVE {GROUPS} SELECT paper_id, group_id FROM grp",
        "p4_found": SURVIVORS,
        "p5_found": NEAR,
        "p5_classes": CLASSES,
        "p6_found": REPEATS,
        "p8_placed": PLACED,
        "p9_kept": KEPT,
    }
