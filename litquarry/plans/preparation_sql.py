"""SQL of the data-preparation queries, written apart from their parsers: one pattern per family of dates."""

from __future__ import annotations

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
# Hours from UTC of the zone abbreviations the feeds use.
OFFSETS = {"z": 0, "utc": 0, "gmt": 0, "bst": 1, "cet": 1, "cest": 2, "est": -5, "edt": -4, "pst": -8, "pdt": -7, "aest": 10, "aedt": 11, "ist": 5.5}
# Family: pattern, and which of its groups are year, month, day and clock (0: none); a month is a number or a name.
FAMILIES = (
    ("ymd", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(.*)$", 1, 2, 3, 4),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})(T.*)?$", 1, 2, 3, 4),
    ("ymd", r"^(\d{4})[- ]([A-Za-z]{3,})\.?[- ](\d{1,2})(.*)$", 1, 2, 3, 4),
    ("ymd", r"^(\d{1,2})(?:st|nd|rd|th)?[- ]([A-Za-z]{3,})\.?[- ](\d{4}|\d{2})( .*)?$", 3, 2, 1, 4),
    ("ymd", r"^([A-Za-z]{3,})\.? (\d{1,2}), (\d{4})(.*)$", 3, 1, 2, 4),
    ("num", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})(.*)$", 3, 1, 2, 4),
    ("ym", r"^(\d{4})[- ]([A-Za-z]{3,})\.?$", 1, 2, 0, 0),
    ("ym", r"^([A-Za-z]{3,})\.? (\d{4})$", 2, 1, 0, 0),
    ("ym", r"^(\d{4})-(\d{1,2})$", 1, 2, 0, 0),
    ("ym", r"^(\d{1,2})/(\d{4})$", 2, 1, 0, 0),
)
CLOCK = r"^[T ,]*(\d{1,2}):?(\d{2})(?::?(\d{2}))?(?:\.(\d+))? ?([AaPp][Mm])? ?(.*)$"


def _family(k: int, kind: str, pattern: str, y: int, m: int, d: int, clock: int) -> str:
    group = lambda g: f"regexp_extract(t, '{pattern}', {g})" if g else "''"
    first, second = group(m), group(d)
    if kind == "num":  # which number is the day is the feed's own order
        first, second = (f"CASE day_order WHEN 'dmy' THEN {a} WHEN 'mdy' THEN {b} END" for a, b in ((second, first), (first, second)))
    return f"SELECT {k} AS k, '{kind}' AS kind, paper_id, tz_name, {group(y)} AS y, {first} AS m, {second} AS d, coalesce({group(clock)}, '') AS clock FROM written WHERE regexp_matches(t, '{pattern}')"


def _offset_hours(zone: str) -> str:
    named = " ".join(f"WHEN '{name}' THEN {hours}" for name, hours in OFFSETS.items())
    sign = f"CASE WHEN starts_with({zone}, '-') THEN -1 ELSE 1 END"
    stated = f"{sign} * (CAST(substr({zone}, 2, 2) AS INTEGER) + CAST(regexp_extract({zone}, '(\\d{{2}})$', 1) AS INTEGER) / 60.0)"
    return f"CASE WHEN regexp_matches({zone}, '^[+-]\\d{{2}}:?\\d{{2}}$') THEN {stated} ELSE CASE lower({zone}) {named} END END"


DATES = f"""WITH written AS (SELECT paper_id, pub_date, pub_year, tz_name, day_order,
   regexp_replace(trim(regexp_replace(translate(coalesce(pub_date, ''), '０１２３４５６７８９', '0123456789'), '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')), '^[A-Za-z]+, (\\d)', '\\1') AS t
   FROM papers p LEFT JOIN feeds f ON lower(trim(p.source)) = lower(trim(f.source))),
 read AS ({' UNION ALL '.join(_family(k, *f) for k, f in enumerate(FAMILIES))}),
 whole AS (SELECT k, kind, paper_id, tz_name, clock, CASE WHEN length(y) = 2 THEN '20' || y ELSE y END AS y,
   CASE WHEN regexp_matches(m, '[A-Za-z]') THEN list_position(string_split('{MONTHS}', ' '), lower(substr(m, 1, 3))) ELSE TRY_CAST(m AS INTEGER) END AS m, TRY_CAST(nullif(d, '') AS INTEGER) AS d FROM read),
 real_ones AS (SELECT *, TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(coalesce(d, 1) AS VARCHAR), 2, '0') AS DATE) AS day FROM whole WHERE m BETWEEN 1 AND 12 AND coalesce(d, 1) BETWEEN 1 AND 31),
 timed AS (SELECT *, CAST(regexp_extract(clock, '{CLOCK}', 1) AS BIGINT) AS h0, CAST(regexp_extract(clock, '{CLOCK}', 2) AS INTEGER) AS mi, coalesce(TRY_CAST(regexp_extract(clock, '{CLOCK}', 3) AS INTEGER), 0) AS s,
   CAST(rpad(left(regexp_extract(clock, '{CLOCK}', 4), 6), 6, '0') AS BIGINT) AS us, lower(regexp_extract(clock, '{CLOCK}', 5)) AS half, regexp_extract(clock, '{CLOCK}', 6) AS zone
   FROM real_ones WHERE day IS NOT NULL AND regexp_matches(clock, '{CLOCK}')),
 local AS (SELECT *, CAST(day AS TIMESTAMP) + to_microseconds(((CASE half WHEN '' THEN h0 WHEN 'am' THEN h0 % 12 ELSE h0 % 12 + 12 END * 60 + mi) * 60 + s) * 1000000 + us) AS lt,
   CASE WHEN starts_with(zone, '[') THEN trim(zone, '[]') ELSE tz_name END AS place, {_offset_hours('zone')} AS hours FROM timed WHERE h0 < 24 AND mi < 60 AND s < 60),
 late AS (SELECT *, timezone('UTC', timezone(place, lt)) AS utc FROM local WHERE zone = '' OR starts_with(zone, '[')),
 moments AS (SELECT paper_id, k, lt - to_microseconds(CAST(hours * 3600000000 AS BIGINT)) AS utc FROM local WHERE zone <> '' AND NOT starts_with(zone, '[') AND hours IS NOT NULL
   UNION ALL SELECT paper_id, k, CASE WHEN timezone(place, timezone('UTC', utc - INTERVAL 1 HOUR)) = lt THEN utc - INTERVAL 1 HOUR ELSE utc END FROM late WHERE utc IS NOT NULL
   UNION ALL SELECT paper_id, 90, make_timestamp(CAST(t AS BIGINT) * CASE length(t) WHEN 10 THEN 1000000 ELSE 1000 END) FROM written WHERE regexp_matches(t, '^(\\d{{10}}|\\d{{13}})$')),
 said AS (SELECT paper_id, k, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS norm FROM moments
   UNION ALL SELECT paper_id, k, CASE kind WHEN 'ym' THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y-%m-%d') END FROM real_ones WHERE day IS NOT NULL AND trim(clock) = ''
   UNION ALL SELECT paper_id, 95, t FROM written WHERE regexp_matches(t, '^\\d{{4}}$') AND t <> '0000'),
 best AS (SELECT paper_id, arg_min(norm, k) AS norm FROM said GROUP BY paper_id),
 dated AS (SELECT paper_id, pub_date, coalesce(norm, nullif(regexp_extract(translate(coalesce(pub_year, ''), '０１２３４５６７８９', '0123456789'), '(?:^|[^0-9])(\\d{{4}})(?:[^0-9]|$)', 1), '')) AS date_norm
   FROM written LEFT JOIN best USING (paper_id))
 SELECT paper_id, date_norm FROM dated WHERE date_norm IS NOT NULL AND date_norm <> '0000' AND date_norm IS DISTINCT FROM pub_date"""


# Texts for "missing", the strong separators, and white space.
ABSENT = "'', 'n/a', 'na', 'none', 'null', 'nil', '-', '--', 'unknown', 'unspecified', 'not available', 'not given', 'n.d.', 'et al', 'et al.'"
STRONG, BLANKS = r";；|/+\t\n\r", r"\s\x{A0}\x{3000}"
QUOTED = '"(?:[^"]|"")*"'
# Quoted values are set aside (their separators become private characters), then the text is split and they are restored.
ASIDE = ";；|/+\t\n\r,& "
KEPT = "".join(chr(0xE000 + k) for k in range(len(ASIDE)))
HIDE = f"translate(q, '{ASIDE}', '{KEPT}')"
SHOW = f"translate(v, '{KEPT}', '{ASIDE}')"
VALUES = rf"""WITH field AS (SELECT paper_id, 'authors' AS f, authors AS t FROM papers UNION ALL SELECT paper_id, 'publication_type', publication_type FROM papers
   UNION ALL SELECT paper_id, 'matched_profiles', matched_profiles FROM papers),
 listed AS (SELECT paper_id, f, CASE WHEN regexp_matches(trim(t), '^\[.*\]$', 's') THEN substr(trim(t), 2, length(trim(t)) - 2) ELSE t END AS t FROM field WHERE lower(trim(coalesce(t, ''))) NOT IN ({ABSENT})),
 plain AS (SELECT paper_id, f, regexp_replace(t, '(^|[^A-Za-z0-9])(?i:n/a)([^A-Za-z0-9]|$)', '\1n.d.\2', 'g') AS t FROM listed),
 apart AS (SELECT *, string_split_regex(t, '{QUOTED}') AS bare, regexp_extract_all(t, '{QUOTED}') AS quoted FROM plain),
 hidden AS (SELECT paper_id, f, CASE WHEN len(quoted) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(bare) + 1), lambda i: bare[i] || coalesce(list_transform([quoted[i]], lambda q: {HIDE})[1], '')), '') END AS t,
   array_to_string(bare, ' ') AS outside FROM apart),
 cut AS (SELECT paper_id, f, CASE WHEN f = 'matched_profiles' THEN string_split_regex(t, '[{STRONG},& ]+(?:and[{STRONG},& ]+)?') WHEN regexp_matches(outside, '[{STRONG}]') THEN string_split_regex(t, '[{STRONG}]+')
   ELSE string_split_regex(t, ',|&|\sand\s|^and\s|\sand$') END AS parts FROM hidden),
 each AS (SELECT paper_id, f, unnest(parts) AS v, generate_subscripts(parts, 1) AS i FROM cut),
 shown AS (SELECT paper_id, f, i, regexp_replace({SHOW}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g') AS v FROM each),
 bared AS (SELECT paper_id, f, i, CASE WHEN regexp_matches(v, '^{QUOTED}$') THEN replace(substr(v, 2, length(v) - 2), '""', '"') WHEN regexp_matches(v, '^\[[^\[\]]*\]$') THEN substr(v, 2, length(v) - 2)
   ELSE regexp_replace(v, '\s+(?i:et al)\.?$', '') END AS v,
   NOT regexp_matches(v, '^({QUOTED}|\[[^\[\]]*\])$') AND (contains(v, '"') OR contains(v, '[') <> contains(v, ']')) AS malformed FROM shown),
 kept AS (SELECT paper_id, f, i, malformed, regexp_replace(v, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g') AS v FROM bared),
 numbered AS (SELECT paper_id, f, v, malformed, row_number() OVER w AS item_pos, count(*) OVER (PARTITION BY paper_id, f) AS n FROM kept WHERE lower(v) NOT IN ({ABSENT}) WINDOW w AS (PARTITION BY paper_id, f ORDER BY i))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": DATES,
        "p7_found": f"{VALUES} SELECT paper_id, f AS field_name, item_pos, v AS item FROM numbered WHERE n >= 2",
        "p7_malformed": f"{VALUES} SELECT f AS field_name, count(*) AS n_values, count(*) FILTER (malformed) AS n_malformed FROM numbered GROUP BY f",
    }
