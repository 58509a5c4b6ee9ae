"""SQL text of the record and rule queries, for the side-by-side check."""

from __future__ import annotations

import re

from boardsieve.functions import fixed_values as v
from boardsieve.plans.corpus import AS_OF, PIPE_MAX_AGE, POSTINGS_SQL, sql_strip


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def word(text: str, terms) -> str:
    return f"regexp_matches({text}, {q(chr(92) + 'b(?:' + '|'.join(re.escape(t) for t in terms) + ')' + chr(92) + 'b')})"


def mixed(text: str, terms, whole) -> str:
    long_terms = [t for t in terms if t not in whole]
    return f"({any_of(text, long_terms)} OR {word(text, [t for t in terms if t in whole])})"


def in_list(values) -> str:
    return "(" + ", ".join(q(x) for x in values) + ")"


def by_key(key: str, mapping: dict, default: str = "NULL") -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(x) if isinstance(x, str) else x}" for k, x in mapping.items())
    return f"(CASE {key} {cases} ELSE {default} END)"


GERMANY = v.GERMANY_NAMES + v.GERMAN_CITIES
BLOCK_SHORT = tuple(t for t in v.COUNTRY_BLOCKLIST if len(t) <= 4) + v.COUNTRY_BLOCKLIST_WHOLE_WORD


def residency(text: str) -> str:
    parts = []
    for phrase in v.RESIDENCY_PHRASES:
        window = f"substr({text}, instr({text}, {q(phrase)}), {len(phrase) + v.RESIDENCY_WINDOW})"
        parts.append(f"(contains({text}, {q(phrase)}) AND {any_of(window, v.EU_COUNTRIES)})")
    return "(" + " OR ".join(parts) + ")"


BLOCKED = mixed("l", v.COUNTRY_BLOCKLIST, BLOCK_SHORT)
OVERRIDE = f"({any_of('l', v.WORLDWIDE_KEYWORDS)} OR {any_of('l', v.EU_REGION_KEYWORDS)} OR {any_of('l', v.EU_COUNTRIES)})"
NON_EU = mixed("l", v.NON_EU_PATTERNS, v.NON_EU_WHOLE_WORD)

CLASSIFY = f"""CASE
  WHEN {any_of('lg', GERMANY)} THEN 'germany'
  WHEN {any_of('lg', v.EU_COUNTRIES)} THEN 'eu'
  WHEN {any_of('cb', v.EU_REGION_KEYWORDS)} THEN 'eu'
  WHEN {residency('cb')} THEN 'eu'
  WHEN {any_of('lg', v.WORLDWIDE_KEYWORDS)} THEN
    CASE WHEN source = 'arbeitnow' AND {any_of('l', v.WORLDWIDE_IN_LOCATION)}
              AND NOT {any_of('d5', v.WORLDWIDE_KEYWORDS)} THEN 'germany' ELSE 'worldwide' END
  WHEN {BLOCKED} AND NOT {OVERRIDE} THEN 'restricted'
  WHEN {NON_EU} THEN 'restricted'
  ELSE 'unknown' END"""

TEXTS = POSTINGS_SQL + """,
texts0 AS (
  SELECT *, lower(title) AS t, lower(location) AS l, lower(array_to_string(tags, ' ')) AS g,
    lower(substr(coalesce(description, ''), 1, 500)) AS d5,
    lower(substr(coalesce(description, ''), 1, 200)) AS d2,
    lower(coalesce(description, '')) AS full_desc, lower(company) AS co
  FROM postings),
texts AS (SELECT *, l || ' ' || g AS lg, l || ' ' || g || ' ' || d5 AS cb,
                 t || ' ' || g || ' ' || d5 || ' ' || co AS mt FROM texts0)"""

SCOPED = TEXTS + f""",
classified AS (SELECT *, {CLASSIFY} AS classified_scope FROM texts),
scoped0 AS (SELECT *, CASE WHEN remote_scope IN {in_list(v.PRESET_SCOPES)} THEN remote_scope
                           ELSE classified_scope END AS scope0 FROM classified),
scoped AS (SELECT *, CASE WHEN scope0 = 'unknown' THEN {by_key('source', v.SCOPE_DEFAULT_BY_SOURCE, 'scope0')}
                          ELSE scope0 END AS scope FROM scoped0)"""

ONSITE_BOARD_BAD = "(source = 'arbeitnow' AND NOT is_remote AND scope = 'germany')"
LOCATION_OK = f"""(CASE
  WHEN scope IN {in_list(v.ACCEPTED_SCOPES)} AND is_remote THEN TRUE
  WHEN scope IN ('restricted', 'unknown') THEN FALSE
  WHEN {any_of('cb', v.BLOCK_PHRASES)} AND NOT {any_of('cb', v.WORLDWIDE_KEYWORDS)} THEN FALSE
  WHEN {any_of('cb', v.UK_SIGNALS)} THEN FALSE
  WHEN {BLOCKED} AND NOT {OVERRIDE} THEN FALSE
  WHEN {any_of('cb', v.WORLDWIDE_KEYWORDS)} THEN TRUE
  WHEN {any_of('cb', v.EU_REGION_KEYWORDS)} THEN TRUE
  WHEN {any_of('cb', GERMANY)} THEN {any_of("(l || ' ' || g || ' ' || full_desc)", v.REMOTE_KEYWORDS)}
  WHEN {any_of('cb', v.EU_COUNTRIES)} AND {any_of('cb', v.REMOTE_KEYWORDS)} THEN TRUE
  WHEN {any_of('l', v.EU_COUNTRIES)} THEN TRUE
  WHEN {residency('cb')} THEN TRUE
  ELSE FALSE END)"""
ROLE_OK = f"""(NOT {any_of('t', v.TITLE_REJECT)} AND NOT {word('t', v.TITLE_REJECT_WHOLE_WORD)}
  AND NOT (trim(t) = '{v.INTERN_TITLE}' OR starts_with(trim(t), '{v.INTERN_TITLE} '))
  AND {any_of("(t || ' ' || g || ' ' || d2)", v.ROLE_ACCEPT)})"""
TG = "(t || ' ' || g)"
STACK_OK = f"""(NOT (({any_of(TG, v.INCOMPATIBLE_STACKS)} OR ({word(TG, ['go'])} AND {any_of(TG, v.GO_CONTEXT)}))
  AND NOT {any_of(TG, v.USER_STACK)}))"""
SENIOR_OK = f"({any_of('t', v.SENIOR_ACCEPT)} OR NOT {any_of('t', v.SENIOR_REJECT)})"
AGE_LIMIT = by_key("source", v.MAX_AGE_BY_SOURCE, str(PIPE_MAX_AGE))


def salary_ok(minimum: int) -> str:
    number = "TRY_CAST(regexp_extract(replace(salary, ',', ''), '[\\d,.]+') AS DOUBLE)"
    return f"coalesce(CASE WHEN {number} < 10000 THEN {number} * 12 ELSE {number} END >= {minimum}, TRUE)"


def recent_ok(limit: str = AGE_LIMIT) -> str:
    return f"coalesce(posted_at >= TIMESTAMP '{AS_OF}' - to_days(CAST({limit} AS INTEGER)), TRUE)"


# -- scores ------------------------------------------------------------------
NGO_POINTS = f"""(CASE WHEN {any_of('co', v.NGO_COMPANY)} THEN 2 ELSE 0 END
  + CASE WHEN {any_of('co', v.KNOWN_NGOS)} THEN 1 ELSE 0 END
  + CASE WHEN ({any_of('co', v.NGO_COMPANY)} OR {any_of('co', v.KNOWN_NGOS)}) AND
      ({' + '.join(f"contains(full_desc, {q(t)})::INT" for t in v.NGO_DESCRIPTION)}) >= 2 THEN 1 ELSE 0 END
  - CASE WHEN {any_of("(co || ' ' || full_desc)", v.NOT_NGO)} THEN 2 ELSE 0 END
  - CASE WHEN {any_of("(co || ' ' || full_desc)", v.NOT_NGO_STRONG)} THEN 3 ELSE 0 END)"""


def hit(keyword: str, text: str = "mt") -> str:
    return word(text, [keyword]) if keyword in v.STACK_WHOLE_WORD else f"contains({text}, {q(keyword)})"


def match_raw(text: str = "mt") -> str:
    groups: dict[str, list[str]] = {}
    for keyword in v.STACK_WEIGHTS:
        groups.setdefault(v.STACK_SYNONYMS.get(keyword, keyword), []).append(keyword)
    cases = []
    for name, keywords in groups.items():
        whens = " ".join(f"WHEN {hit(k, text)} THEN {v.STACK_WEIGHTS[k]}" for k in keywords)
        if name == "ngo":
            whens += f" WHEN is_ngo THEN {v.NGO_FLAG_BONUS}"
        cases.append(f"CASE {whens} ELSE 0 END")
    return "(" + " + ".join(cases) + ")"


NORMALISED = """CAST(CASE WHEN match_raw <= 0 THEN 0
  WHEN match_raw >= 50 THEN least(95 + floor((match_raw - 50) * 5 / 30.0), 100)
  WHEN match_raw >= 40 THEN 90 + floor((match_raw - 40) * 5 / 10.0)
  WHEN match_raw >= 25 THEN 70 + floor((match_raw - 25) * 20 / 15.0)
  WHEN match_raw >= 15 THEN 50 + floor((match_raw - 15) * 20 / 10.0)
  WHEN match_raw >= 5 THEN 20 + floor((match_raw - 5) * 30 / 10.0)
  ELSE floor(match_raw * 20 / 5.0) END AS INTEGER)"""

SCORED = SCOPED + f""",
ngo AS (SELECT *, greatest({NGO_POINTS}, 0) AS ngo_score FROM scoped),
ngo_flag AS (SELECT *, ngo_score >= {v.MIN_NGO_SCORE} AS is_ngo FROM ngo),
raw_score AS (SELECT *, {match_raw()} AS match_raw FROM ngo_flag),
scored AS (SELECT *, {NORMALISED} AS match_score FROM raw_score)"""

BAR = "repeat('█', CAST(round_even(match_score / 10.0, 0) AS INT)) || repeat('░', 10 - CAST(round_even(match_score / 10.0, 0) AS INT))"

# -- language ----------------------------------------------------------------
LETTERS = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}]+', ' ', 'g')) || ' '"


def grams(table: str, keys: str, text: str) -> str:
    letters = LETTERS.format(text)
    return f"""SELECT {keys}, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
    FROM (SELECT {keys}, string_split({letters}, '') AS c FROM {table})"""


PROFILE = f"""
doc_counts AS (SELECT lang, gram, count(*) AS n FROM ({grams('documents', 'lang', 'text')}) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM doc_counts) AS size FROM doc_counts GROUP BY lang),
absent AS (SELECT lang, total, size, CAST(round(ln(1 / (total + size)) * 1000000) AS BIGINT) AS floor_logp FROM totals),
gains AS (SELECT d.gram, d.lang, CAST(round(ln((d.n + 1) / (a.total + a.size)) * 1000000) AS BIGINT) - a.floor_logp AS gain
          FROM doc_counts d JOIN absent a USING (lang))"""


def detected(name: str, table: str, key: str, text: str) -> str:
    return f"""
{name}_counts AS (SELECT {key}, gram, count(*) AS n FROM ({grams(table, key, text)}) GROUP BY ALL),
{name}_gain AS (SELECT c.{key}, g.lang, sum(c.n * g.gain) AS gain FROM {name}_counts c JOIN gains g USING (gram) GROUP BY ALL),
{name}_len AS (SELECT {key}, sum(n) AS grams FROM {name}_counts GROUP BY ALL),
{name}_score AS (SELECT n.{key}, a.lang, coalesce(x.gain, 0) + n.grams * a.floor_logp AS score
   FROM {name}_len n CROSS JOIN absent a LEFT JOIN {name}_gain x ON x.{key} = n.{key} AND x.lang = a.lang),
{name} AS (SELECT {key}, lang AS detected_lang FROM {name}_score
   QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang DESC) = 1)"""


LANGUAGE_TEXT = "(title || coalesce(' ' || substr(description, 1, 300), ''))"

# -- cascade -----------------------------------------------------------------
CASCADE = SCORED + "," + PROFILE + f""",
short_texts AS (SELECT ingest_seq, {LANGUAGE_TEXT} AS text FROM postings WHERE length(trim({LANGUAGE_TEXT})) >= 20),
{detected('lang_of', 'short_texts', 'ingest_seq', 'text')},
checked AS (
  SELECT s.*, coalesce(posted_at, fetched_at) AS sort_ts, CASE
    WHEN {ONSITE_BOARD_BAD} THEN 'location: arbeitnow on-site (germany, not remote)'
    WHEN NOT {LOCATION_OK} THEN 'location: scope=' || scope || ', loc=''' || location || ''''
    WHEN NOT {ROLE_OK} THEN 'role: no dev keyword in title ''' || title || ''''
    WHEN NOT {STACK_OK} THEN 'stack: incompatible stack in ''' || title || ''''
    WHEN d.detected_lang <> 'en' THEN 'language: non-English content detected'
    WHEN scope = 'germany' AND NOT is_remote THEN 'on-site Germany: no remote/hybrid signal in ''' || title || ''''
    WHEN NOT {recent_ok()} THEN 'recency: '
      || CAST(CAST(round_even(epoch(TIMESTAMP '{AS_OF}' - posted_at) / 86400, 0) AS BIGINT) AS VARCHAR)
      || 'd old (max ' || CAST({AGE_LIMIT} AS VARCHAR) || 'd)'
    END AS local_reason
  FROM scored s LEFT JOIN lang_of d USING (ingest_seq)),
survivors AS (SELECT *, trim(lower(company)) AS company_key FROM checked WHERE local_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY sort_ts DESC, ingest_seq) = 1),
accepted AS (SELECT * FROM survivors
  QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY sort_ts DESC, ingest_seq) <= {v.MAX_PER_COMPANY}),
reasoned AS (
  SELECT c.*, CASE WHEN a.ingest_seq = c.ingest_seq THEN NULL
    WHEN a.sort_ts > c.sort_ts OR (a.sort_ts = c.sort_ts AND a.ingest_seq < c.ingest_seq) THEN 'dedup (content hash)'
    ELSE coalesce(c.local_reason, 'company cap: already {v.MAX_PER_COMPANY} from ''' || c.company || '''') END AS reject_reason
  FROM checked c LEFT JOIN accepted a ON a.content_hash = c.content_hash)"""


def fmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


_RAW = "WITH " + POSTINGS_SQL
_TEXTS = "WITH " + TEXTS
_SCOPED = "WITH " + SCOPED
_SCORED = "WITH " + SCORED
_CASCADE = "WITH " + CASCADE

SQL: dict[str, str] = {
    "posting_id": f"{_RAW} SELECT ingest_seq, id FROM postings",
    "content_hash": f"{_RAW} SELECT ingest_seq, content_hash FROM postings",
    "tags_split": f"{_RAW} SELECT ingest_seq, len(tags) AS n, array_to_string(tags, '|') AS tags FROM postings",
    "tags_roundtrip": f"{_RAW} SELECT ingest_seq, array_to_string(tags, ',') AS stored, TRUE AS same FROM postings",
    "quarantine": f"""{_RAW}, broken AS (SELECT ingest_seq, CASE WHEN salary IS NULL THEN NULL ELSE title END AS title,
        CASE WHEN posted_at IS NULL THEN NULL ELSE company END AS company, location, url, source FROM postings)
        SELECT ingest_seq, CASE WHEN title IS NULL THEN 'title' ELSE 'company' END AS missing FROM broken
        WHERE title IS NULL OR company IS NULL""",
    "scope_defaults": f"{_SCOPED} SELECT ingest_seq, source, scope0, scope FROM scoped",
    "classify_scope": f"{_SCOPED} SELECT ingest_seq, classified_scope AS scope FROM scoped",
    "has_any": f"""{_TEXTS} SELECT ingest_seq, {any_of('cb', v.WORLDWIDE_KEYWORDS)} AS worldwide,
        {any_of('cb', v.REMOTE_KEYWORDS)} AS remote, {any_of('full_desc', v.NGO_DESCRIPTION)} AS mission FROM texts""",
    "non_eu_location": f"{_TEXTS} SELECT ingest_seq, {NON_EU} AS outside, {BLOCKED} AS blocked FROM texts",
    "residency_eu": f"{_TEXTS} SELECT ingest_seq, {residency('cb')} AS resident FROM texts",
    "ngo_score": f"{_SCORED} SELECT ingest_seq, ngo_score, is_ngo FROM scored",
    "match_score_raw": f"{_SCORED} SELECT ingest_seq, match_raw FROM scored",
    "match_score": f"{_SCORED} SELECT ingest_seq, match_score FROM scored",
    "score_bar": f"{_SCORED} SELECT ingest_seq, match_score, {BAR} AS bar FROM scored",
    "match_label": f"""{_SCORED} SELECT ingest_seq, CASE WHEN match_score >= 80 THEN '🔥 Excellent' WHEN match_score >= 50 THEN '⭐ Strong'
        WHEN match_score >= 20 THEN '📊 Moderate' ELSE '📊 Low' END AS label, match_score >= 60 AS high FROM scored""",
    "onsite_source": f"{_SCOPED} SELECT ingest_seq, source FROM scoped WHERE NOT {ONSITE_BOARD_BAD}",
    "company_blocklist": f"{_TEXTS} SELECT ingest_seq, company FROM texts WHERE NOT {any_of('trim(co)', ['unknown', 'saas', '#00000001'])}",
    "location_filter": f"{_SCOPED} SELECT ingest_seq, scope FROM scoped WHERE {LOCATION_OK}",
    "role_filter": f"{_TEXTS} SELECT ingest_seq, title FROM texts WHERE {ROLE_OK}",
    "stack_filter": f"{_TEXTS} SELECT ingest_seq, title FROM texts WHERE {STACK_OK}",
    "language_filter": f"""{_RAW}, {PROFILE},
        short_texts AS (SELECT ingest_seq, {LANGUAGE_TEXT} AS text FROM postings WHERE length(trim({LANGUAGE_TEXT})) >= 20),
        {detected('lang_of', 'short_texts', 'ingest_seq', 'text')}
        SELECT ingest_seq, title FROM postings LEFT JOIN lang_of USING (ingest_seq) WHERE coalesce(detected_lang, 'en') = 'en'""",
    "language_id": f"""WITH {PROFILE}, {detected('lang_of', 'documents', 'doc_id', 'text')}
        SELECT doc_id, detected_lang FROM lang_of""",
    "onsite_germany": f"{_SCOPED} SELECT ingest_seq, scope FROM scoped WHERE NOT (scope = 'germany' AND NOT is_remote)",
    "senior_filter": f"{_TEXTS} SELECT ingest_seq, title FROM texts WHERE {SENIOR_OK}",
    "salary_filter": f"{_RAW} SELECT ingest_seq, salary FROM postings WHERE {salary_ok(50000)}",
    "recency_filter": f"{_RAW} SELECT ingest_seq, source FROM postings WHERE {recent_ok()}",
    "min_score": f"{_SCORED} SELECT ingest_seq, match_score FROM scored WHERE match_score >= 20",
    "scan_dedup": f"""{_TEXTS} SELECT ingest_seq, content_hash FROM texts WHERE {ROLE_OK}
        QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(posted_at, fetched_at) DESC, ingest_seq) = 1""",
    "company_cap": f"""{_TEXTS}, once AS (SELECT * FROM texts WHERE {ROLE_OK}
        QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(posted_at, fetched_at) DESC, ingest_seq) = 1)
        SELECT ingest_seq, company FROM once
        QUALIFY row_number() OVER (PARTITION BY trim(lower(company)) ORDER BY coalesce(posted_at, fetched_at) DESC, ingest_seq) <= 2""",
    "filter_cascade": f"""{_CASCADE} SELECT ingest_seq, id, title, company, location, source, scope, is_ngo, match_score
        FROM accepted ORDER BY match_score DESC, sort_ts DESC, ingest_seq""",
    "reject_report": f"""{_CASCADE} SELECT trim(split_part(reject_reason, ':', 1)) AS category, count(*) AS rejected FROM reasoned
        WHERE reject_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1""",
    "reject_reasons": f"{_CASCADE} SELECT ingest_seq, reject_reason FROM reasoned",
}
