"""SQL text of the board and parser queries."""

from __future__ import annotations

from boardsieve.functions import fixed_values as v
from boardsieve.plans.corpus import RAW_SQL, sql_strip
from boardsieve.plans.oracle_ledger import address_sql
from boardsieve.plans.oracle_rules import any_of, by_key, fmt, in_list, mixed, q
from boardsieve.plans.payloads import FIELDS_SQL

_F = "WITH " + FIELDS_SQL
_R = "WITH " + RAW_SQL
_LOC = f"lower({sql_strip('location')})"
_ROK_SHORT = tuple(t for t in v.REMOTEOK_RESTRICTED if len(t) <= v.REMOTEOK_WHOLE_WORD_MAX)


def sql_array(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


SCOPE_REMOTEOK = f"""(CASE WHEN {_LOC} IN ('', 'remote') THEN 'worldwide' WHEN {any_of(_LOC, v.REMOTEOK_WORLDWIDE)} THEN 'worldwide'
  WHEN {any_of(_LOC, v.REMOTEOK_GERMANY)} THEN 'germany' WHEN {any_of(_LOC, v.REMOTEOK_EU)} THEN 'eu'
  WHEN {mixed(_LOC, v.REMOTEOK_RESTRICTED, _ROK_SHORT)} AND NOT {any_of(_LOC, v.EU_COUNTRIES + v.WORLDWIDE_KEYWORDS)} THEN 'restricted'
  ELSE 'worldwide' END)"""
SCOPE_ZONE = f"""(CASE WHEN zone = 'WORLD' THEN 'worldwide' WHEN zone = 'COUNTRY' AND zone_country IN {in_list(v.IDEALIST_EU_CODES)} THEN 'eu'
  WHEN zone IN ('COUNTRY', 'STATE', 'CITY') THEN 'restricted' ELSE 'worldwide' END)"""
_BASE = "concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(country, ''))"
_QUALIFIER = """(CASE WHEN zone = 'WORLDWIDE' THEN 'Remote (Worldwide)' WHEN coalesce(zone_country, '') <> '' THEN 'Remote (' || zone_country || ')'
  WHEN coalesce(zone, '') <> '' THEN 'Remote (' || zone || ')' ELSE 'Remote' END)"""
COMPOSED = f"(CASE WHEN {_BASE} <> '' THEN {_BASE} || ' · ' || {_QUALIFIER} ELSE {_QUALIFIER} END)"


def th(x: str) -> str:
    return f"format('{{:,}}', CAST(floor({x}) AS BIGINT))"


_SIGN = by_key("coalesce(currency, 'USD')", v.CURRENCY_SYMBOLS, "currency || ' '")
_UNIT = by_key("lower(coalesce(period, ''))", v.SALARY_PERIODS, "''")
PERIOD_SALARY = f"""(CASE WHEN low > 0 AND high > 0 THEN {_SIGN} || {th('low')} || ' – ' || {_SIGN} || {th('high')} || {_UNIT}
  WHEN low > 0 THEN {_SIGN} || {th('low')} || '+' || {_UNIT} WHEN high > 0 THEN 'Up to ' || {_SIGN} || {th('high')} || {_UNIT} END)"""
PLAIN = f"""(CASE WHEN low > 0 AND high > 0 THEN '$' || {th('low')} || ' – $' || {th('high')} WHEN low > 0 THEN '$' || {th('low')} || '+'
  WHEN high > 0 THEN 'Up to $' || {th('high')} END)"""
CODED = f"""(CASE WHEN low > 0 AND high > 0 THEN {th('low')} || '–' || {th('high')} || ' ' || coalesce(currency, 'EUR') || '/year'
  WHEN low > 0 THEN {th('low')} || '+ ' || coalesce(currency, 'EUR') || '/year' WHEN high > 0 THEN 'up to ' || {th('high')} || ' ' || coalesce(currency, 'EUR') || '/year' END)"""
SINGLE = f"""(CASE WHEN low > 0 AND high > 0 AND low <> high THEN {th('low')} || '–' || {th('high')} || ' ' || coalesce(currency, 'USD')
  WHEN low > 0 THEN {th('low')} || ' ' || coalesce(currency, 'USD') WHEN high > 0 THEN {th('high')} || ' ' || coalesce(currency, 'USD') END)"""
TYPED = f"""(CASE WHEN low > 0 OR high > 0 THEN concat_ws(' ', CASE WHEN low > 0 AND high > 0 THEN {th('low')} || '–' || {th('high')}
  WHEN low > 0 THEN {th('low')} || '+' ELSE 'up to ' || {th('high')} END, nullif(currency, ''), '(' || nullif(period, '') || ')') END)"""

_MARKED = "CASE WHEN ingest_seq % 3 = 0 AND country <> '' THEN country END"
_PLACE_TAGS = f"""list_filter(areas, lambda t: t NOT IN {in_list(v.RELIEFWEB_FEEDS.values())} AND lower(t) <> lower(author)
  AND NOT ({' OR '.join(f"contains(t, {q(w)})" for w in v.RELIEFWEB_ORG_WORDS)}))"""
TAG_LOCATION = f"coalesce({_MARKED}, ({_PLACE_TAGS})[1], 'Unspecified')"

_SLUG_PLACES = in_list(v.SLUG_CITIES + v.SLUG_COUNTRIES)
_CARD = "lower(card)"
PHRASES = "list_filter([" + ", ".join(
    [f"CASE WHEN contains({_CARD}, {q(c.lower())}) THEN {q(c)} END" for c in v.EUROBRUSSELS_CATEGORIES + ("Hybrid", "Remote")]) + "], lambda x: x IS NOT NULL)"
_WT = "(" + "|".join(v.GOODJOBS_PATTERN_CITIES) + "|" + v.GOODJOBS_CITY_PATTERN + r")\s*\|\s*(" + "|".join(v.GOODJOBS_WORK_TYPES) + ")"
_CITY, _KIND = (f"regexp_extract(card, {q(_WT)}, {i})" for i in (1, 2))
_KNOWN = "CASE " + " ".join(f"WHEN contains({_CARD}, {q(c.lower())}) THEN {q(c + ', Germany')}" for c in v.GOODJOBS_CITIES) + " END"
WORKTYPE = f"""(CASE WHEN {_CITY} <> '' THEN {_CITY} || ', Germany' || CASE WHEN {_KIND} IN ('Remote', 'Hybrid') THEN ' (' || {_KIND} || ')' ELSE '' END
  ELSE coalesce({_KNOWN}, 'Germany') END)"""
_LO, _HI = (f"regexp_extract(card, {q(v.GOODJOBS_SALARY_PATTERN)}, {i})" for i in (1, 2))
TYPED_PLACE = """coalesce(nullif(city, '') || ', ' || nullif(country, ''), nullif(country, ''), nullif(state, ''), nullif(city, ''), 'Remote')"""
_N, _U = r"regexp_extract(age, '(\d+)\s+(minute|hour|day|week|month)s?\s+ago', 1, 'i')", r"lower(regexp_extract(age, '(\d+)\s+(minute|hour|day|week|month)s?\s+ago', 2, 'i'))"
MOMENT = f"CASE WHEN {_N} <> '' THEN fetched_at - to_seconds(CAST({_N} AS BIGINT) * {by_key(_U, v.RELATIVE_TIME_SECONDS)}) END"
_CODES = "list_distinct(list_transform(regions, lambda r: lower(r)))"
REGION_SCOPE = f"""(CASE WHEN len({_CODES}) > 2 THEN 'eu' WHEN list_has_any({_CODES}, ['eu', 'europe']) THEN 'eu'
  WHEN list_has_any({_CODES}, {sql_array(v.DACH_CODES)}) THEN 'germany' WHEN {_CODES} = ['pl'] THEN 'eu'
  WHEN {any_of('lower(%s)', v.SCOPE_WORLDWIDE_WORDS)} THEN 'worldwide' ELSE 'eu' END)"""
WANTED = f"""(len(list_filter(categories, lambda c: {any_of("replace(lower(c), '-', ' ')", [w.replace('-', ' ') for w in v.HIMALAYAS_CATEGORIES])})) > 0
  OR {any_of('lower(title)', v.HIMALAYAS_TITLES)})"""
_RS = "list_transform(restrictions, lambda r: lower(r))"
ELIGIBLE = f"(len(restrictions) = 0 OR list_has_any({_RS}, {sql_array(v.HIMALAYAS_OPEN + v.HIMALAYAS_EU)}))"
_EU = f"list_intersect({_RS}, {sql_array(v.HIMALAYAS_EU)})"
RESTRICTION_SCOPE = f"""(CASE WHEN len(restrictions) = 0 THEN 'worldwide' WHEN list_has_any({_RS}, {sql_array(v.SCOPE_WORLDWIDE_WORDS)}) THEN 'worldwide'
  WHEN len({_EU}) > 1 THEN 'eu' WHEN {_EU} = ['germany'] THEN 'germany' WHEN len({_EU}) = 1 THEN 'eu' ELSE 'worldwide' END)"""
PREFILTER = f"(NOT {any_of('lower(title)', v.H80K_REJECT)} AND {any_of('lower(title)', v.H80K_DEV)})"
_ANCHORS = r"""unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos"""

_KEY = "(ingest_seq - CASE WHEN ingest_seq % 11 = 0 THEN 1 ELSE 0 END)"
_NO = "CAST(NULL AS VARCHAR)"


def board(url: str, location: str, title: str = "title", company: str = "company", remote: str = "TRUE", scope: str = _NO,
          salary: str = _NO, tags: str = "tags", posted: str = "posted_at", chars: str = "CAST(NULL AS INT)", city: str = _NO,
          ngo: str = "CAST(NULL AS BOOLEAN)", where: str = "TRUE", first_by: str | None = None, dedup_where: str = "TRUE",
          ctes: str = "", source: str = "fields") -> str:
    """Expected output of one board: filter, first item per key, projection, row checks."""
    dedup = f"QUALIFY row_number() OVER (PARTITION BY {first_by} ORDER BY ingest_seq) = 1" if first_by else ""
    return f"""{_F}{ctes}, kept AS (SELECT * FROM {source} WHERE {dedup_where} {dedup})
      SELECT {url} AS url, {sql_strip(title)} AS title, {sql_strip(company)} AS company, {location} AS location, {remote} AS is_remote,
        {scope} AS remote_scope, {salary} AS salary, array_to_string({tags}, '|') AS tags, {fmt(posted)} AS posted_at,
        coalesce({chars}, 0) AS n_chars, {city} AS company_city, coalesce({ngo}, FALSE) AS is_ngo_source FROM kept WHERE {where}"""


_CSV_TAGS = "list_filter(list_transform(string_split(tags_csv, ','), lambda t: trim(t)), lambda t: t <> '')"
_FIRST_CITY = "nullif(nullif(city, ''), 'remote')"
_NOFLUFF_LOC = "coalesce(nullif(city, ''), nullif(country, ''), 'Remote')"
_STEP_LOC = "coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(state, '')), ''), nullif(country, ''), 'Germany (Remote)')"
_MUSE_PLACES = f"list_filter(restrictions, lambda n: lower(n) NOT IN {in_list(v.MUSE_NON_PLACES)})"
_MUSE_TEXT = "lower(array_to_string(restrictions, ' '))"
_H80_CITIES = "list_filter([city], lambda c: c <> '')"
_H80_LOC = f"CASE WHEN len({_H80_CITIES}) > 0 THEN city WHEN len(restrictions) > 0 THEN array_to_string(restrictions[1:3], ', ') ELSE 'Remote' END"
_H80_TEXT = f"lower(array_to_string(list_concat({_H80_CITIES}, restrictions), ' '))"
_LAND_LOC = """CASE WHEN ingest_seq % 3 = 0 THEN 'EU (Remote)' ELSE coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(zone_country, '')), ''), 'EU') END"""
_LAND_TAGS = "list_concat(list_transform(tags, lambda t: trim(t))[1:10], ['Full-time'])"
_ROK_LOC = "CASE WHEN location = '' THEN 'Remote' ELSE location END"
_WWR_TAG = "list_filter([nullif(trim(tags[1]), '')], lambda t: t IS NOT NULL)"

SQL: dict[str, str] = {
    "payload_gate": f"""SELECT page_id, source, CASE WHEN page_id % 23 = 0 THEN 'rate_limited'
        WHEN source = 'linkedin' AND (page_id % 19 = 0 OR contains(lower(substr(html, 1, 500)), 'login')) THEN 'login'
        WHEN page_id % 19 = 0 OR page_id % 17 = 0 THEN 'http_error'
        WHEN source IN ('techjobsforgood', 'eurobrussels', 'goodjobs') AND length(html) < {v.HTML_MIN_CHARS} THEN 'too_short'
        WHEN source = 'techjobsforgood' AND {any_of('lower(html)', v.TECHJOBS_BLOCK_PHRASES)} THEN 'blocked' ELSE 'ok' END AS label
        FROM (SELECT *, ['techjobsforgood', 'eurobrussels', 'goodjobs', 'linkedin', 'remotive'][page_id % 5 + 1] AS source FROM pages)""",
    "html_elements": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]'))::BIGINT AS n_{t}"
                                                    for t in ("html", "p", "h1", "li", "a", "br", "article", "script")) + " FROM pages",
    "html_links": f"SELECT page_id, pos, href, text FROM (SELECT page_id, {_ANCHORS} FROM pages)",
    "html_title": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "link_dedup": f"""SELECT href, text FROM (SELECT page_id, {_ANCHORS} FROM pages)
        QUALIFY row_number() OVER (PARTITION BY href ORDER BY (length(text) >= 5) DESC,
          CASE WHEN length(text) >= 5 THEN -page_id ELSE page_id END, CASE WHEN length(text) >= 5 THEN -pos ELSE pos END) = 1""",
    "source_dedup": f"{_R} SELECT ingest_seq, source, url FROM raw_postings QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY ingest_seq) = 1",
    "address_parse": f"""{_R}, {address_sql('raw_postings', 'ingest_seq', 'location')}
        SELECT ingest_seq, city, postal, country FROM raw_postings LEFT JOIN addressed USING (ingest_seq)""",
    "scope_remoteok": f"{_R} SELECT ingest_seq, {SCOPE_REMOTEOK} AS scope FROM raw_postings",
    "scope_zone": f"{_F} SELECT ingest_seq, {SCOPE_ZONE} AS scope FROM fields",
    "location_compose": f"{_F} SELECT ingest_seq, {COMPOSED} AS location FROM fields",
    "salary_format": f"{_F} SELECT ingest_seq, {PERIOD_SALARY} AS with_period, {PLAIN} AS plain, {CODED} AS coded, {SINGLE} AS single FROM fields",
    "location_from_tags": f"{_F} SELECT ingest_seq, {TAG_LOCATION} AS location FROM fields",
    "slug_location": f"""{_F}, w AS (SELECT ingest_seq, unnest(string_split(slug, '_')) AS word, unnest(range(len(string_split(slug, '_')))) AS pos FROM fields),
        last_other AS (SELECT ingest_seq, max(CASE WHEN word NOT IN {_SLUG_PLACES} THEN pos END) AS stop FROM w GROUP BY 1)
        SELECT ingest_seq, coalesce(string_agg(CASE WHEN pos > coalesce(stop, -1) THEN word END, ' ' ORDER BY pos), '') AS location
        FROM w JOIN last_other USING (ingest_seq) GROUP BY 1""",
    "phrase_tags": f"{_F} SELECT ingest_seq, array_to_string({PHRASES}, '|') AS tags, {any_of(_CARD, v.EUROBRUSSELS_NGO)} AS ngo FROM fields",
    "location_worktype": f"{_F} SELECT ingest_seq, {WORKTYPE} AS location FROM fields",
    "salary_range_de": f"{_F} SELECT ingest_seq, CASE WHEN {_LO} <> '' THEN {_LO} || ' – ' || {_HI} || '/yr' END AS salary FROM fields",
    "ngo_legal_form": f"{_F} SELECT ingest_seq, {any_of('lower(company || chr(32) || card)', v.GOODJOBS_LEGAL_FORMS)} AS ngo FROM fields",
    "places_location": f"{_F} SELECT ingest_seq, {TYPED_PLACE} AS location FROM fields",
    "relative_time": f"{_F} SELECT ingest_seq, {fmt(MOMENT)} AS moment FROM fields",
    "scope_regions": f"{_F} SELECT ingest_seq, {REGION_SCOPE % (('location',) * len(v.SCOPE_WORLDWIDE_WORDS))} AS scope FROM fields",
    "category_gate": f"{_F} SELECT ingest_seq, {WANTED} AS wanted FROM fields",
    "scope_restrictions": f"{_F} SELECT ingest_seq, {ELIGIBLE} AS eligible, {RESTRICTION_SCOPE} AS scope FROM fields",
    "scope_country_code": f"{_F} SELECT ingest_seq, CASE WHEN list_has_any({_CODES}, {sql_array(v.DACH_CODES)}) THEN 'germany' ELSE 'eu' END AS scope FROM fields",
    "strip_html": f"{_F} SELECT ingest_seq, {sql_strip(chr(39) + ' ' + chr(39) + ' || title || ' + chr(39) + '   x ' + chr(39))} AS text FROM fields",
    "remote_evidence": f"""{_F} SELECT ingest_seq, CASE WHEN {any_of('lower(title)', v.STEPSTONE_REMOTE)} THEN 'title'
        WHEN is_remote THEN 'flag' ELSE 'feed' END AS evidence FROM fields""",
    "board_prefilter": f"{_F} SELECT ingest_seq, {PREFILTER} AS wanted FROM fields",
    "norm_remotive": board("url", "CASE WHEN ingest_seq % 17 <> 0 THEN location ELSE 'Anywhere' END", salary="nullif(salary, '')",
                           chars="length(description)::INT", first_by="url"),
    "norm_arbeitnow": board("url", "location", remote="is_remote", salary="nullif(salary, '')", tags=_CSV_TAGS, chars="length(description)::INT",
                            city="city", source="with_city",
                            ctes=", " + address_sql("raw_postings", "ingest_seq", "location") + """,
                              with_city AS (SELECT f.* EXCLUDE (city), a.city FROM fields f LEFT JOIN addressed a USING (ingest_seq))"""),
    "norm_remoteok": board(f"CASE WHEN ingest_seq % 5 <> 0 THEN url ELSE '{v.REMOTEOK_URL}' || ingest_seq END", _ROK_LOC, scope=SCOPE_REMOTEOK,
                           salary=PLAIN, chars="length(description)::INT"),
    "norm_idealist": board(f"'{v.IDEALIST_URL}/j/' || ingest_seq", COMPOSED, scope=SCOPE_ZONE, salary=PERIOD_SALARY,
                           tags="list_transform(list_concat(tags, areas), lambda t: trim(t))", chars="(CASE WHEN length(description) > 5000 THEN 5000 ELSE length(description) END)::INT",
                           ngo="ingest_seq % 2 = 0", first_by=_KEY),
    "norm_devex": board(f"'{v.DEVEX_URL}' || CASE WHEN ingest_seq % 3 = 0 THEN 's-' || ingest_seq ELSE {_KEY}::VARCHAR END", TYPED_PLACE,
                        tags="tags[1:10]", ngo="TRUE", first_by=_KEY, dedup_where=f"{_KEY} <> 0", where=f"length({sql_strip('title')}) >= 5"),
    "norm_stepstone": board(f"CASE WHEN ingest_seq % 2 = 0 THEN url ELSE '{v.STEPSTONE_URL}' || {_KEY} END", _STEP_LOC,
                            title="(CASE WHEN ingest_seq % 4 <> 0 THEN title ELSE 'Entwickler' END)", scope="'germany'", tags="[]::VARCHAR[]",
                            posted="date_trunc('day', posted_at)", first_by=_KEY),
    "norm_nofluff": board(f"'{v.NOFLUFF_URL}' || {_KEY}", _NOFLUFF_LOC, scope=REGION_SCOPE % ((_NOFLUFF_LOC,) * len(v.SCOPE_WORLDWIDE_WORDS)), salary=TYPED,
                          tags="list_filter(['Senior', nullif(tags[1], ''), kind], lambda t: t IS NOT NULL)",
                          posted="(fetched_at - to_days(CAST(ingest_seq % 20 AS INTEGER)))", first_by=_KEY,
                          dedup_where=f"""lower(kind) IN {in_list(v.NOFLUFF_CATEGORIES)} AND is_remote AND page_fetched - (fetched_at - to_days(CAST(ingest_seq % 20 AS INTEGER)))
                            <= INTERVAL {v.NOFLUFF_MAX_AGE_DAYS} DAY""", source="paged",
                          ctes=", paged AS (SELECT *, max(fetched_at) OVER (PARTITION BY ingest_seq // 50) AS page_fetched FROM fields)"),
    "norm_himalayas": board("url", "coalesce(nullif(array_to_string(restrictions[1:3], ', '), ''), 'Remote (Worldwide)')", scope=RESTRICTION_SCOPE,
                            salary=SINGLE, tags="list_concat(list_transform(categories, lambda c: replace(c, '-', ' ')), ['Mid', 'Full Time'])",
                            chars="length(card)::INT", first_by="url", dedup_where=f"{WANTED} AND {ELIGIBLE}"),
    "norm_landing": board(f"'https://landing.jobs/at/acme-labs/' || {_KEY}", _LAND_LOC, company="'Acme Labs'", remote="is_remote",
                          scope="CASE WHEN ingest_seq % 3 <> 0 AND zone_country = 'DE' THEN 'germany' ELSE 'eu' END", salary=CODED, tags=_LAND_TAGS, first_by=_KEY),
    "norm_muse": board("url", f"coalesce(nullif(array_to_string({_MUSE_PLACES}[1:3], ', '), ''), 'Remote')",
                       scope=f"CASE WHEN {any_of(_MUSE_TEXT, v.MUSE_GERMANY)} THEN 'germany' WHEN {any_of(_MUSE_TEXT, v.MUSE_EU)} THEN 'eu' ELSE 'worldwide' END",
                       tags="list_concat(categories, tags)[1:10]", first_by=_KEY),
    "norm_hours80k": board("url", _H80_LOC, scope=f"""CASE WHEN {any_of(_H80_TEXT, v.H80K_WORLDWIDE)} THEN 'worldwide' WHEN {any_of(_H80_TEXT, v.H80K_GERMANY)} THEN 'germany'
                             WHEN {any_of(_H80_TEXT, v.H80K_EU)} THEN 'eu' ELSE 'worldwide' END""", salary="nullif(trim(salary), '')",
                           tags="list_concat(areas, tags)[1:10]", chars="length(card)::INT", ngo="TRUE", first_by="url", where=PREFILTER),
    "norm_rss_company_title": board("url", "coalesce(nullif(city, ''), 'Remote')", company="(CASE WHEN ingest_seq % 5 <> 0 THEN author ELSE 'Unknown' END)",
                                    tags=_WWR_TAG, first_by="url"),
    "norm_reliefweb": board("url", TAG_LOCATION, company="coalesce(nullif(author, ''), 'Unknown')", remote="FALSE", tags="areas",
                            chars="(CASE WHEN ingest_seq % 3 = 0 AND country <> '' THEN length(country) + 41 ELSE 4 END)::INT", ngo="TRUE", source="first_feed",
                            ctes=f""", feeds AS (SELECT *, (ingest_seq // 50) % 3 AS feed FROM fields),
                              first_feed AS (SELECT * FROM feeds WHERE feed = 0 OR {any_of('lower(title)', v.RELIEFWEB_TECH_TITLES)}
                                QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, ingest_seq) = 1)"""),
}


# -- HTML boards -------------------------------------------------------------
_SPLIT = "regexp_replace({0}, '\\s+', ' ', 'g')"


def html_board(url: str, location: str, tags: str, remote: str = "TRUE", salary: str = _NO, posted: str = _NO, company: str = "company", where: str = "TRUE",
               ctes: str = "") -> str:
    return f"""{_F}{ctes}, paged AS (SELECT *, max(fetched_at) OVER (PARTITION BY ingest_seq // 20) AS page_fetched FROM fields)
      SELECT {url} AS url, {sql_strip('title')} AS title, {sql_strip(company)} AS company, {location} AS location, {remote} AS is_remote,
        {tags} AS tags, {salary} AS salary, {posted} AS posted_at FROM paged WHERE {where}"""


_PAGE_TEXT = f"({sql_strip('title')} || ' ' || card || ' ' || {sql_strip('company')})"
_FULL_CTE = f""", fields0 AS (SELECT *, {_PAGE_TEXT} AS full_text FROM fields)"""


def on_full_text(sql: str) -> str:
    """The same rule over the text of the whole card instead of its middle part."""
    return sql.replace("lower(card)", "lower(full_text)").replace("regexp_extract(card,", "regexp_extract(full_text,")


_LOW = "lower(full_text)"
_GOOD_TAGS = f"""array_to_string(list_filter([CASE WHEN contains({_LOW}, 'hybrid') THEN 'Hybrid' END, CASE WHEN contains({_LOW}, 'remote') THEN 'Remote' END,
  CASE WHEN {any_of(_LOW, ['vollzeit', 'full-time'])} THEN 'Full-time' END, CASE WHEN {any_of(_LOW, ['teilzeit', 'part-time'])} THEN 'Part-time' END],
  lambda x: x IS NOT NULL), '|')"""
_SLUG_CTE = f""", w AS (SELECT ingest_seq, unnest(string_split(slug, '_')) AS word, unnest(range(len(string_split(slug, '_')))) AS idx FROM fields),
  stops AS (SELECT ingest_seq, max(CASE WHEN word NOT IN {_SLUG_PLACES} THEN idx END) AS stop FROM w GROUP BY 1),
  slugs AS (SELECT ingest_seq, string_agg(CASE WHEN idx > coalesce(stop, -1) THEN word END, ' ' ORDER BY idx) AS slug_place FROM w JOIN stops USING (ingest_seq) GROUP BY 1)"""
SQL["norm_goodjobs"] = html_board(
    f"'{v.GOODJOBS_URL}/jobs/p-' || ingest_seq", on_full_text(WORKTYPE), _GOOD_TAGS, remote=any_of(_LOW, ["remote", "hybrid"]),
    salary=on_full_text(f"CASE WHEN {_LO} <> '' THEN {_LO} || ' – ' || {_HI} || '/yr' END"),
    where=f"NOT {any_of(_LOW, v.GOODJOBS_SKIP)}", ctes=_FULL_CTE).replace("FROM fields)\n", "FROM fields0)\n")
SQL["norm_eurobrussels"] = html_board(
    f"'{v.EUROBRUSSELS_URL}/job_display/' || ingest_seq || '/' || slug", f"coalesce(nullif(slug_place, ''), '{v.EUROBRUSSELS_DEFAULT_LOCATION}')",
    f"array_to_string(({on_full_text(PHRASES)})[1:10], '|')", remote="FALSE",
    ctes=_FULL_CTE + _SLUG_CTE).replace("FROM fields)\n", "FROM fields0 JOIN slugs USING (ingest_seq))\n")
SQL["norm_html_cards"] = html_board(f"'{v.TECHJOBS_URL}/jobs/' || ingest_seq", "coalesce(nullif(country, ''), 'Remote')", "kind")
SQL["norm_linkedin"] = html_board(f"'{v.LINKEDIN_URL}/jobs/view/' || ingest_seq", "coalesce(country, '')", "''",
                                  posted=fmt(MOMENT.replace("fetched_at", "page_fetched")))

# Every board's rows are counted by its own SQL; its rank is its place in the registry.
_BOARD_SQL = {"nofluffjobs": "norm_nofluff", "landingjobs": "norm_landing", "themuse": "norm_muse", "weworkremotely": "norm_rss_company_title",
              "techjobsforgood": "norm_html_cards"}
SQL["union_sources"] = " UNION ALL ".join(
    f"SELECT '{name}' AS source, count(*) AS cnt, count(*) AS n_seq, {i}::BIGINT AS rank, {i}::BIGINT AS last_rank FROM ({SQL[_BOARD_SQL.get(name, 'norm_' + name)]})"
    for i, name in enumerate(v.BOARDS))
SQL["board_selection"] = f"SELECT 'devex' AS source, count(*) AS cnt FROM ({SQL['norm_devex']})"

# -- refused items -----------------------------------------------------------
_PLACED = FIELDS_SQL + """,
placed AS (
  SELECT *, ingest_seq // 50 AS page, row_number() OVER (PARTITION BY ingest_seq // 50 ORDER BY ingest_seq) - 1 AS place,
         ingest_seq // 20 AS card_page, row_number() OVER (PARTITION BY ingest_seq // 20 ORDER BY ingest_seq) - 1 AS card_place,
         ingest_seq % 5 = 0 AS no_title, ingest_seq % 7 = 0 AS no_url, ingest_seq - CASE WHEN ingest_seq % 11 = 0 THEN 1 ELSE 0 END AS item_id
  FROM fields)"""
# A page of cards is four elements and then six per card.
SQL["reject_log"] = f"""WITH {_PLACED},
themuse AS (
  SELECT *, ingest_seq % 13 = 0 AS broken FROM placed
  QUALIFY broken OR row_number() OVER (PARTITION BY broken, item_id ORDER BY ingest_seq) = 1)
SELECT 'themuse' AS source, page AS request_seq, place, CASE WHEN broken THEN 'malformed' ELSE 'missing' END AS reason,
       CASE WHEN broken THEN NULL WHEN no_title THEN 'title' ELSE 'url' END AS field FROM themuse WHERE broken OR no_title OR no_url
UNION ALL SELECT 'landingjobs', page, place, 'missing', 'title' FROM placed WHERE page % 9 <> 4 AND no_title
UNION ALL SELECT DISTINCT 'landingjobs', page, -1, 'malformed', NULL FROM placed WHERE page % 9 = 4
UNION ALL SELECT 'weworkremotely', page, place, 'missing', CASE WHEN no_title THEN 'title' ELSE 'url' END FROM placed WHERE no_title OR no_url
UNION ALL SELECT 'techjobsforgood', card_page, 4 + 6 * card_place, 'missing', 'title' FROM placed WHERE no_title"""
