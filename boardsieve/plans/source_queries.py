"""Registered queries of the boards, their parsers and the response gate."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions.fixed_values import BOARDS
from boardsieve.operators.dedup import keep_first
from boardsieve.plans import corpus, payloads
from boardsieve.operators import ledger
from boardsieve.plans.rule_queries import RULES
from boardsieve.sources import boards, html, json_boards, landing, parsers, rss_boards
from boardsieve.session import ensure_checkpoint_dir
from boardsieve.streaming import scan
from boardsieve import schema

_TIME = "yyyy-MM-dd HH:mm:ss"


def _parsed(name: str, column) -> object:
    def run(s, d):
        return payloads.fields(s, d).select("ingest_seq", column().alias(name))
    return run


def _address(s, d):
    rows = payloads.fields(s, d).select("ingest_seq", parsers.address(F.col("location")).alias("a"))
    return rows.select("ingest_seq", F.col("a.city").alias("city"), F.col("a.postal").alias("postal"), F.col("a.country").alias("country"))


def _salaries(s, d):
    return payloads.fields(s, d).select(
        "ingest_seq",
        parsers.period_salary(F.col("low"), F.col("high"), F.col("currency"), F.col("period")).alias("with_period"),
        parsers.plain_range(F.col("low").cast("string"), F.col("high").cast("string")).alias("plain"),
        parsers.coded_range(F.col("low"), F.col("high"), F.coalesce("currency", F.lit("EUR")), "/year").alias("coded"),
        parsers.single_or_range(F.col("low"), F.col("high"), F.coalesce("currency", F.lit("USD"))).alias("single"))


def _places():
    return F.array(F.struct(F.lit("City").alias("type"), F.col("city").alias("name")),
                   F.struct(F.lit("Region").alias("type"), F.col("state").alias("name")),
                   F.struct(F.lit("Country").alias("type"), F.col("country").alias("name")))


def _slug(s, d):
    url = F.concat(F.lit("https://www.eurobrussels.com/job_display/"), F.col("ingest_seq").cast("string"), F.lit("/"), "slug")
    return payloads.fields(s, d).select("ingest_seq", parsers.slug_location(url).alias("location"))


def _phrases(s, d):
    text = F.lower("card")
    return payloads.fields(s, d).select("ingest_seq", F.array_join(parsers.phrase_tags(text), "|").alias("tags"),
                                        parsers.phrase_ngo(text).alias("ngo"))


def _relative(s, d):
    moment = parsers.relative_time(F.col("age"), F.col("fetched_at"))
    return payloads.fields(s, d).select("ingest_seq", F.date_format(moment, _TIME).alias("moment"))


def _restrictions(s, d):
    return payloads.fields(s, d).select("ingest_seq", parsers.restrictions_eligible(F.col("restrictions")).alias("eligible"),
                                        parsers.restrictions_scope(F.col("restrictions")).alias("scope"))


def _tag_location(s, d):
    return payloads.fields(s, d).select("ingest_seq", parsers.tagged_country(
        _summary(), F.col("areas"), F.col("author")).alias("location"))


def _summary() -> Column:
    marked = F.concat(F.lit('<div class="tag country">Country: '), "country", F.lit(" </div>"))
    return F.when((F.col("ingest_seq") % 3 == 0) & (F.col("country") != ""), marked).otherwise("none")


def _gate(s, d):
    """Pages as responses: a board and a status by page number, the html as body."""
    pages = corpus.table(s, d, "pages")
    status = F.when(F.col("page_id") % 23 == 0, 429).when(F.col("page_id") % 19 == 0, 302).when(
        F.col("page_id") % 17 == 0, 500).otherwise(200)
    board = F.element_at(F.array(*[F.lit(x) for x in GATE_BOARDS]), (F.col("page_id") % len(GATE_BOARDS) + 1).cast("int"))
    return pages.select("page_id", board.alias("source"), landing.gate_label(board, status, F.col("html")).alias("label"))


GATE_BOARDS = ("techjobsforgood", "eurobrussels", "goodjobs", "linkedin", "remotive")


def _elements(s, d):
    """Elements of every page by tag, counted."""
    pages = corpus.table(s, d, "pages").select(F.col("page_id").alias("request_seq"), F.lit(None).cast("timestamp").alias("fetched_at"),
                                               F.col("html").alias("body"))
    counts = [F.count_if(F.col("tag") == tag).alias(f"n_{tag}") for tag in ELEMENT_TAGS]
    return html.elements(pages).groupBy(F.col("request_seq").alias("page_id")).agg(*counts)


ELEMENT_TAGS = ("html", "p", "h1", "li", "a", "br", "article", "script")


def _links(s, d):
    """Anchors of every page, by one pattern over the whole text."""
    found = F.regexp_extract_all("html", F.lit(_ANCHOR), 0)
    rows = corpus.table(s, d, "pages").select("page_id", F.posexplode(found).alias("pos", "anchor"))
    return rows.select("page_id", "pos", F.regexp_extract("anchor", _ANCHOR, 1).alias("href"),
                       F.regexp_extract("anchor", _ANCHOR, 2).alias("text"))


_ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def _title(s, d):
    return corpus.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def _link_dedup(s, d):
    """One link per target over all pages: a link with text beats one without, the last text wins."""
    links = _links(s, d).withColumn("long", F.length("text") >= 5)
    best = links.groupBy("href").agg(
        F.max_by("text", F.when(F.col("long"), F.struct("page_id", "pos"))).alias("last"),
        F.min_by("text", F.struct("page_id", "pos")).alias("first"))
    return best.select("href", F.coalesce("last", "first").alias("text"))


def _source_dedup(s, d):
    rows = corpus.raw_postings(s, d)
    return keep_first(rows, ["source", "url"], [F.col("ingest_seq").asc()]).select("ingest_seq", "source", "url")


# -- boards ------------------------------------------------------------------
def _item(**columns) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def _named(column: str) -> Column:
    return F.transform(column, lambda x: F.struct(x.alias("name")))


def _epoch() -> Column:
    return F.unix_seconds("posted_at")


def _key() -> Column:
    return (F.col("ingest_seq") - F.when(F.col("ingest_seq") % 11 == 0, 1).otherwise(0))


BOARD_ITEMS = {
    "remotive": ("jobs", lambda: _item(
        title="title", company_name="company", url="url", description="description", salary="salary", tags="tags",
        candidate_required_location=F.when(F.col("ingest_seq") % 17 != 0, F.col("location")), publication_date="stamp")),
    "arbeitnow": ("data", lambda: _item(
        title="title", company_name="company", location="location", url="url", description="description", salary="salary",
        created_at=F.when(F.col("ingest_seq") % 2 == 0, _epoch().cast("string")).otherwise(F.col("stamp")),
        tags="tags_csv", remote="is_remote")),
    "remoteok": (None, lambda: _item(
        slug=F.col("ingest_seq").cast("string"), position="title", company="company", location="location",
        url=F.when(F.col("ingest_seq") % 5 != 0, F.col("url")), description="description",
        date=F.when(F.col("ingest_seq") % 2 == 0, F.col("stamp")), epoch=_epoch(),
        salary_min=F.col("low").cast("long").cast("string"), salary_max=F.col("high").cast("long").cast("string"), tags="tags")),
    "idealist": ("hits", lambda: _item(
        objectID=_key().cast("string"), name="title", orgName="company", remoteZone="zone", remoteCountry="zone_country",
        orgType=F.when(F.col("ingest_seq") % 2 == 0, F.lit("Nonprofit")).otherwise("COMPANY"), city="city", state="state",
        country="country", description="description", published=_epoch(), keywords="tags", areasOfFocus="areas",
        url=F.create_map(F.lit("en"), F.concat(F.lit("/j/"), F.col("ingest_seq").cast("string"))),
        salaryCurrency="currency", salaryPeriod="period", salaryMinimum="low", salaryMaximum="high")),
    "devex": ("data", lambda: _item(
        id=_key(), name="title", published_at="stamp", places=_places(), news_topics=_named("tags"),
        employer_company=F.struct(F.col("company").alias("name")),
        slug_and_id=F.when(F.col("ingest_seq") % 3 == 0, F.concat(F.lit("s-"), F.col("ingest_seq").cast("string"))))),
    "stepstone": ("stellenangebote", lambda: _item(
        titel=F.when(F.col("ingest_seq") % 4 != 0, F.col("title")), beruf=F.lit("Entwickler"), refnr=_key().cast("string"),
        arbeitgeber="company", aktuelleVeroeffentlichungsdatum=F.substring("stamp", 1, 10),
        externeUrl=F.when(F.col("ingest_seq") % 2 == 0, F.col("url")),
        arbeitsort=F.struct(F.col("city").alias("ort"), F.col("state").alias("region"), F.col("country").alias("land")))),
    "nofluffjobs": ("postings", lambda: _item(
        id=_key().cast("string"), name="company", title="title", category="kind", technology=F.get("tags", F.lit(0)),
        seniority=F.array(F.lit("Senior")), regions="regions", fullyRemote="is_remote",
        posted=F.unix_millis("fetched_at") - F.col("ingest_seq") % 20 * 86400000,
        salary=F.struct(F.col("low").alias("from"), F.col("high").alias("to"), F.col("period").alias("type"), F.col("currency").alias("currency")),
        location=F.struct(F.array(F.struct(F.col("city").alias("city"), F.struct(F.col("country").alias("name")).alias("country"))).alias("places")))),
    "himalayas": ("jobs", lambda: _item(
        title="title", companyName="company", employmentType=F.lit("Full Time"), currency="currency", excerpt="card",
        applicationLink=F.when(F.col("ingest_seq") % 2 == 0, F.col("url")), guid="url", minSalary="low", maxSalary="high",
        seniority=F.array(F.lit("Mid")), locationRestrictions="restrictions", categories="categories", pubDate=_epoch())),
    "landingjobs": (None, lambda: _item(
        currency_code="currency", title="title", published_at="stamp", type=F.lit("Full-time"), remote="is_remote", tags="tags",
        url=F.concat(F.lit("https://landing.jobs/at/acme-labs/"), _key().cast("string")), gross_salary_low="low", gross_salary_high="high",
        locations=F.when(F.col("ingest_seq") % 3 != 0, F.array(F.struct(F.col("city").alias("city"), F.col("zone_country").alias("country_code")))))),
    "themuse": ("results", lambda: _item(
        id=_key(), name="title", publication_date="stamp", locations=_named("restrictions"), categories=_named("categories"),
        levels=_named("tags"), refs=F.struct(F.col("url").alias("landing_page")), company=F.struct(F.col("company").alias("name")))),
    "hours80k": ("hits", lambda: _item(
        title="title", description_short=F.concat(F.lit("<p>"), "card", F.lit("</p>")), url_external="url", company_name="company",
        salary="salary", tags_city=F.when(F.col("city") != "", F.array("city")), tags_country="restrictions",
        tags_area="areas", tags_skill="tags", posted_at=_epoch())),
}


def _escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _element(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _escape(value), F.lit(f"</{name}>")), F.lit(""))


def _rss_date() -> Column:
    return F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def landed_board(rows: DataFrame, board: str) -> DataFrame:
    """Landed responses of one board made of ``payloads.fields`` rows."""
    if board == "weworkremotely":
        title = F.when(F.col("ingest_seq") % 5 != 0, F.concat("author", F.lit(": "), "title")).otherwise(F.col("title"))
        item = F.concat(F.lit("<item>"), _element("title", title), _element("link", F.col("url")), _element("region", F.col("city")),
                        _element("category", F.get("tags", F.lit(0))), _element("pubDate", _rss_date()), F.lit("</item>"))
        return payloads.landed_xml(rows.withColumn("item", item), board, F.lit("all"))
    if board == "reliefweb":
        feed = F.element_at(F.array(F.lit("ICT"), F.lit("PPM"), F.lit("IM")), (F.floor(F.col("ingest_seq") / payloads.PAGE) % 3 + 1).cast("int"))
        tags = F.array_join(F.transform("areas", lambda a: _element("category", a)), "")
        item = F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("url")), _element("author", F.col("author")),
                        _element("description", _summary()), tags, _element("pubDate", _rss_date()), F.lit("</item>"))
        return payloads.landed_xml(rows.withColumn("item", item), board, feed)
    wrapper, item = BOARD_ITEMS[board]
    metadata = '{"legal":"terms"},' if board == "remoteok" else ""
    return payloads.landed(rows.withColumn("item", item()), board, wrapper, metadata)


ADAPTERS = {
    **{name: getattr(json_boards, name) for name in BOARD_ITEMS},
    "weworkremotely": rss_boards.weworkremotely,
    "reliefweb": rss_boards.reliefweb,
}


#: Boards whose items hold the whole description: their pages are made where the texts are.
DESCRIBED = ("remotive", "arbeitnow", "remoteok", "idealist")


def board_fields(s, d, board: str) -> DataFrame:
    return payloads.fields(s, d, payloads.PAGE if board in DESCRIBED else None)


def board_postings(s, d, board: str) -> DataFrame:
    return ADAPTERS[board](landed_board(board_fields(s, d, board), board))


def _norm(board: str):
    def run(s, d):
        return board_postings(s, d, board).select(
            "url", "title", "company", "location", "is_remote", "remote_scope", "salary",
            F.array_join("tags", "|").alias("tags"), F.date_format("posted_at", _TIME).alias("posted_at"),
            F.coalesce(F.length("description"), F.lit(0)).alias("n_chars"), "company_city",
            F.coalesce("is_ngo_source", F.lit(False)).alias("is_ngo_source"))
    return run


def landed_all(s, d, own: bool = False) -> dict[str, DataFrame]:
    """Responses of all boards by name: each board has every posting of the view, or its own."""
    kinds = {described: payloads.fields(s, d, payloads.PAGE if described else None) for described in (True, False)}
    mine = lambda name: kinds[name in DESCRIBED].filter(F.col("source") == name) if own else kinds[name in DESCRIBED]
    return {name: (landed_board if name in ADAPTERS else landed_html)(mine(name), name) for name in BOARDS}


def kept_landed(s, parts: dict[str, DataFrame]) -> DataFrame:
    """Responses written once as a landed table, a folder per board, so that each board reads its own."""
    path = f"{ensure_checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    for name, part in parts.items():
        part.drop("source").write.option("compression", "zstd").parquet(f"{path}/source={name}")
    return landing.read_landed(s, path)


def _union(s, d):
    """Rows, distinct sequences and board rank in the sequence, over the postings of all boards."""
    rank = F.shiftright("ingest_seq", 40)
    last = (corpus.table(s, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // CARD_PAGE  # the boards with the shortest pages have the most
    return boards.board_postings(landed_all(s, d), among=dict.fromkeys(BOARDS, last)).groupBy("source").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_distinct("ingest_seq").alias("n_seq"), F.min(rank).alias("rank"), F.max(rank).alias("last_rank"))


def _selection(s, d):
    """One board selected by name among the responses of several."""
    rows = payloads.fields(s, d)
    landed = landed_board(rows, "devex").unionByName(landed_board(rows, "remotive"))
    return boards.board_postings(landed, "devex").groupBy("source").agg(F.count(F.lit(1)).alias("cnt"))


def _scan_landed(s, d):
    """One scan from the responses of all boards to the ledger; what the ledger holds afterwards."""
    landed = kept_landed(s, landed_all(s, d, own=True))
    store = scan.Store(f"{ensure_checkpoint_dir(s)}/scan-{uuid.uuid4().hex}")
    profile = corpus.language_profile(s, d)
    scan.scan_landed(landed, 1, store, RULES, corpus.as_of(), corpus.PIPE_MAX_AGE, profile)
    stored = ledger.read_table(s, store.ledger, schema.POSTING)
    return stored.select("source", "ingest_seq", "id", "title", "company", "match_score")


def faulty(s, d) -> DataFrame:
    """Responses of a JSON board with and without a wrapper, an RSS and an HTML board in which items lack a title or a link,
    are no objects, or whole bodies are cut off."""
    rows = payloads.fields(s, d).withColumns({
        "title": F.when(F.col("ingest_seq") % 5 != 0, F.col("title")), "url": F.when(F.col("ingest_seq") % 7 != 0, F.col("url"))})
    muse = rows.withColumn("item", BOARD_ITEMS["themuse"][1]())
    muse = payloads.landed(muse, "themuse", "results", text=F.when(F.col("ingest_seq") % 13 == 0, F.lit("7")).otherwise(F.to_json("item")))
    cut = F.when(F.col("request_seq") % 9 == 4, F.substring("body", 1, 30)).otherwise(F.col("body"))
    html = rows.withColumn("title", F.coalesce("title", F.lit("")))
    parts = [muse, landed_board(rows, "landingjobs").withColumn("body", cut), landed_board(rows, "weworkremotely"), landed_html(html, "techjobsforgood")]
    return kept_landed(s, dict(zip(FAULTY, parts, strict=True)))


def _reject_log(s, d):
    """The reject log of one batch: what each board refused, where it stood (-1: the whole response) and why."""
    landed = faulty(s, d)
    items = reduce(DataFrame.unionByName, [boards.board_items(landed, name) for name in FAULTY])
    store = scan.Store(f"{ensure_checkpoint_dir(s)}/rejects-{uuid.uuid4().hex}")
    scan.log_rejects(landed, items, 1, store)
    return ledger.read_table(s, store.reject_log, schema.REJECT_LOG).select(
        "source", "request_seq", F.coalesce("pos", F.lit(-1)).alias("place"), "reason", "field")


FAULTY = ("themuse", "landingjobs", "weworkremotely", "techjobsforgood")

QUERY_NAMES = {"nofluffjobs": "norm_nofluff", "landingjobs": "norm_landing", "themuse": "norm_muse",
               "weworkremotely": "norm_rss_company_title"}

QUERIES = {
    "payload_gate": _gate,
    "html_links": _links,
    "html_elements": _elements,
    "scan_landed": _scan_landed,
    "reject_log": _reject_log,
    "html_title": _title,
    "link_dedup": _link_dedup,
    "source_dedup": _source_dedup,
    "union_sources": _union,
    "address_parse": _address,
    "scope_remoteok": _parsed("scope", lambda: parsers.remoteok_scope(F.col("location"))),
    "scope_zone": _parsed("scope", lambda: parsers.zone_scope(F.col("zone"), F.col("zone_country"))),
    "location_compose": _parsed("location", lambda: parsers.composed_location(
        F.col("city"), F.col("state"), F.col("country"), F.col("zone"), F.col("zone_country"))),
    "salary_format": _salaries,
    "location_from_tags": _tag_location,
    "slug_location": _slug,
    "phrase_tags": _phrases,
    "location_worktype": _parsed("location", lambda: parsers.worktype_location(F.col("card"))),
    "salary_range_de": _parsed("salary", lambda: parsers.german_salary_range(F.col("card"))),
    "ngo_legal_form": _parsed("ngo", lambda: parsers.legal_form_ngo(F.col("company"), F.col("card"))),
    "places_location": _parsed("location", lambda: parsers.typed_location(_places())),
    "relative_time": _relative,
    "scope_regions": _parsed("scope", lambda: parsers.regions_scope(F.col("regions"), F.col("location"))),
    "category_gate": _parsed("wanted", lambda: parsers.category_wanted(F.col("categories"), F.col("title"))),
    "scope_restrictions": _restrictions,
    "scope_country_code": _parsed("scope", lambda: parsers.country_codes_scope(F.col("regions"))),
    "strip_html": _parsed("text", lambda: parsers.strip_html(F.concat(F.lit("<p>"), "title", F.lit("</p> <b>x</b>")))),
    "remote_evidence": _parsed("evidence", lambda: parsers.remote_evidence(F.col("title"), F.col("is_remote"))),
    "board_selection": _selection,
    "board_prefilter": _parsed("wanted", lambda: parsers.board_title_wanted(F.col("title"))),
    **{QUERY_NAMES.get(name, f"norm_{name}"): _norm(name) for name in ADAPTERS},
}


# -- HTML boards: pages of twenty postings written as the boards write their cards ----------
CARD_PAGE = 20


def _html_card(board: str) -> Column:
    title, company, k = _escape(F.col("title")), _escape(F.col("company")), F.col("ingest_seq").cast("string")
    if board == "linkedin":
        parts = ['<div class="base-card"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/', k,
                 '?ref=x"></a><h3 class="base-search-card__title"> ', title, ' </h3><h4>', company,
                 '</h4><span class="job-search-card__location">', _escape(F.coalesce("country", F.lit(""))), '</span><time>', F.col("age"), '</time></div>']
    elif board == "techjobsforgood":
        parts = ['<div class="job-listing"><a href="/jobs/', k, '">', title, '</a><span class="company">', company,
                 '</span><span class="location">', _escape(F.coalesce("country", F.lit(""))), '</span><span class="tag">', F.col("kind"),
                 '</span><p class="description">', F.col("card"), '</p></div>']
    elif board == "goodjobs":
        parts = ['<div><a class="jobcard" href="/jobs/p-', k, '"><h3>', title, '</h3><p>', F.col("card"),
                 '</p><div class="grow"><div class="mb-1"><div><p>', company, '</p></div></div></div></a></div>']
    else:
        parts = ['<section><div class="ps-3"><a href="/job_display/', k, '/', F.col("slug"), '"><img alt="logo of it"></a><h3><a href="/job_display/', k,
                 '/', F.col("slug"), '">', title, '</a></h3><div class="companyName">', company, '</div></div><p>', F.col("card"), '</p></section>']
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def landed_html(rows: DataFrame, board: str) -> DataFrame:
    rows = rows.withColumn("item", _html_card(board))
    pages = rows.groupBy(F.floor(F.col("ingest_seq") / CARD_PAGE).alias("request_seq")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ingest_seq", "item"))), lambda x: x["item"]), "").alias("cards"),
        F.max("fetched_at").alias("fetched_at"))
    body = F.concat(F.lit("<!DOCTYPE html><html><head><title>jobs</title></head><body>"), "cards", F.lit("</body></html>"))
    return payloads._envelope(pages, board, F.concat(body, F.repeat(F.lit(" "), 500)), F.lit(None).cast("string"))


def _norm_html(board: str):
    def run(s, d):
        from boardsieve.sources import html_boards

        return getattr(html_boards, board)(landed_html(payloads.fields(s, d), board)).select(
            "url", "title", "company", "location", "is_remote", F.array_join("tags", "|").alias("tags"),
            "salary", F.date_format("posted_at", _TIME).alias("posted_at"))
    return run


QUERIES.update({
    "norm_html_cards": _norm_html("techjobsforgood"), "norm_eurobrussels": _norm_html("eurobrussels"),
    "norm_goodjobs": _norm_html("goodjobs"), "norm_linkedin": _norm_html("linkedin"),
})
