"""Row-case tables of the rules: one Spark job per table."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardsieve import RuleSet
from boardsieve.functions.text import minimal_terms, substring_pattern
from boardsieve.operators import cascade, enrich, filters
from boardsieve.sources import parsers as p

RULES = RuleSet()


def _values(df, column):
    return [r[0] for r in df.orderBy("ingest_seq").select(column).collect()]


def test_substring_pattern_equals_any():
    import re
    from boardsieve.functions.fixed_values import NON_EU_PATTERNS, TITLE_REJECT
    texts = ["go to market lead", "c++ developer", "java", "intern,", "st. louis", "remote (us)", "plain", "", "sre!", "x hr y"]
    for terms in (TITLE_REJECT, NON_EU_PATTERNS):
        pattern = re.compile(substring_pattern(terms))
        for text in texts + list(terms):
            assert bool(pattern.search(text)) == any(t in text for t in terms)
    assert minimal_terms(["marketing manager", "marketing"]) == ["marketing"]


def test_scope_classification(make):
    cases = [
        (dict(location="Berlin, Germany"), "germany"), (dict(location="Essential services"), "germany"),
        (dict(location="Madrid, Spain"), "eu"), (dict(location="Remote", tags=["Portugal"]), "eu"),
        (dict(location="EMEA"), "eu"), (dict(location="Remote", description="Remote within Europe"), "eu"),
        (dict(location="Remote", description="You must be located in Poland."), "eu"),
        (dict(location="Remote", description="based in the US" + " x" * 60 + " Poland"), "unknown"),
        (dict(location="Worldwide"), "worldwide"), (dict(location="Remote", tags=["anywhere"]), "worldwide"),
        (dict(location="Worldwide", source="arbeitnow"), "germany"),
        (dict(location="Worldwide", source="arbeitnow", description="global team"), "worldwide"),
        (dict(location="Anywhere", source="arbeitnow"), "worldwide"),
        (dict(location="United States"), "restricted"), (dict(location="London"), "restricted"),
        (dict(location="Remote - US"), "restricted"), (dict(location="New York"), "restricted"),
        (dict(location="Focus town"), "unknown"), (dict(location="Remote"), "unknown"),
    ]
    df = enrich.with_rule_texts(make(*[c for c, _ in cases]))
    assert _values(df, enrich.classify_scope(RULES)) == [e for _, e in cases]


def test_location_filter(make):
    cases = [
        (dict(remote_scope="eu"), True), (dict(remote_scope="restricted"), False), (dict(location="Remote"), False),
        (dict(location="Berlin", is_remote=False), False),
        (dict(location="Berlin", is_remote=False, description="x" * 800 + " Home Office möglich"), True),
        (dict(location="Paris, France", is_remote=False, description="hybrid"), True),
        (dict(location="Paris, France", is_remote=False), True),
        (dict(location="Paris, France", is_remote=False, description="uk only"), False),
        (dict(location="Worldwide", is_remote=False, description="us only"), True),
    ]
    df = cascade.with_scope(enrich.with_rule_texts(make(*[c for c, _ in cases])), RULES)
    assert _values(df, filters.eligible_location(RULES)) == [e for _, e in cases]


@pytest.mark.parametrize("rule,cases", [
    (filters.wanted_role, [
        ("Software Engineer", [], True), ("Django Developer", [], True), ("Go Developer", [], False),
        ("Data Engineer", [], False), ("Python Developer - Backend & Data Engineering", [], True), ("Intern", [], False),
        ("Internal Tools Engineer", [], True), ("intern software engineer", [], False), ("Office Assistant", ["python"], False),
        ("Growth Lead", ["react"], True), ("Growth Lead", [], False), ("Principal ML Engineer - Embodied AI", [], False),
        ("Head of HR ", [], False), ("Chrome Extension Engineer", [], True)]),
    (filters.compatible_stack, [
        ("Java Developer", [], False), ("Java and React Developer", [], True), ("Backend Developer", ["C#", ".NET"], False),
        ("Google Engineer", [], True), ("Golang Engineer", [], False), ("JavaScript Engineer", [], True),
        ("SOFTWARE DEVELOPER AL / C/AL / MS Navision BC 365", [], False), ("Go Engineer", ["python"], True)]),
    (filters.senior_enough, [
        ("Senior Dev", [], True), ("Junior Dev", [], False), ("Dev", [], True), ("Lead, international", [], True),
        ("International Developer", [], False)]),
])
def test_title_rules(make, rule, cases):
    df = enrich.with_rule_texts(make(*[dict(title=t, tags=g) for t, g, _ in cases]))
    assert _values(df, rule(RULES)) == [e for _, _, e in cases]


def test_ngo_score(make):
    cases = [
        ("Mozilla Foundation", None, 3), ("Acme Corp", "human rights and open data policy", 0),
        ("Hope Foundation", "human rights and open data", 3), ("Hope Foundation", "a saas marketplace", 0),
        ("Tor Project", None, 1), ("Effective Ltd", None, 1), ("Charity SaaS platform", None, 0),
        ("Oxfam", "x" * 3000 + " human rights and advocacy", 2),
    ]
    df = enrich.with_ngo_score(make(*[dict(company=c, description=d) for c, d, _ in cases]), RULES)
    assert _values(df, "ngo_score") == [e for *_, e in cases]


def test_match_score(make):
    cases = [
        (dict(title="React Developer"), 20), (dict(title="Next.js nextjs"), 18), (dict(title="Ruby on Rails"), 20),
        (dict(title="Rails"), 10), (dict(title="Java"), -5), (dict(title="JavaScript"), 5), (dict(title="MongoDB"), 19),
        (dict(title="C# dev"), 0), (dict(title="Dev", is_ngo=True), 10), (dict(title="ngo", is_ngo=True), 15),
        (dict(title="Dev", description="y" * 500 + "react"), 0), (dict(title="revue"), 0), (dict(title="vue"), 15),
    ]
    df = enrich.with_match_score(enrich.with_rule_texts(make(*[c for c, _ in cases])), RULES)
    assert _values(df, "match_raw") == [e for _, e in cases]


def test_normalised_score(spark):
    cases = [(0, 0), (3, 12), (5, 20), (15, 50), (25, 70), (40, 90), (50, 95), (-10, 0), (100, 100), (14, 47), (49, 94), (80, 100)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "ingest_seq INT, raw INT")
    assert _values(df, enrich.normalise_score(F.col("raw"))) == [e for _, e in cases]
    assert df.limit(1).select(enrich.score_bar(F.lit(45))).first()[0] == "█" * 4 + "░" * 6
    assert df.limit(1).select(enrich.score_bar(F.lit(55))).first()[0] == "█" * 6 + "░" * 4


def test_salary_and_recency(make):
    as_of = F.to_timestamp(F.lit("2026-03-23 12:00:00"))
    df = make(dict(salary="€4,500/month"), dict(salary="50.000€"), dict(salary=". negotiable"), dict(salary=None), dict(salary="60000"))
    assert _values(df, filters.enough_salary(replace(RULES, min_salary=50000))) == [True, False, True, True, True]
    df = make(dict(posted_at=datetime(2026, 3, 9, 12)), dict(posted_at=datetime(2026, 3, 9, 11, 59)), dict(),
              dict(posted_at=datetime(2026, 3, 1), source="reliefweb"), dict(posted_at=datetime(2026, 4, 1)))
    assert _values(df, filters.recent_enough(RULES, as_of)) == [True, False, True, True, True]


def test_parsers(spark):
    one = spark.range(1)
    def value(column):
        return one.select(column).first()[0]
    for text, expected in {
        "Berlin": ("Berlin", None, "Germany"), "13086 Berlin": ("Berlin", "13086", "Germany"),
        "Hamburg, Germany": ("Hamburg", None, "Germany"), "13086 Berlin, Germany": ("Berlin", "13086", "Germany"),
        "Remote": (None, None, None), "Paris, France": ("Paris", None, "France"), "Vienna, Austria": ("Vienna", None, "Austria"),
        "Graz, Berlin, Spain": ("Berlin", None, "Spain"), "": (None, None, None)}.items():
        assert tuple(value(p.address(F.lit(text)))) == expected, text
    for text, expected in {"": "worldwide", "Remote": "worldwide", "Museum": "eu", "US": "restricted", "Berlin": "germany",
                           "USA or Spain": "worldwide", "Focus": "worldwide", "London": "restricted"}.items():
        assert value(p.remoteok_scope(F.lit(text))) == expected, text
    base = F.to_timestamp(F.lit("2026-03-23 12:00:00"))
    assert value(p.relative_time(F.lit("Posted 2 months ago"), base)) == datetime(2026, 1, 22, 12)
    assert value(p.relative_time(F.lit("soon"), base)) is None
    assert value(p.slug_location(F.lit("https://x/job_display/1/Officer_EDF_Brussels_Belgium"))) == "Brussels Belgium"
    assert value(p.worktype_location(F.lit("Jobs in Köln"))) == "Köln, Germany"
    assert value(p.german_salary_range(F.lit("Jahresgehalt 40.000€ – 47.000€"))) == "40.000€ – 47.000€/yr"
    assert value(p.company_from_url(F.lit("https://landing.jobs/at/acme-labs/dev"))) == "Acme Labs"
