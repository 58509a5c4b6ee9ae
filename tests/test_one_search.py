"""Texts are searched and scored whole, without a row per gram or a pass per term."""

import pytest
from pyspark.sql import functions as F

from boardsieve.functions.text import found_terms, has_found
from boardsieve.operators import dictionary, enrich, language
from boardsieve.settings import RuleSet

RULES = RuleSet()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("stretch", [1, 5, 1 << 18])
def test_language_is_scored_without_a_row_per_gram(spark, monkeypatch, stretch):
    labelled = spark.createDataFrame([("en", "the team and the data working with them"), ("de", "das team und die daten für ihre übung")], "lang STRING, text STRING")
    texts = spark.createDataFrame([
        (0, "the data"), (1, "die DATEN"), (1, "and the team with them"), (2, None), (3, ""), (4, "12 - 3"), (None, "für ihre"), (5, "a"),
        (6, "\U00010400 und \U0001f600"), (7, "zzz qqq"), (8, "the " * 50), (9, "ÜBUNG")], "k INT, text STRING")
    profile = language.train_profile(labelled)
    monkeypatch.setattr(language, "_STRETCH", stretch)
    held = language.detect_language(texts, "k", "text", profile)
    assert "Generate" not in _plan(held)
    monkeypatch.setattr(language, "MAX_HELD_GAINS", 0)
    joined = language.detect_language(texts, "k", "text", profile)
    assert "Generate" in _plan(joined)
    assert sorted(map(str, held.collect())) == sorted(map(str, joined.collect()))


def test_found_terms_equal_contains(spark):
    terms = ["c++", "über", "go", "django", "", "go"]
    rows = spark.createDataFrame([(t,) for t in ("django über alles", "C++ c++", "", None, "\U0001f600go")], "t STRING")
    found = rows.select("t", found_terms(F.col("t"), terms).alias("f")).select("t", "f", has_found(F.col("f"), [0, 2]).alias("some")).collect()
    for row in found:
        assert row.f == (None if row.t is None else [i for i, term in enumerate(terms) if term in row.t])
        assert row.some == (None if row.t is None else "c++" in row.t or "go" in row.t)


def test_organisation_terms_are_found_across_the_end_of_the_company(spark, make):
    strong = max(RULES.not_ngo_strong, key=lambda t: " " in t)
    first, rest = strong.split(" ", 1)
    cases = [(f"Helping Foundation {first}", f"{rest} for all", 0), ("Helping Foundation", f"{rest} for all", 2), ("Helping Foundation", None, 2), ("Acme", strong, 0)]
    rows = enrich.with_ngo_score(make(*[dict(company=c, description=d) for c, d, _ in cases]), RULES)
    assert _plan(rows).count("Contains(_org_text") == 0
    scores = {r.ingest_seq: r.ngo_score for r in rows.collect()}
    assert scores == {i: score for i, (_, _, score) in enumerate(cases)}


def test_scores_and_dictionary_search_a_text_once(spark, make):
    rows = enrich.with_match_score(enrich.with_rule_texts(make(dict(title="Vue.js and AI, maintained in C++ "), dict(title="Ragged email"))), RULES)
    assert "Contains(_match_text" not in _plan(rows)
    raw = {r.ingest_seq: r.match_raw for r in rows.collect()}
    assert raw[0] == RULES.stack_weights["vue"] and raw[1] == 0
    texts = spark.createDataFrame([(0, "go and c# c"), (0, "ago"), (1, None)], "k INT, text STRING")
    terms = spark.createDataFrame([("go", True), ("c#", False), ("go", False), (None, True)], "keyword STRING, whole BOOLEAN")
    hits = dictionary.occurrences(texts, "k", "text", terms, whole_word="whole")
    assert "Contains" not in _plan(hits)
    assert sorted((r.k, r.keyword, r.whole) for r in hits.collect()) == [(0, "c#", False), (0, "go", False), (0, "go", False), (0, "go", True)]
