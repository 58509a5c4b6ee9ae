"""The shuffle paths taken when a dictionary or a profile is too large to broadcast."""

import pytest

from boardsieve.operators import dictionary, language

TEXTS = [(0, "django and mongodb"), (1, "ngo work"), (2, "c# or go"), (3, ""), (4, "postgresql, the postgres way"), (5, "plain")]
TERMS = ["ngo", "postgres", "go", "c#", "mongodb", "the postgres way"]


@pytest.mark.parametrize(("bound", "few"), [(0, 0), (1000, 0), (1000, 200)])
def test_occurrences_equal_brute_force(spark, monkeypatch, bound, few):
    monkeypatch.setattr(dictionary, "MAX_BROADCAST_TERMS", bound)
    monkeypatch.setattr(dictionary, "FEW_TERMS", few)
    texts = spark.createDataFrame(TEXTS, "k INT, text STRING")
    terms = spark.createDataFrame([(t,) for t in TERMS], "keyword STRING")
    found = {(r.k, r.keyword) for r in dictionary.occurrences(texts, "k", "text", terms).collect()}
    assert found == {(k, t) for k, text in TEXTS for t in TERMS if t in text}
    kept = dictionary.without_terms(texts, "k", "text", terms)
    assert sorted(r.k for r in kept.collect()) == [3, 5]


def test_language_is_the_same_without_broadcast(spark, monkeypatch):
    rows = [(0, "en", "the team and the data"), (1, "de", "das team und die daten"), (2, "en", "working with them"), (3, "de", "arbeiten mit ihnen")]
    texts = spark.createDataFrame(rows, "k INT, lang STRING, text STRING")
    profile = language.train_profile(texts)
    small = sorted(map(tuple, language.detect_language(texts, "k", "text", profile).collect()))
    monkeypatch.setattr(language, "MAX_BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, language.detect_language(texts, "k", "text", profile).collect())) == small
    assert small == [(k, lang) for k, lang, _ in rows]
