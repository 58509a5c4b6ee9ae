"""The cascade against a sequential model, plus its plan."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardsieve import RuleSet
from boardsieve.operators import cascade

RULES = RuleSet(english_only=False)
NOW = datetime(2026, 3, 23, 12)


def as_of():
    return F.to_timestamp(F.lit("2026-03-23 12:00:00"))


def _batch(seed: int, size: int) -> list[dict]:
    rng = random.Random(seed)
    return [dict(
        title=rng.choice(["Software Engineer", "Sales Manager", "Backend Developer"]), company=rng.choice(["A", "B", "a ", "C"]),
        location="Berlin", posted_at=rng.choice([None, NOW - timedelta(days=rng.choice([1, 2, 3, 20]))]),
        fetched_at=NOW - timedelta(hours=rng.randint(0, 5)), url=f"https://e.org/{rng.randint(0, size)}") for _ in range(size)]


def _sequential(rows: list[dict]) -> dict[int, str]:
    """Row by row as a scan without Spark would do it: index -> reason category, '' when accepted."""
    order = sorted(range(len(rows)), key=lambda i: (-(rows[i]["posted_at"] or rows[i]["fetched_at"]).timestamp(), i))
    hashes, per_company, out = set(), {}, {}
    for i in order:
        row = rows[i]
        company = row["company"].strip().lower()
        key = (row["title"].lower(), company)
        if key in hashes:
            out[i] = "dedup (content hash)"
        elif row["title"] == "Sales Manager":
            out[i] = "role"
        elif row["posted_at"] and NOW - row["posted_at"] > timedelta(days=14):
            out[i] = "recency"
        elif per_company.get(company, 0) >= 2:
            out[i] = "company cap"
        else:
            per_company[company] = per_company.get(company, 0) + 1
            hashes.add(key)
            out[i] = ""
    return out


def test_cascade_equals_sequential_model(make):
    for seed in range(3):
        rows = _batch(seed, 60)
        expected = _sequential(rows)
        df = make(*rows)
        reasoned = cascade.with_reject_reason(df, RULES, as_of()).select(
            "ingest_seq", F.coalesce(cascade.reason_category(F.col("reject_reason")), F.lit("")).alias("c"))
        assert {r.ingest_seq: r.c for r in reasoned.collect()} == expected
        accepted = {r.ingest_seq for r in cascade.run_cascade(df, RULES, as_of()).collect()}
        assert accepted == {i for i, reason in expected.items() if reason == ""}


def test_hot_company_is_cut_before_the_shuffle(make):
    narrow = make(dict(location="Berlin")).select(*cascade.SURVIVOR_COLUMNS)
    plan = cascade._keep_survivors(narrow, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_language_filter_keeps_short_and_english(spark, make):
    from boardsieve.operators.language import only_english, train_profile

    corpus = spark.createDataFrame(
        [("en", "the engineers are working with the team and the data for this company")] * 3
        + [("de", "die entwickler arbeiten mit dem team und den daten für diese firma nicht")] * 3, "lang STRING, text STRING")
    df = make(dict(title="Working with the data and the team for this"), dict(title="Entwickler arbeiten mit den daten und nicht"),
              dict(title="Firma"), dict(title="12345678901234567890 1234"))
    kept = only_english(df, "ingest_seq", cascade.language_text(), train_profile(corpus))
    assert sorted(r.ingest_seq for r in kept.collect()) == [0, 2, 3]
