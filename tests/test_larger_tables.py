"""What larger tables met: long runs and batches of texts, wide rows that moved, sequences of many responses."""

import json
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardsieve import RuleSet, schema
from boardsieve.operators import cascade, dedup, language, ledger
from boardsieve.sources import boards, html, landing
from boardsieve.streaming import scan

PLAIN = RuleSet(english_only=False)
NOW = datetime(2026, 3, 23, 12)


def test_long_runs_of_other_characters_are_one_blank(spark):
    labelled = spark.createDataFrame([("en", "the team and the data"), ("de", "das team und die daten")], "lang STRING, text STRING")
    runs = ("7" * 50_000, "- " * 30_000, "\U0001f600" * 20_000, " \n" * 25_000)
    texts = spark.createDataFrame([(i, f"the{run}data") for i, run in enumerate(runs)] + [(9, "7" * 50_000)], "k INT, text STRING")
    assert {r.x for r in texts.filter("k < 9").select(language._letters(F.col("text")).alias("x")).collect()} == {" the data "}
    found = language.detect_language(texts, "k", "text", language.train_profile(labelled.unionByName(texts.select(F.lit("en").alias("lang"), "text"))))
    assert {r.k: r.detected_lang for r in found.collect()} == dict.fromkeys(range(4), "en")


def test_texts_without_a_label_are_no_error(spark, monkeypatch):
    labelled = spark.createDataFrame([("en", "the team and the data"), (None, "das team"), ("de", "das team und die daten")], "lang STRING, text STRING")
    profile = language.train_profile(labelled)
    texts = spark.createDataFrame([(0, "the data"), (1, "die daten"), (2, "xyz qqq")], "k INT, text STRING")
    held = {r.k: r.detected_lang for r in language.detect_language(texts, "k", "text", profile).collect()}
    assert held[0] == "en" and held[1] == "de" and 2 in held
    monkeypatch.setattr(language, "MAX_HELD_GAINS", 0)
    assert {r.k: r.detected_lang for r in language.detect_language(texts, "k", "text", profile).collect()} == held


def test_long_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    texts = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n LONG").collect()]
    assert sum(found) == 64 and max(found) <= 8


def _landed(spark, *responses):
    return spark.createDataFrame([(source, None, 1, seq, NOW, 200, json.dumps({"jobs": [dict(
        title=title, company_name=f"Acme {title}", candidate_required_location="Remote", url=f"https://x.org/{title}", publication_date="2026-03-22T00:00:00")
        for title in titles]})) for source, seq, titles in responses], schema.LANDED)


def test_a_batch_of_many_responses_is_sequenced(spark, tmp_path):
    """Beyond 2^20 responses of a board its places get fewer bits; order and other boards' sequences stay."""
    low, high = 5, (1 << 21) + 3
    landed = _landed(spark, ("remotive", high, ["Backend Developer B", "Backend Developer C"]), ("remotive", low, ["Backend Developer A"]))
    store = scan.Store(str(tmp_path / "store"))
    scan.scan_landed(landed, 3, store, PLAIN, F.lit(NOW))
    rows = ledger.read_table(spark, store.ledger, schema.POSTING).orderBy("ingest_seq").collect()
    assert [r.title[-1] for r in rows] == ["A", "B", "C"]
    rank = boards.v.BOARDS.index("remotive")
    assert [r.ingest_seq for r in rows] == [(3 << 45) + (rank << 40) + (request << 18) + pos for request, pos in ((low, 0), (high, 0), (high, 1))]
    few = scan.Store(str(tmp_path / "few"))
    scan.scan_landed(landed.filter(F.col("request_seq") == low), 3, few, PLAIN, F.lit(NOW))
    assert [r.ingest_seq for r in ledger.read_table(spark, few.ledger, schema.POSTING).collect()] == [(3 << 45) + (rank << 40) + (low << 20)]


def test_a_sequence_is_never_cut(spark):
    assert [landing.place_bits(n) for n in (None, 0, (1 << 20) - 1, 1 << 20, (1 << 40) - 1, 1 << 50)] == [20, 20, 20, 19, 0, 0]
    items = spark.createDataFrame([("devex", 1 << 22, 1 << 17, None)], "source STRING, request_seq LONG, pos LONG, reason STRING")
    with pytest.raises(Exception, match="pos does not fit 17 bits"):
        landing.resequenced(items).collect()
    assert landing.resequenced(items.withColumn("reason", F.lit("missing"))).first().ingest_seq is None
    landed = _landed(spark, ("remotive", 1 << 21, ["A", "B"]))
    wide = boards.board_postings({"remotive": landed}, "remotive", {"remotive": 1 << 21})
    assert sorted(r.ingest_seq & 0xFFFFFFFFFF for r in wide.collect()) == [1 << 39, (1 << 39) + 1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_key_filter_passes_its_keys_and_few_others(spark):
    for keys in (spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")), spark.range(3000).select((F.col("id") * 7).alias("key")),
                 spark.createDataFrame([], "key STRING")):
        passes = dedup.key_filter(keys, "key", keys.count())
        assert keys.filter(~passes(F.col("key"))).count() == 0
    others = spark.range(10_000).select((F.col("id") * 7 + 1).alias("key"))
    assert others.filter(dedup.key_filter(spark.range(3000).select((F.col("id") * 7).alias("key")), "key", 3000)(F.col("key"))).count() < 400


def _postings(make):
    return make(*[dict(title=("Backend Developer", "Sales Manager", "Frontend Developer")[i % 3], company=f"Acme {i % 13}", location=("Berlin", "Remote")[i % 2],
                       is_remote=True, source="remotive", fetched_at=NOW, description="the team and the data " * (i % 5), url=f"https://x.org/{i % 50}") for i in range(60)])


def test_many_survivors_are_fetched_without_moving_the_others(spark, make, monkeypatch):
    rows, sorted_rows = _postings(make), lambda df: sorted(map(str, df.collect()))
    few = cascade.run_cascade(rows, PLAIN, F.lit(NOW))
    expected = sorted_rows(few)
    monkeypatch.setattr(cascade, "MAX_BROADCAST_SURVIVORS", 0)
    many = cascade.run_cascade(rows, PLAIN, F.lit(NOW))
    assert expected and sorted_rows(many) == expected
    below_the_join = _plan(many)[_plan(many).index("LeftSemi"):]
    assert "getbit" in below_the_join or "bit_get" in below_the_join


def test_reasons_are_the_same_beside_many_accepted_rows(spark, make, monkeypatch):
    rows = _postings(make).withColumn("content_hash", F.when(F.col("ingest_seq") % 11 != 5, F.col("content_hash")))
    expected = sorted(map(str, cascade.with_reject_reason(rows, PLAIN, F.lit(NOW)).collect()))
    monkeypatch.setattr(cascade, "MANY_WINNERS", 0)
    assert sorted(map(str, cascade.with_reject_reason(rows, PLAIN, F.lit(NOW)).collect())) == expected
    narrow = cascade.with_reject_reason(rows, PLAIN, F.lit(NOW), columns=("ingest_seq", "source"))
    assert narrow.columns == ["ingest_seq", "source", "reject_reason"] and narrow.count() == len(expected) == 60


def test_the_funnel_reads_labelled_rows_once(spark):
    k = F.col("id")
    labelled = spark.range(100).select((k % 3).cast("string").alias("source"), F.when(k != 90, k).alias("ingest_seq"), F.concat(F.lit("i"), k).alias("id"),
                                       F.concat(F.lit("h"), k % 40).alias("content_hash"), F.when(k % 2 == 0, "no").alias("reject_reason"))
    labelled = labelled.unionByName(labelled.filter("ingest_seq = 7"))
    stored = spark.createDataFrame([("i1", "x"), ("y", "h3"), (None, "h5"), ("i9", None), ("i2", "h2")], "id STRING, content_hash STRING")
    found = cascade.funnel(labelled, stored)
    assert "Range (" not in _plan(found)
    # 3, 43, 83 and 5, 45, 85 are known by hash, 1 and 9 by id; 7 stands for two rows that meet each other.
    assert sorted(map(tuple, found.collect())) == [("0", 34, 17, 14), ("1", 36, 20, 17), ("2", 33, 16, 14)]


def test_rows_are_judged_where_they_lie(spark, monkeypatch):
    labelled = spark.createDataFrame([("en", "the team and the data working with them"), ("de", "das team und die daten arbeiten mit uns")], "lang STRING, text STRING")
    profile = language.train_profile(labelled)
    rows = spark.createDataFrame([(1, "das team und die daten arbeiten"), (1, "das team und die daten arbeiten"), (2, "the data working with them"), (3, None),
                                  (4, "die daten"), (5, "1234567890123456789012345"), (None, "das team und die daten arbeiten")], "k INT, text STRING")
    held = language.only_english(rows, "k", F.col("text"), profile)
    assert "Join" not in _plan(held) and held.columns == rows.columns
    assert sorted(r.k or 0 for r in held.collect()) == [0, 2, 3, 4, 5]
    monkeypatch.setattr(language, "MAX_HELD_GAINS", 0)
    assert sorted(map(str, language.only_english(rows, "k", F.col("text"), profile).collect())) == sorted(map(str, held.collect()))


_PIECES = ("<p>", "</p>", "<P Class='a b'>", '<a href="/x?a=1&amp;b=2">', '<a HREF="/x" href="/y" class="c  d">', "</a>", "<br>", "<br/>", "<img alt=x>", "text &amp; more &euro",
           "a < b", "a > b", "<title>", "</title>", "<script>", "</script>", "<!-- <p> -->", "<!DOCTYPE html>", "<!doctype html [x]>", "</ p>", "</p x>", "<p", "&#x41;", "\n ",
           "<li data-x=\"1\" disabled>", "<textarea>", "<template>", "</template>", '<div id="a>b">', "\x0b", "<time datetime=\"2020\">", "</H1>", "<h1\n>", "<x:y>", "<?xml?>", "\0")


def test_plain_pages_are_read_as_the_parser_reads_them():
    import random

    draw, plain = random.Random(4), 0
    for n in range(6000):
        page = "".join(draw.choices(_PIECES, k=draw.randint(0, 9)))
        parser = html._Elements()
        parser.feed(page)
        parser.close()
        assert html._rows_of(page) == parser.rows, page
        plain += html._Elements().read_plain(page)
    card = '<!DOCTYPE html><html><head><title>jobs</title></head><body><div class="job card"><a href="/jobs/1">A &amp; B</a></div></body></html>  '
    assert plain > 300 and html._Elements().read_plain(card) and len(html._rows_of(card)) == 6
