"""From landed responses to the ledger: gates, sequences, rejects, languages; ledger folders."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardsieve import RuleSet, schema
from boardsieve.operators import cascade, dedup, dictionary, ledger
from boardsieve.operators.language import train_profile
from boardsieve.sources import boards, html_boards, landing
from boardsieve.streaming import scan, windows

PLAIN = RuleSet(english_only=False)
NOW = datetime(2026, 3, 23, 12)


def as_of():
    return F.to_timestamp(F.lit("2026-03-23 12:00:00"))


def _landed(spark, *responses):
    rows = [(source, None, 1, seq, NOW, status, body) for source, seq, status, body in responses]
    return spark.createDataFrame(rows, schema.LANDED)


def _remotive(*titles):
    return json.dumps({"jobs": [{"title": t, "company_name": f"C{t}", "candidate_required_location": "Worldwide", "url": f"https://e.org/{t}",
                                 "publication_date": "2026-03-22T00:00:00"} for t in titles]})


def test_gate_rules_are_per_board(spark):
    head = "<html><head><a href='/login'>Login</a></head>" + " " * 600
    card = '<a class="jobcard" href="/jobs/dev-1"><h3>Web Dev</h3><span>Kassel | Hybrid</span><span>Vollzeit</span></a>'
    assert html_boards.goodjobs(_landed(spark, ("goodjobs", 0, 200, head + card))).count() == 1
    short = '<div class="base-card"><a class="base-card__full-link" href="https://l.com/jobs/view/1"></a><h3>Dev</h3></div>'
    assert len(short) < 500 and html_boards.linkedin(_landed(spark, ("linkedin", 0, 200, short))).count() == 1
    assert html_boards.linkedin(_landed(spark, ("linkedin", 0, 200, "<title>Login</title>" + short))).count() == 0
    blocked = "You have been blocked" + " " * 600
    labels = {(r.source, r.request_seq): r.reason for r in landing.rejected_responses(_landed(
        spark, ("techjobsforgood", 1, 200, blocked), ("goodjobs", 2, 200, blocked), ("eurobrussels", 3, 200, "x"), ("linkedin", 4, 403, ""),
        ("devex", 5, 429, ""), ("devex", 6, 500, None), ("devex", 7, None, "[]"), ("linkedin", 8, 200, None))).collect()}
    assert labels == {("techjobsforgood", 1): "blocked", ("eurobrussels", 3): "too_short", ("linkedin", 4): "login", ("devex", 5): "rate_limited",
                      ("devex", 6): "http_error", ("devex", 7): "http_error"}


def test_sequence_is_unique_and_in_feed_order(spark):
    landed = _landed(spark, ("remotive", 0, 200, _remotive("a", "b")), ("remotive", 1, 200, _remotive("c")),
                     ("devex", 0, 200, json.dumps({"data": [{"id": 1, "name": "Some title"}]})))
    rows = boards.board_postings(landed).orderBy("ingest_seq").collect()
    assert [r.title for r in rows] == ["a", "b", "c", "Some title"] and len({r.ingest_seq for r in rows}) == 4
    later = boards.board_postings(landed).select(landing.batch_seq(F.col("ingest_seq"), 7).alias("s")).collect()
    assert min(r.s for r in later) >= 7 << 45 > max(r.ingest_seq for r in rows)
    with pytest.raises(Exception, match="does not fit"):
        boards.board_postings(_landed(spark, ("remotive", 1 << 21, 200, _remotive("a"))), "remotive").collect()
    with pytest.raises(ValueError):
        landing.batch_seq(F.lit(1), 1 << 18)


def test_cascade_refuses_missing_keys_and_profiles(spark, make):
    rows = make(dict(location="Berlin"), dict(location="Berlin", title="Backend Developer"))
    with pytest.raises(ValueError, match="profile"):
        cascade.run_cascade(rows, RuleSet(), as_of())
    with pytest.raises(ValueError, match="profile"):
        cascade.with_reject_reason(rows, RuleSet(), as_of())
    with pytest.raises(Exception, match="no ingest_seq"):
        cascade.run_cascade(rows.withColumn("ingest_seq", F.lit(None).cast("long")), PLAIN, as_of()).collect()
    with pytest.raises(ValueError, match="stands for 2 rows"):
        cascade.check_unique(rows.withColumn("ingest_seq", F.lit(1).cast("long")))


def test_language_rule_acts_on_adapter_output(spark):
    corpus = spark.createDataFrame(
        [("en", "the engineers are working with the team and the data for this company")] * 3
        + [("de", "die entwickler arbeiten mit dem team und den daten für diese firma nicht")] * 3, "lang STRING, text STRING")
    landed = _landed(spark, ("remotive", 0, 200, _remotive("Software Engineer for the data team and this company", "Software Engineer und die Daten für diese Firma nicht")))
    reasons = cascade.with_reject_reason(boards.board_postings(landed), RuleSet(), as_of(), profile=train_profile(corpus)).orderBy("ingest_seq").collect()
    assert [r.reject_reason for r in reasons] == [None, cascade.LANGUAGE_REASON]


def test_scan_of_landed_responses(spark, tmp_path):
    landed = _landed(spark, ("remotive", 0, 200, _remotive("Software Engineer", "Sales Manager", "Backend Developer")), ("remotive", 1, 429, ""),
                     ("himalayas", 0, 200, "<html>"), ("remotive", 2, 200, _remotive("Software Engineer")))
    landed.coalesce(1).write.parquet(f"{tmp_path}/landed")
    store = scan.Store(f"{tmp_path}/store")
    stream = spark.readStream.schema(landed.schema).parquet(f"{tmp_path}/landed")
    scan.landed_stream(stream, store, PLAIN, f"{tmp_path}/state", as_of()).awaitTermination()
    kept = ledger.read_table(spark, store.ledger, schema.POSTING).collect()
    assert sorted(r.title for r in kept) == ["Backend Developer", "Software Engineer"] and all(str(r.day) == "2026-03-23" for r in kept)
    scan.scan_landed(landed, 1, store, PLAIN, as_of())  # the same responses again
    assert ledger.read_table(spark, store.ledger, schema.POSTING).count() == 2
    log = ledger.read_table(spark, store.scan_log, schema.SCAN_LOG).orderBy("scan_id").collect()
    assert [(r.raw, r.accepted, r.new) for r in log] == [(3, 2, 2), (3, 2, 0)]
    rejects = spark.read.parquet(store.reject_log).where("batch = 1").collect()
    assert sorted((r.source, r.request_seq, r.reason) for r in rejects) == [("himalayas", 0, "malformed"), ("remotive", 1, "rate_limited")]


def test_windows_prune_days(spark, make, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append_batch(make(*[dict(url=f"u{i}", fetched_at=NOW - timedelta(days=i)) for i in range(4)]), path, 1, "fetched_at")
    stored = ledger.read_table(spark, path, schema.POSTING)
    marks = spark.createDataFrame([], schema.NOTIFIED_LOG)
    digest = ledger.digest_recent(stored, marks, as_of())
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and digest.count() == 1


def test_bounded_joins_move_hits_only(spark, make, tmp_path):
    make(*[dict(url=f"u{i}", title=f"T{i}") for i in range(50)]).write.parquet(f"{tmp_path}/keys")
    stored = spark.read.parquet(f"{tmp_path}/keys").select("id", "content_hash")
    batch = make(dict(url="u3", title="New"), dict(url="u99", title="T4"), dict(url="u98", title="Other"))
    rows = dedup.filter_unseen(batch, stored, 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1  # one pass over the ledger for both keys
    assert [r.ingest_seq for r in rows.collect()] == [2]
    assert sorted(r.ingest_seq for r in dedup.seen(batch.select("ingest_seq", "id"), stored, 100).collect()) == [0]


def test_snapshots_are_written_and_pruned(make, spark, tmp_path):
    path, rows = str(tmp_path / "snapshots"), make(dict(url="a"))
    for day in range(1, 10):
        left = ledger.write_snapshot(rows, path, f"2026-03-{day:02}", keep=7)
    assert left == [f"2026-03-{day:02}" for day in range(3, 10)] == [x.split("=")[1] for x in ledger.folders(spark, path)]
    assert ledger.read_snapshot(spark, path).count() == 1


def test_old_files_without_scores(make, spark, tmp_path):
    rows = make(dict(url="a", match_score=7), dict(url="b", match_score=9))
    rows.filter("match_score = 7").drop("match_score").write.parquet(f"{tmp_path}/t/batch=1")
    rows.filter("match_score = 9").write.parquet(f"{tmp_path}/t/batch=2")
    read = ledger.with_match_score_column(spark.read.schema(schema.POSTING).parquet(f"{tmp_path}/t"))
    assert sorted(r.match_score for r in read.collect()) == [0, 9]


def test_dictionary_terms_with_blanks_and_symbols(spark):
    terms = spark.createDataFrame([("go developer", 5, "go", 0, True), ("c#", 3, "c", 1, True), ("java", 2, "java", 2, False), ("ai", 1, "ai", 3, True),
                                   ("c++", 4, "cpp", 4, True)], "keyword STRING, weight INT, grp STRING, ord INT, whole_word BOOLEAN")
    texts = spark.createDataFrame([(1, "go developer wanted"), (2, "javascript and c#, c++."), (3, "cargo developers said xc#"), (4, ""), (5, "ai"), (6, "java java")],
                                  "k INT, text STRING")
    scores = {r.k: r.score for r in dictionary.weighted_score(texts, "k", "text", terms).collect()}
    assert scores == {1: 5, 2: 9, 5: 1, 6: 2}
    assert sorted(r.k for r in dictionary.without_terms(texts, "k", "text", terms.filter("NOT whole_word")).collect()) == [1, 3, 4, 5]


def test_weekly_windows_equal_sliding_windows(spark):
    start = datetime(2026, 3, 1)
    rows = spark.createDataFrame([("a" if i % 3 else "b", start + timedelta(hours=7 * i)) for i in range(60)], "k STRING, at TIMESTAMP")
    fast = windows.weekly_windows(rows, "at", "k")
    slow = windows.window_counts(rows, "at", "k", "7 days", "1 day")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))


def test_json_items_of_a_wrong_kind_are_refused_one_by_one(spark):
    bodies = ['{"jobs":[1,{"title":"a","url":"u1"},null,{"title":"b","url":"u2"},"t",[{"title":"z"}]]}', '{"jobs":{"title":"a"}}', "<html>", '{"jobs":[]}',
              '{"x":1}', None, '{"jobs":"s"}', '[{"jobs":[]}]', '{"jobs":[{"title":"a"},{"title":"b"']
    items = boards.board_items(_landed(spark, *[("remotive", i, 200, b) for i, b in enumerate(bodies)]), "remotive")
    whole = {(r.request_seq, r.pos) for r in landing.refused(items).collect() if r.reason == "malformed" and r.field is None}
    assert whole == {(0, 0), (0, 2), (0, 4), (0, 5), *((i, None) for i in (1, 2, 4, 5, 6, 7, 8))}
    assert sorted((r.title, r.ingest_seq & 0xFFFFF) for r in landing.kept(items).collect()) == [("a", 1), ("b", 3)]
    lists = ['[{"title":"t","url":"https://l/at/acme/1","gross_salary_low":"x"},5,{"title":"q"}]', '{"error":1}', "[]", '[{"url":"https://l/at/acme/2"}]']
    items = boards.board_items(_landed(spark, *[("landingjobs", i, 200, b) for i, b in enumerate(lists)]), "landingjobs").collect()
    assert sorted((r.request_seq, -1 if r.pos is None else r.pos, str(r.reason), str(r.field)) for r in items) == [
        (0, 0, "None", "None"), (0, 1, "malformed", "None"), (0, 2, "missing", "url"), (1, -1, "malformed", "None"), (3, 0, "missing", "title")]


def test_refused_items_stay_beside_rules_and_dedup(spark):
    body = json.dumps({"data": [{"id": 1, "name": None}, {"id": 1, "name": "Second copy"}, {"id": 2, "name": "abc"}, {"id": 3, "name": "Long enough"}, 4]})
    items = boards.board_items(_landed(spark, ("devex", 0, 200, body)), "devex").collect()
    assert sorted((r.pos, r.title, r.reason, r.field) for r in items) == [(0, None, "missing", "title"), (3, "Long enough", None, None), (4, None, "malformed", None)]
    head = "<html><body>" + " " * 600
    cards = ('<div class="job-listing"><a href="/jobs/1">Web Dev</a></div><div class="job-listing"><a href="/jobs/2"> </a></div>'
             '<div class="job-listing"><a>No link</a></div>')
    items = boards.board_items(_landed(spark, ("techjobsforgood", 0, 200, head + cards)), "techjobsforgood").collect()
    assert sorted((r.pos, r.title, r.field) for r in items) == [(2, "Web Dev", None), (4, None, "title"), (6, None, "title")]
    good = '<a class="jobcard" href="/jobs/dev-1"><h3>Web Dev</h3><span>Kassel | Hybrid</span></a><a class="jobcard" href="/jobs/dev-2"><p>Ten letters at least</p></a>'
    items = boards.board_items(_landed(spark, ("goodjobs", 0, 200, head + good)), "goodjobs").collect()
    assert sorted((r.title or "", r.field) for r in items) == [("", "title"), ("Web Dev", None)]


def test_feeds_are_read_as_xml(spark):
    feeds = ["<rss><channel><title>x</title><item><title>A: B</title><link>u1</link><description><![CDATA[has </item> inside & <b>x</b>]]></description>"
             '<category domain="d">c1</category><category>c2</category></item><item><title>C &amp; D &#8211; é</title>'
             '<dc:creator xmlns:dc="urn:x">me</dc:creator><guid isPermaLink="false">g2</guid></item></channel></rss>',
             "<rss><channel><title>t</title></channel></rss>", "<rss><channel/></rss>",
             "<rss><channel><item><title>whole</title><link>u</link></item><item><title>cut", "garbage", None, "<html><body>hi</body></html>",
             '<rdf:RDF xmlns:rdf="urn:r" xmlns="urn:p"><channel><title>c</title></channel><item><title>rdf</title><link>r1</link></item></rdf:RDF>',
             "<rss><channel><item><title>No link</title></item><item/></channel></rss>"]
    items = boards.board_items(_landed(spark, *[("weworkremotely", i, 200, b) for i, b in enumerate(feeds)]), "weworkremotely").collect()
    found = {(r.request_seq, r.pos): (r.company, r.title, r.url, r.description, r.field or r.reason) for r in items}
    assert found == {
        (0, 0): ("A", "B", "u1", "has </item> inside & <b>x</b>", None), (0, 1): ("Unknown", "C & D – é", "g2", None, None),
        (3, 0): ("Unknown", "whole", "u", None, None), (7, 0): ("Unknown", "rdf", "r1", None, None), (8, 0): ("Unknown", "No link", None, None, "url"),
        (8, 1): ("Unknown", None, None, None, "title"), **{(i, None): ("Unknown", None, None, None, "malformed") for i in (4, 5, 6)}}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_items_stay_where_they_are(spark):
    rows = [(1, 0, "a", None, "one"), (1, 1, "a", None, "two"), (0, 4, "a", None, "first"), (2, 0, "b", None, "b"), (2, 1, None, None, "n"), (3, 0, None, None, "n"),
            (4, None, None, "malformed", None), (5, None, None, "malformed", None), (6, 2, "a", "missing", "refused")]
    form = "request_seq long, pos long, url string, reason string, description string"
    items = spark.createDataFrame(rows, form)
    expected = sorted(map(tuple, landing.dedup_items(items, "url").collect()), key=str)
    found = landing.dedup_wide_items(items, "url")
    assert sorted(map(tuple, found.collect()), key=str) == expected and len(expected) == 6
    assert "hashpartitioning" not in _plan(found)
    assert sorted(map(tuple, landing.dedup_wide_items(items, "url", 0).collect()), key=str) == expected
    # A response that came twice: its items can't be told apart.
    again = spark.createDataFrame(rows + rows, form)
    assert sorted(map(tuple, landing.dedup_wide_items(again, "url").collect()), key=str) == sorted(map(tuple, landing.dedup_items(again, "url").collect()), key=str)


def test_pages_are_made_without_moving_their_texts(spark, tmp_path):
    from boardsieve.plans import payloads, source_queries

    days = "date'2001-01-01' as o_orderdate"
    spark.sql(f"select id as o_orderkey, id % 7 as o_custkey, {days} from range(130) union all select 5, 1, {days} union all select null, 2, {days}").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select id as c_custkey, 'Firm ' || id as c_name, id % 2 as c_nationkey from range(7)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id as n_nationkey, 'LAND' as n_name from range(2)").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select id as doc_id, 'text ' || id as text from range(61) where id <> 9 union all select 8, 'other' union all select null, 'none' union all select 900, 'far'").write.parquet(f"{tmp_path}/documents.parquet")
    made = [source_queries.landed_board(payloads.fields(spark, str(tmp_path), page), "remotive") for page in (None, payloads.PAGE)]
    plain, by_page = [sorted(map(tuple, df.collect()), key=str) for df in made]
    assert by_page == plain and len(plain) == 4
    # Pages of an unlaid frame are grouped by an exchange of whole items.
    moved = ["groupingexpression" in _plan(df).split("Exchange", 1)[1].splitlines()[0] for df in made]
    assert moved == [True, False]


def test_cards_are_not_grouped_again(spark):
    from boardsieve.sources import html_boards

    landed = _landed(spark, ("goodjobs", 0, 200, "<a href='/jobs/x'><h3>Engineer</h3><div class='mb-1'><p>Acme</p></div></a>" + " " * 600))
    for board in (html_boards.goodjobs, html_boards.linkedin, html_boards.techjobsforgood, html_boards.eurobrussels):
        plan = _plan(board.items(landed))
        assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") <= 1
    row = html_boards.goodjobs(landed).first()
    assert (row.title, row.company) == ("Engineer", "Acme")
