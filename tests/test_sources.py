"""Landed payloads of single boards."""

import json
from datetime import datetime

from boardsieve import schema
from boardsieve.sources import html_boards, json_boards, landing, rss_boards
import pytest


def _landed(spark, source, body, status=200, key=None):
    return spark.createDataFrame([(source, key, 1, 0, datetime(2026, 3, 23, 12), status, body)], schema.LANDED)


def test_remoteok_skips_metadata_and_falls_back(spark):
    body = json.dumps([{"legal": "x"}, {"position": "Dev", "company": "A", "slug": "dev-1", "epoch": "1767225600", "salary_min": "50000",
                                        "salary_max": 0, "tags": "a, b"}, {"no": 1}, {"position": "No url"}])
    rows = json_boards.remoteok(_landed(spark, "remoteok", body)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.url, row.salary, row.tags, row.location, row.remote_scope) == (
        "https://remoteok.com/remote-jobs/dev-1", "$50,000+", ["a", "b"], "Remote", "worldwide")
    assert row.posted_at == datetime(2026, 1, 1)


def test_native_id_dedup_runs_before_parsing(spark):
    body = json.dumps({"data": [{"id": 1, "name": "abc"}, {"id": 1, "name": "Good title"}, {"id": 2, "name": "Other title"}]})
    assert [r.title for r in json_boards.devex(_landed(spark, "devex", body)).collect()] == ["Other title"]


def test_gate_drops_bad_responses(spark):
    good = json.dumps({"data": [{"id": 1, "name": "Some title"}]})
    assert json_boards.devex(_landed(spark, "devex", good, status=429)).count() == 0
    assert json_boards.devex(_landed(spark, "devex", "not json")).count() == 0


def test_weworkremotely_titles(spark):
    body = """<rss><channel><item><title>Acme: Dev: Core</title><link>u1</link><pubDate>Mon, 02 Mar 2026 10:00:00 +0000</pubDate>
      <category>Programming</category></item><item><title>Solo</title><guid>u2</guid><region>Europe</region></item></channel></rss>"""
    rows = {r.url: r for r in rss_boards.weworkremotely(_landed(spark, "weworkremotely", body)).collect()}
    assert (rows["u1"].company, rows["u1"].title, rows["u1"].tags) == ("Acme", "Dev: Core", ["Programming"])
    assert rows["u1"].posted_at == datetime(2026, 3, 2, 10)
    assert (rows["u2"].company, rows["u2"].location) == ("Unknown", "Europe")


_PAD = "<!-- " + "x" * 500 + " -->"


def test_goodjobs_card(spark):
    body = _PAD + """<a href="/jobs/?page=2">next</a><a class="jobcard" href="/jobs/dev-1"><h3>Web Dev (m/w/d)</h3><span>Kassel | Hybrid</span>
      <span>Vollzeit Jahresgehalt 40.000€ – 47.000€</span><div class="mb-1"><p>GoodCompany hint</p><p>x</p></div>
      <div class="mb-1"><div><p>Hilfe gGmbH</p></div></div></a>"""
    row = html_boards.goodjobs(_landed(spark, "goodjobs", body)).collect()[0]
    assert (row.url, row.title, row.company, row.location) == ("https://goodjobs.eu/jobs/dev-1", "Web Dev (m/w/d)", "Hilfe gGmbH", "Kassel, Germany (Hybrid)")
    assert (row.salary, row.tags, row.is_remote, row.is_ngo_source) == ("40.000€ – 47.000€/yr", ["Hybrid", "Full-time"], True, True)


def test_eurobrussels_prefers_link_with_text(spark):
    body = _PAD + """<section><div class="ps-3"><a href="/job_display/7/Policy_Officer_Brussels_Belgium"><img alt="Logo text here"></a>
      <h3><a href="/job_display/7/Policy_Officer_Brussels_Belgium">Policy Officer</a></h3><div class="companyName">EDF</div></div>
      <p>NGO and Political organisation looking for remote colleagues</p></section>
      <div><a href="/job_display/8/Data_Lead_Paris_France"><img alt=""></a></div>"""
    rows = {r.title: r for r in html_boards.eurobrussels(_landed(spark, "eurobrussels", body)).collect()}
    first = rows["Policy Officer"]
    assert (first.company, first.location, first.is_ngo_source) == ("EDF", "Brussels Belgium", True)
    assert first.tags == ["NGO and Political", "Remote"]
    assert rows["Data Lead Paris France"].location == "Paris France"


def test_techjobs_fallback_to_links(spark):
    body = _PAD + "<li><a href='/jobs/12'>Dev at NGO</a><span class='company'>Help</span></li>"
    row = html_boards.techjobsforgood(_landed(spark, "techjobsforgood", body)).collect()[0]
    assert (row.title, row.company, row.url) == ("Dev at NGO", "Help", "https://www.techjobsforgood.com/jobs/12")


def test_board_selection():
    assert len(landing.selected_boards()) == 17 and landing.selected_boards("devex") == ("devex",)
    with pytest.raises(ValueError):
        landing.selected_boards("nope")
