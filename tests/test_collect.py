"""Titles, reasons, HTML sources, digest texts and the stream, by example."""

import json

from pyspark.sql import functions as F

from jobloom import catalog
from jobloom.functions import titles
from jobloom.operators import digest, reasons
from jobloom.operators.lifecycle import merge
from jobloom.sources import contacts, html
from jobloom.streaming import lifecycle as stream


def test_titles(spark):
    rows = [
        (1, '01. [exact] "Engineer"\nheute\nPensum 100%\nArbeitsort\nZug\nMuster AG'),
        (2, "Engineer\nvor 3 Tagen\nKanton Zürich\nFirma"),
        (3, "Engineer\nEngineer"),
        (4, None),
    ]
    found = {r["ord"]: (r["t_title"], r["t_company"], r["t_place"]) for r in titles.title_parts(spark.createDataFrame(rows, "ord long, raw string"), F.col("raw")).collect()}
    assert found == {1: ("Engineer", "Muster AG", "Zug"), 2: ("Engineer", "Firma", "Kanton Zürich"), 3: ("Engineer", "", ""), 4: ("", "", "")}


def test_reasons(spark):
    rows = [
        (1, "Dev", "Dev", "A", "Bern", "https://x/1", "s"),
        (2, "dev!", "Dev", "a", "Bern", "https://x/1?q=2", "s"),
        (3, "Ops", "Ops", "B", "Genf", "https://x/2", "s"),
        (4, "Dev", "Dev", "C", "", "https://x/3", "s"),
        (5, "QA", "QA", "D", "Bern", "https://x/4", "s"),
        (6, "QA", "QA", "D", "Bern", "https://x/4#b", "s"),
        (7, "Dev", "Dev", "E", "Bern", "https://x/stellenangebote/it/", "portal"),
        (8, "Dev remote", "", "F", "Genf", "https://x/9", "s"),
    ]
    posts = spark.createDataFrame(rows, "ord long, title string, raw_title string, company string, location string, link string, source string")
    minutes = spark.createDataFrame([("Bern", 30), ("Genf", 120)], "place string, minutes int")
    bad = spark.createDataFrame([("https://x/4",)], "link string")
    rules = reasons.Rules(remote=("remote",), search_places=("bern",), allowed_places=("basel",), most_minutes=60, listing_sources=("portal",))
    found = {r["ord"]: r["reason"] for r in reasons.collector_reasons(posts, rules, minutes, bad).collect()}
    assert found == {1: None, 2: "duplicate", 3: "transit_blocked", 4: "location_unknown", 5: "detail_blocklist", 6: None, 7: "category_link", 8: None}
    assert reasons.collector_reasons(posts.limit(0), rules, minutes, bad).count() == 0


def test_json_ld(spark):
    job = {"@type": ["JobPosting"], "title": "Dev", "hiringOrganization": {"name": "A", "sameAs": "https://a/job/1"}, "jobLocation": [{"address": {"addressLocality": "Zug", "addressCountry": "CH"}}], "datePosted": "2024-01-02"}
    other = {"@type": "JobPosting", "title": "Ops", "hiringOrganization": "B", "url": ["https://b/detail/2"]}
    script = '<script type="application/ld+json">{}</script>'
    page = script.format("{broken") + script.format(json.dumps({"@graph": [{"@graph": [job]}, other]})) + '<a href="/job/77">Another job</a>'
    links = '<a HREF="/job/5?x=1">First <b>job</b></a><a href="/job/5">First again</a><a href="/about">About us</a><a href="job/6/">Second &amp; job</a>'
    pages = spark.createDataFrame([(1, "https://h.ch/list/a", page), (2, "https://h.ch/list/a", links), (3, "https://h.ch", None)], "page_id long, url string, html string")
    found = [tuple(r) for r in html.json_ld_rows(pages).drop("url").orderBy("page_id", "at").collect()]
    assert found == [(1, 0, "Ops", "B", "", "https://b/detail/2", ""), (1, 1, "Dev", "A", "Zug, CH", "https://a/job/1", "2024-01-02")]
    rows = {(r["page_id"], r["title"], r["link"]) for r in html.rows_or_links(pages).collect()}
    assert rows == {(1, "Ops", "https://b/detail/2"), (1, "Dev", "https://a/job/1"), (2, "First job", "https://h.ch/job/5?x=1"), (2, "Second & job", "https://h.ch/list/job/6/")}


def test_empty_digest(spark):
    schema = "section string, place long, match string, title string, company string, location string, link string, uid string, date string, source string, score int"
    none = spark.createDataFrame([], schema)
    assert digest.plain_list(none).first()["body"] == "Keine Treffer."
    assert digest.summary(none).first()["body"] == "Job-Alert: 0 neu, 0 offen"
    assert "Keine neuen Jobs." in digest.html_body(none).first()["body"]
    many = spark.createDataFrame([("new" if i % 2 else "reminder", i, "ok", "t", "c", "l", None, "u", "", "", i) for i in range(10)], schema)
    body = digest.html_body(many, most=6).first()["body"]
    assert body.count("<li>") == 6 and "und 4 weitere" in body and body.count("Kein Link") == 6


def test_stream_equals_batches(spark, tmp_path):
    days = [[("a", "2024-01-01"), ("b", "2024-01-01")], [("b", "2024-01-03")], [("b", "2024-01-05"), ("c", "2024-01-05")], [("c", "2024-01-06")]]
    state = spark.createDataFrame([], stream.STATE)
    for i, day in enumerate(days):
        batch = spark.createDataFrame(day, "uid string, ts string").select("uid", F.col("ts").cast("timestamp").alias("ts"))
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = spark.createDataFrame(merge(state, batch.select("uid"), F.lit(day[0][1]).cast("timestamp")).collect(), stream.STATE)
        seen = spark.readStream.schema("uid string, ts timestamp").parquet(f"{tmp_path}/in")
        query = stream.follow(seen, f"{tmp_path}/state")
        assert query.awaitTermination(60) and query.exception() is None
        assert sorted(spark.read.parquet(f"{tmp_path}/state/run={i}").collect()) == sorted(state.collect())


def test_contact_email(spark, tmp_path):
    """Every document has a row; several addresses are ordered by link, portal and hint."""
    cases = [
        ("write to info@firma.ch or jobs@firma.ch, else hr.team@firma.ch.", "hr.team@firma.ch"),
        ("info@firma.ch, office@firma.ch", "info@firma.ch"),
        ('a@x.ch <A HREF="mailto:Zoe@X.ch?subject=b@c.de">mail</A>', "Zoe@X.ch"),
        ("<a href=mailto:zoe&#64;x.ch>mail</a> a@x.ch", "zoe@x.ch"),
        ('<a class="k" href="mailto:open@x.ch">never closed, a@x.ch', "open@x.ch"),
        ("career@jobs.ch bewerbung@indeed.com me@sub.jobs.ch me@firma.ch", "me@sub.jobs.ch"),
        ("career@x.ch RECRUITing@x.ch", "RECRUITing@x.ch"),
        ("career@jobs.ch", ""),
        ("no address", ""),
        ("a@b", ""),
        ("<![foo[ me@firma.ch", "me@firma.ch"),
        ("", ""),
        (None, ""),
    ]
    spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["email"] for r in catalog.QUERIES["contact_email_by_hint"](spark, str(tmp_path)).collect()}
    assert got == {i: email for i, (_, email) in enumerate(cases)}
    assert spark.range(1).select(contacts.emails(F.lit("x@y.ch X@Y.ch z@y.ch,")).alias("e")).first()["e"] == ["x@y.ch", "z@y.ch"]


def test_place_and_page_queries_read_everything(spark, tmp_path):
    """Places beyond a thousand, links beyond the third of a page and JSON-LD rows."""
    spark.createDataFrame([(f"place{i:05d}",) for i in range(1500)] + [("NATION_7x",), ("7x",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["place"] for r in catalog.QUERIES["place_lookup_longest"](spark, str(tmp_path)).collect()}
    assert got == {1: "NATION_7x", 2: None}
    links = "".join(f'<a href="/job/{i}">posting {i}</a>' for i in range(30))
    script = json.dumps({"@type": "JobPosting", "title": "Engineer", "url": "https://x/job/1"})
    pages = [(1, "https://x/y", links), (2, "https://x/z", f'<script type="application/ld+json">{script}</script>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.QUERIES["html_site_link_rows"](spark, str(tmp_path)).collect()
    assert sorted(r["at"] for r in rows) == list(range(25))
    assert [(r["page_id"], r["title"], r["link"]) for r in catalog.QUERIES["html_json_ld_rows"](spark, str(tmp_path)).collect()] == [(2, "Engineer", "https://x/job/1")]
