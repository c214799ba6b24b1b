"""HTML tokens, links and addresses against Python's own parsers, and saved pages of portals."""

import html as stdlib
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from jobloom.operators import records, stages
from jobloom.sources import contacts, html, listings, markup

REFERENCES = [
    "&amp;", "&amp", "&auml;", "&eacute", "&notit;", "&not", "&#65;", "&#x41", "&#0;", "&#128;", "&#x80", "&#150", "&#xD800;", "&#99999999999;", "&#x110000;", "&nbsp;", "&unknown;", "&", "& ", "&;", "&#;", "&#x;",
    "&hellip;", "&acE;", "&lt", "&ltx", "&copy2", "&#13;", "&#1;", "&#129;", "&#xFDD0;", "&frac12x", "ä", "x", "=", "&Uuml;ber", "&ThickSpace;", "&fjlig;", "&quot;&#39;", "&Tab;", "&NewLine;",
]
PIECES = [
    '<a href="/x">', "<a href=/y?a=1&amp;b=2>", "<a class='k' href='z z'>", '<A HREF="/Big">', "</a>", "</A >", "text ", "t&auml;xt", "<b>", "</b>", '<!-- <a href="/c"> -->', '<script>var a="<a href=/s>";</script>', "<a>", "<a name=x>",
    '<a title="href=/no" href="/yes">', "<br/>", "<p>", " \n ", "< 5", '<a data-href="/n" href = "/sp">', '<abbr href="/q">', '<img alt="a > b" src=x>', '<a href="">', "é", "<style>a{}</style>", '<a\nhref="/nl">', "<nav><nav></nav>", "</nav>",
]


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.href, self.parts = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := next((v or "" for k, v in attrs if k == "href"), "")):
            self.href, self.parts = href, []

    def handle_data(self, data):
        if self.href is not None:
            self.parts.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.parts).split())))
            self.href = None


def test_character_references(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(REFERENCES) for _ in range(rng.randrange(1, 8))) for _ in range(300)] + REFERENCES
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markup.unescaped(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == [stdlib.unescape(r["t"]) for r in rows]


def test_anchors_are_those_of_a_parser(spark):
    rng = random.Random(1)
    pages = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25))) + "</p>" for _ in range(800)]
    found = F.transform(markup.anchors(F.col("t")), lambda a: F.struct(a["href"].alias("h"), markup.joined_text(a["inner"]).alias("x")))
    for r in spark.createDataFrame([(p,) for p in pages], "t string").select("t", found.alias("l")).collect():
        parser = Links()
        parser.feed(r["t"])
        assert [(x["h"], x["x"]) for x in r["l"]] == parser.found, r["t"]


def test_addresses_are_made_absolute(spark):
    bases = ["https://x.ch/a/b/c?q=1#f", "https://x.ch", "https://x.ch/", "https://x.ch/a/", "http://x.ch/a//b/../c/d?x=/y/"]
    refs = ["g", "./g", "g/", "/g", "//h.ch/g", "?y", "g?y", "#s", "g#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "http://z.ch/q", "mailto:a@b", "/a/b/../../c?d=../e"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in refs], "b string, h string").select("b", "h", html.absolute(F.col("b"), F.col("h")).alias("u")).collect()
    for r in rows:
        assert r["u"] == urljoin(r["b"], r["h"]), (r["b"], r["h"], r["u"], urljoin(r["b"], r["h"]))


def test_shown_text_and_nested_elements(spark):
    page = "<p> a&uuml; <b>b</b></p><style>x</style><!-- c --><script>d()</script>e <x"
    inner = F.expr("split('<span class=\"a n\">|x|<span>|y|</span>|z|</span>|w|<span class=n>|v|</span>', '[|]')")
    row = spark.range(1).select(markup.shown_text(F.lit(page)).alias("t"), markup.shown_text(F.lit(None).cast("string")).alias("n"), markup.element_text(inner, "span", "n").alias("e"), markup.element_text(inner, "div", "n").alias("none")).first()
    assert (row["t"], row["n"], row["e"], row["none"]) == ("aü b e < x", "", "xyz", None)


def test_contact_addresses(spark):
    pages = {
        "x@y.ch X@Y.ch z@y.ch,": "x@y.ch",
        '<a href="MAILTO: HR@firm.ch?subject=a">mail</a> info@firm.ch': "HR@firm.ch",
        "<a href=mailto:&#105;nfo@firm.ch>a</a>": "info@firm.ch",
        "first@a.ch career@a.ch jobs@jobs.ch recruiting@a.ch": "recruiting@a.ch",
        "only@jobs.ch": "", "no address": "", "": "", None: "",
    }
    rows = spark.createDataFrame([(p,) for p in pages], "p string").select("p", contacts.contact_email(F.col("p")).alias("e")).collect()
    assert {r["p"]: r["e"] for r in rows} == pages


def test_saved_pages_of_a_portal(spark, tmp_path):
    link = lambda n: f"<a href='/de/stellenangebote/detail/{n}'>Stelle {n}</a>"
    pages = [("jobs.ch", "it", "Bern", 1, link(1) + link(2)), ("jobs.ch", "it", "Bern", 2, link(2) + link(3)), ("jobs.ch", "it", "Bern", 3, "<p>nothing"), ("jobs.ch", "it", "Bern", 4, link(4)), ("jobs.ch", "a", "Bern", 2, link(9)), ("monster", "it", "Bern", 1, None), ("monster", "x", "", 1, "<a href='/job/77'>Monster 77</a>")]
    listings.save_pages(spark.createDataFrame(pages, "source string, query string, place string, page int, html string"), f"{tmp_path}/pages")
    read = listings.saved_pages(spark, f"{tmp_path}/pages")
    plan = read.filter("source = 'monster'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    got = sorted((r["source"], r["query"], r["link"]) for r in listings.portal_rows(read).collect())
    assert got == [("jobs.ch", "a", "https://www.jobs.ch/de/stellenangebote/detail/9"), *(("jobs.ch", "it", f"https://www.jobs.ch/de/stellenangebote/detail/{n}") for n in (1, 2, 3)), ("monster", "x", "https://www.monster.ch/job/77")]
    assert len(listings.portal_rows(read, limit=1).collect()) == 3
    assert listings.portal_rows(read.limit(0)).collect() == []


def test_reviews_are_read_item_by_item(spark):
    text = 'x [{"is_relevant": false, "score_llm": "12", "red_flags": ["a", 3]}, {"score_llm": {"no": 1}, "red_flags": "b"}, 7, {"score_llm": 150.7}] y'
    rows = stages.parsed_reviews(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "batch int, text string")).orderBy("place").collect()
    assert [(r["place"], r["is_relevant"], r["score_llm"], r["red_flags"]) for r in rows] == [(1, False, 12, ["a", "3"]), (2, True, 50, []), (3, True, 50, []), (4, True, 100, [])]


def test_details_are_found_behind_references(spark):
    postings = spark.createDataFrame([(1, "https://x.ch/1"), (2, "https://x.ch/2")], "ord long, link string")
    pages = spark.createDataFrame([("https://x.ch/1", "<p>F&uuml;hrerschein zwingend</p>"), ("https://x.ch/2", "<script>'führerschein zwingend'</script><p>Velo")], "url string, html string")
    got = {r["ord"]: r["outcome"] for r in stages.detail_filtered(postings, pages).collect()}
    assert got == {1: "phrase", 2: "clean"}


def test_mojibake_as_one_after_the_other(spark):
    rng = random.Random(4)
    plain = [chr(c) for c in (*range(0xC0, 0x180), 0x2013, 0x201C, 0x2026, 0x2192, 0x20AC, 0xA4)] + list("ab €ƒ")
    table = {}
    for code in (*range(0xC0, 0x180), *range(0x2000, 0x2070), 0x2190, 0x2192, 0x2194):
        try:
            table[chr(code).encode().decode("cp1252")] = chr(code)
        except UnicodeDecodeError:
            continue

    def fixed(text):
        for seen in sorted(table, key=len, reverse=True):
            text = text.replace(seen, table[seen])
        for sign, by in stages.PLAIN:
            text = text.replace(sign, by)
        return text

    texts = []
    for _ in range(400):
        text = "".join(rng.choice(plain) for _ in range(6))
        for _ in range(rng.randrange(0, 3)):
            text = "".join(c.encode().decode("cp1252", "ignore") if rng.random() < 0.7 else c for c in text)
        texts.append(text)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stages.repaired(F.col("t")).alias("r")).collect()
    wrong = [r for r in rows if r["r"] != fixed(r["t"]) and "â€" not in r["t"]]
    assert wrong == []


def test_an_application_leaves_other_records_alone(spark):
    state = spark.createDataFrame([("a", "new", "t", "c", "l", "s", "http://x", None, "old.docx", "then"), ("b", "applied", "t", "c", "l", "s", "", "early", "b.docx", "then")], "uid string, status string, title string, company string, location string, source string, link string, first_seen_at string, application_doc string, application_sent_at string")
    sent = spark.createDataFrame([(1, "a", "", "x.docx"), (2, "a", "T", "y.docx"), (1, "c", "N", "z.docx")], "ord int, uid string, title string, document string")
    got = {r["uid"]: (r["status"], r["title"], r["application_doc"], r["application_sent_at"], r["first_seen_at"]) for r in records.applied_upsert(state, sent, F.lit("now")).collect()}
    assert got == {"a": ("applied", "T", "y.docx", "now", "now"), "b": ("applied", "t", "b.docx", "then", "early"), "c": ("applied", "N", "z.docx", "now", "now")}


def test_an_empty_batch_leaves_records_as_they_are(spark):
    fields = ", ".join(f"{c} {'int' if c in ('commute_min', 'missing_runs') else 'string'}" for c in records.RECORD)
    row = ("u", "s", "c", "l", "t", "f", "p", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", None, "new", "1", "m", "d", 5, 2)
    state = spark.createDataFrame([row], fields)
    none = spark.createDataFrame([], "uid string, title string")
    assert [tuple(r) for r in records.merged(state, none, F.lit("2024-03-01T00:00:00Z")).collect()] == [row]
    other = spark.createDataFrame([("v", "T")], "uid string, title string")
    got = {r["uid"]: (r["status"], r["missing_runs"], r["title"]) for r in records.merged(state, other, F.lit("2024-03-01T00:00:00Z")).collect()}
    assert got == {"u": ("closed", 3, "t"), "v": ("new", 0, "T")}
