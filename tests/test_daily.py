"""Portals, the stored state and the daily run's stages, on small tables by hand."""

from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators import lifecycle, ranking, records, stages
from jobloom.sources import html, portals


def test_detail_links_by_host(spark):
    links = {
        "https://www.jobscout24.ch/de/job/0a1b2c3d-1111-2222-3333-444455556666/": True,
        "https://www.jobscout24.ch/de/jobs/?term=x": False,
        "https://www.jobwinner.ch/de/job/12345/": True,
        "https://www.jobwinner.ch/jobs/?q=x": False,
        "https://www.itjobs.ch/jobs/4711-system-engineer/": True,
        "https://www.itjobs.ch/jobs/security-audit": False,
        "https://ictjobs.ch/firma/system-engineer/": True,
        "https://ictjobs.ch/stellen/it-jobs/": False,
        "https://swissdevjobs.ch/jobs/Firma-Engineer": True,
        "https://swissdevjobs.ch/jobs/all": False,
        "https://other.ch/jobs/": False,
        "": False,
    }
    rows = spark.createDataFrame([*links.items(), (None, False)], "link string, wanted boolean")
    assert rows.filter(portals.detail_link(F.col("link")) != F.col("wanted")).collect() == []
    plain = rows.select("link", portals.plain_detail_link(F.col("link")).alias("p")).collect()
    assert {r["link"] for r in plain if r["p"]} == {list(links)[0], list(links)[2]}


def test_folding_by_compatibility(spark):
    given = ["ﬁrma ① Ǻ ĳ", "Zürich é", "½ ²", "plain", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i")
    assert [r[0] for r in rows.select(text.norm_state(F.col("x"))).collect()] == ["firma 1 a ij", "zurich e", "1 2 2", "plain", ""]


def test_marks(spark):
    state = spark.createDataFrame([(str(i), s, "old") for i, s in enumerate(["new", "notified", "new", "ignored", "new", "applied", "new"])], "uid string, status string, applied_at string")
    marks = spark.createDataFrame([("0", " Done ", None), ("1", "skip", "x"), ("2", "", "JA"), ("3", "applied", ""), ("4", "later", "nein"), ("5", "apply", ""), (None, "done", "x"), ("9", "done", "x")], "uid string, action string, done string")
    got = {r["uid"]: (r["status"], r["applied_at"]) for r in lifecycle.marked(state, marks, F.lit("now")).collect()}
    assert got == {"0": ("applied", "now"), "1": ("ignored", None), "2": ("applied", "now"), "3": ("applied", "now"), "4": ("new", "old"), "5": ("applied", "old"), "6": ("new", "old")}


def test_hard_rules_look_in_both_titles(spark):
    row = spark.createDataFrame([("Techniker", "Techniker Callcenter", "Firma", "auch junior", "Greater London")], "t string, r string, c string, d string, l string")
    reason = lambda **rules: row.select(ranking.hard_reason(F.col("t"), F.col("c"), F.col("d"), location=F.col("l"), raw_title=F.col("r"), **rules)).first()[0]
    assert reason(keywords=("callcenter",)) == "blacklist_keyword:callcenter"
    assert reason(includes=("junior",)) == "include_keyword:no_match"
    assert reason(languages=("junior",)) == "language_requirement:junior"
    assert reason() == "location:foreign:london" and reason(foreign=()) is None


def test_uids_resolve_by_prefix_and_url(spark):
    state = spark.createDataFrame([("abc1", "https://x.ch/a?x=1", ""), ("abc2", "https://x.ch/b/", ""), ("def3", "", "https://x.ch/c"), ("def4", "https://x.ch/d", ""), ("def5", "https://x.ch/d/", "")], "uid string, link string, canonical_url string")
    asked = spark.createDataFrame([(1, "abc1", ""), (2, "abc", ""), (3, "zzz", ""), (4, "", "https://X.ch/b"), (5, "", " https://x.ch/c/ "), (6, "", "https://x.ch/d"), (7, "", "")], "ask_id int, prefix string, url string")
    assert {r["ask_id"]: r["uid"] for r in records.resolved(state, asked).collect()} == {1: "abc1", 2: None, 3: None, 4: "abc2", 5: "def3", 6: None, 7: None}


def test_empty_and_null_states(spark):
    state = spark.createDataFrame([(None,) * 14], ", ".join(f"{c} string" for c in records.FIELDS))
    empty = state.limit(0)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert records.visible(state, now, False, False).first()["status"] == "new"
    assert records.view_counts(empty, now, True).first().asDict() == {"n_open": 0, "n_applied": 0, "n_ignored": 0, "n_closed": 0, "n_total": 0}
    manual = spark.createDataFrame([], "uid string, erledigt string, aktion string, notes string")
    assert records.tracker_rows(state, manual).first()["erledigt"] == lifecycle.EMPTY_BOX
    assert records.tracker_rows(empty, manual).collect() == []
    one = lifecycle.merge(spark.createDataFrame([], "uid string, status string, first_seen timestamp, last_seen timestamp, last_sent timestamp, missing_runs int"), spark.createDataFrame([("a",)], "uid string"), now)
    assert one.first()["status"] == "new"


def test_json_ld_polymorphism(spark):
    body = """<script type='x'>1</script><script id="a" type="application/ld+json">
      {"@graph": [{"@graph": [{"@type": ["JobPosting"], "title": "Deep", "url": "https://x.ch/job/3"}]}, {"@type": "JobPosting", "title": "Near", "hiringOrganization": {"sameAs": "https://x.ch/job/2", "name": "N"}}]}
      </script><script type="application/ld+json">[{"@type": "JobPosting", "jobTitle": "Flat", "url": [7, "https://x.ch/job/1"], "hiringOrganization": "Solo"}, "text", null]</script>"""
    pages = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "<script type=\"application/ld+json\">{oops</script>")], "page_id int, html string")
    rows = html.json_ld_rows(pages, only_details=False).orderBy("page_id", "at").collect()
    assert [(r["page_id"], r["title"], r["company"]) for r in rows] == [(1, "Near", "N"), (1, "Deep", ""), (1, "Flat", "Solo")]
    assert [r["link"] for r in rows][:2] == ["https://x.ch/job/2", "https://x.ch/job/3"]


def test_detail_filter_reads_only_the_first_pages(spark):
    postings = spark.createDataFrame([(i, f"https://x.ch/{i}") for i in range(6)] + [(6, ""), (7, None), (8, "https://www.jora.com/1")], "ord int, link string")
    pages = spark.createDataFrame([("https://x.ch/0", "<p>Auslandseinsatz</p>"), ("https://x.ch/1", "<p>ok</p>"), ("https://x.ch/1", "<p>ok</p>"), ("https://x.ch/2", None), ("https://x.ch/5", "auslandseinsatz")], "url string, html string")
    got = {r["ord"]: (r["outcome"], r["reason"]) for r in stages.detail_filtered(postings, pages, 4).collect()}
    assert got == {0: ("phrase", "detail_phrase:auslandseinsatz"), 1: ("clean", None), 2: ("fetch_failed", None), 3: ("fetch_failed", None), 4: ("cap_reached", None), 5: ("cap_reached", None), 6: ("no_url", None), 7: ("no_url", None), 8: ("skipped_domain", None)}
