"""Contact names, detail texts, pages of a site, settings and files, on small tables by hand."""

from pyspark.sql import functions as F

from jobloom.operators import settings
from jobloom.sources import contacts, files, html


def test_contact_names(spark):
    given = {
        "<p>Kontakt: Anna Muster</p>": "Anna Muster",
        "<p>KONTAKTPERSON</p><p> </p><p>Eva&nbsp;Roth Tel 1</p>": "Eva Roth",
        "<p>Contact</p><p>a</p><p>b</p><p>Eva Roth</p>": "",
        "<p>Recruiter: x@y.ch</p><p>http://a.ch b c</p><p>" + "Lang Wort " * 9 + "</p><p>Bewerbung an Eva Roth Frei M</p>": "",
        "Name Ohne Zeichen": "",
        "<script>contact: Eva Roth</script>": "",
        "": "",
        None: "",
        "<p>a: b</p><p>Contact: Eva Roth: Bern</p>": "Eva Roth: Bern",
        "x " * 200_000 + "<br>Kontakt<br/>Max O'Neil": "Max O'Neil",
    }
    rows = spark.createDataFrame(list(given.items()), "html string, wanted string")
    got = rows.select("wanted", contacts.contact_name(F.col("html")).alias("name")).collect()
    assert [r["name"] for r in got] == [r["wanted"] for r in got]


def test_detail_texts(spark):
    script = '<script type="application/ld+json">{}</script>'
    given = {
        script.format('{"@graph": [{"@type": "JobPosting", "title": "A", "skills": ["x"]}, {"@type": "JobPosting", "description": "B", "jobLocation": {"address": {"addressRegion": "ZH"}}}]}') + "<main>no</main>": "A B ZH",
        script.format('{"@type": "Person", "title": "A"}') + "<MAIN a=1>x<nav>n</nav>&amp;</MAIN><article>y</article>z": "x & y",
        script.format("{broken") + "<footer>f</footer>all<b>!": "all !",
        None: "",
        "": "",
    }
    rows = spark.createDataFrame(list(given.items()), "html string, wanted string")
    got = rows.select("wanted", F.trim(F.regexp_replace(html.detail_text(F.col("html")), "\\s+", " ")).alias("text")).collect()
    assert [r["text"] for r in got] == [r["wanted"] for r in got]


def test_pages_until_the_first_empty_one(spark):
    pages = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("a", 5, False), (None, 1, False), ("b", 1, False), ("b", 2, False)], "site string, page int, failed boolean")
    rows = spark.createDataFrame([("a", 1, 0, "l?1"), ("a", 1, 1, "l?2"), ("a", 3, 0, "m"), ("a", 5, 0, "late"), (None, 1, 0, None), (None, 1, 1, "n"), ("b", 2, 0, "after")], "site string, page int, at int, link string")
    found = lambda limit: sorted((r["site"] or "", r["link"] or "") for r in html.paged_rows(rows, pages, limit).collect())
    assert found(0) == found(None) == [("", ""), ("", "n"), ("a", "l?1"), ("a", "m")]
    assert found(1) == [("", ""), ("a", "l?1")]
    assert html.paged_rows(rows.limit(0), pages).count() == 0


def test_settings(spark):
    given = [" Yes ", "0", "", None, "12", " -3 ", "99999999999999999999", "1e2", "inf", "1d", "x"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i")
    got = rows.select(settings.as_bool(F.col("x"), True), settings.as_int(F.col("x"), 5), settings.as_float(F.col("x"), 0.5)).collect()
    assert [r[0] for r in got] == [True, False, False, True] + [False] * 7
    assert [r[1] for r in got] == [5, 0, 5, 5, 12, -3, 5, 5, 5, 5, 5]
    assert [r[2] for r in got] == [0.5, 0.0, 0.5, 0.5, 12.0, -3.0, 1e20, 100.0, float("inf"), 0.5, 0.5]
    lists = spark.createDataFrame([(["Bern", "bern", None], [" BERN", "Zug", "zug ", "", None]), (None, ["a"]), (["a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(settings.with_places(F.col("a"), F.col("b"))).collect()] == [["Bern", "bern", None, "Zug"], ["a"], ["a"]]
    profile = spark.createDataFrame([(None, None, None, None), ("master", "BSc", 9, True)], "l string, d string, y int, f boolean")
    bare, full = (r[0] for r in profile.select(settings.ruled_out(*map(F.col, "ldyf"))).collect())
    assert full == sorted(settings.MANY_YEARS) and bare == sorted({*settings.DEGREE, *settings.MANY_YEARS, *settings.THREE_YEARS, *settings.TWO_YEARS, *settings.FIELD, *settings.DRIVING})
    split = settings.parted(spark.createDataFrame([(1,), (2,), (None,)], "n int"), F.col("n") > 1)
    assert [x.count() for x in split] == [1, 2]


def test_files_keep_their_texts(spark, tmp_path):
    rows = spark.createDataFrame(
        [('a "b", c\nArbeitsort\nBern\nMuster AG', "", None, "good", 3, "l", "s", 'a "b", c\nArbeitsort\nBern\nMuster AG', "2024"), ("x", "y", "z", "", None, "", None, "", None)],
        "title string, company string, location string, match string, score long, link string, source string, raw_title string, date string",
    )
    files.write_csv(rows, f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv")
    assert sorted(r["title"] for r in back.collect()) == sorted(r["title"] for r in rows.collect())
    assert sorted(r["score"] for r in files.converted(back, F.lit("d")).collect()) == [0, 3]
    files.write_json(rows, f"{tmp_path}/json")
    found = {r["link"]: r for r in files.read_json(spark, f"{tmp_path}/json", False).collect()}
    assert (found["l"]["title"], found["l"]["company"], found["l"]["location"], found["l"]["fit"]) == ('a "b", c', "Muster AG", "Bern", "")
    assert found[""]["score"] is None and found[""]["title"] == "x"


def test_documents(spark):
    records = spark.createDataFrame([("1", "out/a.pdf", "out/b.pdf"), ("2", "out/none.pdf", "./out//x/../b.PDF"), ("3", "../out/a.pdf", "other/a.pdf"), (None, None, "out/a.txt"), ("4", None, "")], "uid string, application_doc_archived string, application_doc string")
    there = spark.createDataFrame([("out/a.pdf",), ("out/a.pdf",), ("out/b.PDF",), ("other/a.pdf",), ("out/a.txt",), (None,)], "path string")
    got = [(r["uid"], r["document"]) for r in files.with_document(records, there).collect()]
    assert sorted(got, key=str) == sorted([("1", "out/a.pdf"), ("2", "out/b.PDF"), ("3", None), (None, None), ("4", None)], key=str)


def test_career_pages(spark):
    rows = spark.createDataFrame([(1, ["https://www.my-firm.ch/a", "https://b.ch"], ["", None]), (2, ["https://b.ch"], ["B AG", "C"]), (3, [], None), (4, None, ["x"])], "id int, urls array<string>, names array<string>")
    assert sorted((r["id"], r["at"], r["company"]) for r in settings.career_pages(rows).collect()) == [(1, 0, "My Firm"), (1, 1, "B"), (2, 0, "B AG")]


def test_profiles_of_files(spark):
    given = [None, "", "{broken", "{}", '{"education": null}', '{"education": {"level": " NONE ", "degree": "BSc"}, "experience_years": 5, "driving_license": true}', '{"education": {"degree": "BSc"}, "experience_years": "2", "driving_license": true}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i")
    got = [set(r[0]) for r in rows.select(settings.ruled_out_by(F.col("x"))).collect()]
    many = set(settings.MANY_YEARS)
    assert got[:4] == [set()] * 4
    assert got[4] == many.union(settings.DEGREE, settings.THREE_YEARS, settings.TWO_YEARS, settings.FIELD, settings.DRIVING)
    assert got[5:] == [many.union(settings.DEGREE), many.union(settings.THREE_YEARS)]


def test_env_lines(spark):
    lines = spark.createDataFrame([(0, "# A=0"), (1, "A = 1"), (2, "B='x # y' # z"), (3, ""), (4, "A=2 # n"), (5, None), (6, "C=a#b")], "at long, line string")
    updates = spark.createDataFrame([(0, "A", "0"), (1, "A", "9"), (2, "D", "$1"), (3, None, "x"), (4, "E", None)], "ord long, key string, value string")
    assert {r["key"]: r["value"] for r in settings.env_values(lines).collect()} == {"A": "2", "B": "x # y", "C": "a#b"}
    got = [r["line"] for r in settings.env_updated(lines, updates).orderBy("part", "at").collect()]
    assert got == ["# A=0", "A =9", "B='x # y' # z", "", "A=9", None, "C=a#b", "D=$1"]
    assert [r["line"] for r in settings.env_updated(lines.limit(0), updates).orderBy("at").collect()] == ["A=9", "D=$1"]


def test_list_of_applications(spark, tmp_path):
    rows = spark.createDataFrame([(0, 'A "B"', "P", "EMAIL", None, "VERSENDET")], "ord long, company string, position string, portal string, link string, status string")
    lines = files.application_lines(rows, F.lit("01.02.2024"))
    found = [r["line"] for r in files.with_header(lines).orderBy("at").collect()]
    assert found == [files.APPLICATIONS, '01.02.2024,"A "B"","P","EMAIL","","VERSENDET",""']
    assert files.with_header(files.with_header(lines)).count() == 2
    files.write_keyed(rows, f"{tmp_path}/keyed", "ord")
    assert spark.read.json(f"{tmp_path}/keyed").count() == 1


def test_tracker_as_csv(spark, tmp_path):
    columns = ("uid", "status", "applied_at", "title", "company", "location", "source", "link", "canonical_url", "first_seen_at", "last_seen_at", "last_sent_at", "score", "match")
    state = spark.createDataFrame([("1", "applied", None, 'a "b"', *[None] * 10), ("2", "closed", *[None] * 12)], ", ".join(f"{c} string" for c in columns))
    manual = spark.createDataFrame([("1", "", "", "n")], "uid string, erledigt string, aktion string, notes string")
    files.write_tracker(state, manual, f"{tmp_path}/tracker")
    back = spark.read.csv(f"{tmp_path}/tracker", header=True, escape='"').collect()
    assert [(r["uid"], r["title"], r["aktion"], r["notes"]) for r in back] == [("1", 'a "b"', "applied", "n")]


def test_letters(spark):
    from jobloom.operators import stages

    rows = spark.createDataFrame([(0, "{COMPANY_NAME}|{{COMPANY_NAME}}|{}|<Ort>", None, ""), (1, "<JOBTITEL> {Muster}", "Muster", "Zug"), (2, None, "x", "y"), (3, "", "x", "y")], "i int, t string, c string, l string").orderBy("i")
    got = [r[0] for r in rows.select(stages.letter_text(F.col("t"), F.lit("d"), F.lit("<FIRMA>"), F.col("c"), F.col("l"))).collect()]
    assert got == ["|||Buelach", "Muster Muster", None, ""]


def test_contact_name_beside_cut_references(spark):
    """What a tag cuts off of a reference stays; whole references and those within a text are resolved."""
    pages = ["<p>Kontakt:</p><p>Jo M. &amp</p>", "<p>Kontakt: Jo M&am</p>", "<p>Kontakt:</p><p>Jo M. &amp;</p>", "<p>Kontakt:</p><p>Jo &amp Mo</p>", "<p>Kontakt: &quot"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").orderBy("i")
    assert [r["n"] for r in rows.select(contacts.contact_name(F.col("html"), cut=True).alias("n")).collect()] == ["Jo M. &amp", "Jo M&am", "Jo M. &", "Jo & Mo", ""]
    assert [r["n"] for r in rows.select(contacts.contact_name(F.col("html")).alias("n")).collect()] == ["Jo M. &", "Jo M&am", "Jo M. &", "Jo & Mo", ""]


def same_as_sql(spark, folder, name, table, rows, schema, others=()):
    """Whether a query gives what its SQL gives over a table of these rows."""
    import duckdb

    from jobloom.catalog import ORACLES, QUERIES

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for given in (table, *others):
        con.execute(f"CREATE VIEW {given} AS SELECT * FROM '{folder}/{given}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect())) == sorted(con.execute(ORACLES[name]).fetchall())


HEADS = ["Y$$$ el.&amp", "Eva Roth&amp", "One two three four&quot", "Eva Roth &amp;&am", "Max&amp;Frei", "&amp", "Max &amp;lt; Frei&"]


def test_contact_names_as_in_the_sql(spark, tmp_path):
    pages = [(6 * i + 4, f"<html><title>{h}</title><body><h1>{h}</h1></body></html>") for i, h in enumerate(HEADS)]
    assert same_as_sql(spark, tmp_path, "contact_name_by_label", "pages", pages, "page_id long, html string")


def test_daily_run_labels_of_skipped_reviews(spark, tmp_path):
    """More postings of the best score than are reviewed, so that others have a match and no reason."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 1500, 3)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    ids = [130 * k + 129 for k in range(1000)] + list(range(125))
    assert same_as_sql(spark, tmp_path, "daily_run", "documents", [(i,) for i in ids], "doc_id long", others=("labels",))


def test_fingerprints_of_far_keys(spark, tmp_path):
    """Keys so far apart that they outweigh a hundredth of the price in the SQL's score."""
    parts = [(1, "blue pen", "B#1", 10.0), (20_002, "pen blue", "B#1", 10.01), (40_003, "blue pen", "B#1", 10.05), (7, "red pen", "B#2", 3.0), (8, "red pen", "B#2", 3.0), (700_009, "red pen", "B#2", 3.5)]
    assert same_as_sql(spark, tmp_path, "dedupe_by_fingerprint", "part", parts, "p_partkey long, p_name string, p_brand string, p_retailprice double")
    assert same_as_sql(spark, tmp_path / "far", "dedupe_by_fingerprint", "part", [(1, "blue pen", "B#1", 10.0), (20_002, "pen blue", "B#1", 10.01)], "p_partkey long, p_name string, p_brand string, p_retailprice double")


def test_detail_texts_as_in_the_sql(spark, tmp_path):
    pages = [(4 * i + k, f"<html><title>{h}</title><body><p>{h}</p>{tag.format(h)}</body></html>") for i, h in enumerate(HEADS) for k, tag in ((2, ""), (3, "<article><h1>{0}</h1></article>"))]
    assert same_as_sql(spark, tmp_path, "detail_text_choice", "pages", pages, "page_id long, html string")


def test_shown_texts_as_in_the_sql(spark, tmp_path):
    pages = [(i, f"<html><title>{h}</title><script>a&amp</script><body><h1>{h}</h1>{h}<p>{h}</p></body></html>") for i, h in enumerate(HEADS)]
    assert same_as_sql(spark, tmp_path, "html_shown_text", "pages", pages, "page_id long, html string")
