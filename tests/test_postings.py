"""Posting operators: every query against its SQL, and the rules that SQL does not show."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from jobloom import catalog
from jobloom.functions import text, urls
from jobloom.operators import lifecycle, ranking

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    frame = catalog.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    expected = sql.execute(catalog.ORACLES[name])
    at = [d[0] for d in expected.description]
    assert sorted(at) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in frame.collect()) == sorted(tuple(plain(r[at.index(c)]) for c in names) for r in expected.fetchall())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    lit = F.lit
    row = one(
        spark,
        collector=text.norm_collector(lit("Zürich  HB, Straße é")),
        state=text.norm_state(lit("Zürich Straße")),
        iso=text.unified_date(lit("2024-03-05T10:00")),
        day=text.unified_date(lit("5.3.2024")),
        odd=text.unified_date(lit("soon")),
        load=text.workload(lit("Pensum 80 - 100 %")),
        uid=urls.job_uid(lit("jobs.ch"), lit("HTTPS://WWW.Jobs.ch/detail/1/?a=b#c"), lit(""), lit(""), lit("")),
        same=urls.job_uid(lit("jobs.ch"), lit("https://www.jobs.ch/detail/1"), lit("x"), lit("y"), lit("z")),
        jk=urls.source_job_id(lit("https://ch.indeed.com/viewjob?jk=abc123&x=1")),
        level=ranking.seniority(lit("Team Leiterin IT")),
        due=lifecycle.reminder_due(lit("2024-01-01 00:00:00").cast("timestamp"), lit("2024-01-03 00:00:00").cast("timestamp"), 2),
    )
    assert (row.collector, row.state) == ("zuerich hb strasse e", "zurich stra e")
    assert (row.iso, row.day, row.odd, row.load) == ("2024-03-05", "2024-03-05", "soon", "80 - 100 %")
    assert row.uid == row.same and len(row.uid) == 16 and row.jk == "abc123" and row.level == "leiterin" and row.due


def fold(rows):
    """The rule of greedy clusters, row by row."""
    seen, found = {}, {}
    for at, source, url, mark in sorted(rows):
        own = [k for k in (source and "i" + source, url and "u" + url, "p" + mark) if k]
        cluster = next((seen[k] for k in own if k in seen), at)
        for k in own:
            seen.setdefault(k, cluster)
        found[at] = cluster
    return found


def test_greedy_clusters(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", *"abcdefgh"]), rng.choice(["", *map(str, range(30))]), rng.choice(["|", *map(str, range(40))])) for i in range(80)]
    frame = spark.createDataFrame(rows, "ord long, source_id string, url string, print string")
    assert {r["ord"]: r["cluster"] for r in ranking.greedy_clusters(frame).collect()} == fold(rows)


def test_greedy_clusters_query_reads_whole_titles(spark, tmp_path):
    """The registered query against the fold, with long titles that differ behind their first 40 characters."""
    same = "Systemtechnikerin Netzwerkbetrieb und Cloud "
    titles = [same + "Aarau", same + "Zug", "Zug " + same, same + "Aarau, Aarau", "Ops", "<b>Ops</b>", None, same + "Bern"]
    urls_of = [f"https://h{i}.example/a" for i in range(7)] + ["https://h0.example/a"]
    pages = [(i, url, f"<html><head>{'' if head is None else f'<title>{head}</title>'}</head><body>{same} text {i}</body></html>") for i, (url, head) in enumerate(zip(urls_of, titles, strict=True))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def mark(head):
        words = set(re.findall("[a-z0-9]+", (head or "").lower())) - set(ranking.NOISE)
        return " ".join(sorted(words)[:4]) + "|"

    expected = fold([(i, "", url, mark(head)) for i, (url, head) in enumerate(zip(urls_of, titles, strict=True))])
    assert expected[0] != expected[1] == expected[2] and expected[0] == expected[3] == expected[7]
    assert {r["ord"]: r["cluster"] for r in catalog.QUERIES["dedupe_greedy_clusters"](spark, str(tmp_path)).collect()} == expected
