"""Clusters, containment, rates and budgets against plain folds, with hot keys and odd rows."""

import random

from pyspark.sql import functions as F

from jobloom.operators import meeting, ranking, reasons
from tests.test_postings import fold


def test_greedy_clusters_are_the_fold(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["", *map(str, range(2_250))]), rng.choice(["", *map(str, range(3_000))]), rng.choice(["|"] * 750 + [str(k) for k in range(1_500)])) for i in range(5_000)]
    frame = spark.createDataFrame(rows, "ord long, source_id string, url string, print string")
    assert {r["ord"]: r["cluster"] for r in ranking.greedy_clusters(frame).collect()} == fold(rows)


def test_null_keys_and_a_hot_key(spark):
    rows = [(i, None if i % 2 else "", None, "|" if i % 3 else f"p{i % 5}") for i in range(200)]
    frame = spark.createDataFrame(rows, "ord long, source_id string, url string, print string")
    assert {r["ord"]: r["cluster"] for r in ranking.greedy_clusters(frame).collect()} == fold([(a, b or "", c or "", d) for a, b, c, d in rows])
    assert ranking.greedy_clusters(frame.limit(0)).collect() == []


def test_chains_take_few_rounds(spark):
    found, rounds = meeting.roots(spark.range(3_000).select(F.col("id").alias("ord"), F.greatest(F.col("id") - 1, F.lit(0)).alias("parent")))
    assert {r["root"] for r in found.collect()} == {0} and rounds <= 12


def test_best_in_clusters(spark):
    rows = [(1, 1, 0.0, 5), (2, 1, None, 9), (3, 1, 9.0, 1), (4, 4, None, None), (5, 4, 0.0, -3)]
    frame = spark.createDataFrame(rows, "ord long, cluster long, score_final double, score_rule int")
    assert {(r["cluster"], r["ord"]) for r in ranking.best_in_clusters(frame).collect()} == {(1, 2), (4, 4)}


def test_names_in_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    names = sorted({word(rng.randrange(0, 9)) for _ in range(400)} | {f"place {i}" for i in range(5_000)})
    texts = [(i, rng.choice([word(rng.randrange(0, 30)), f"at place {rng.randrange(6_000)} here", None])) for i in range(300)]
    given = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names] + [(None,), ("",)] + [(names[5],)] * 3, "name string")
    want = {(i, n) for i, t in texts for n in names if t and n and n in t}
    found = meeting.contained(*given)
    assert {(r["id"], r["name"]) for r in found.collect()} == want and found.count() == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    best = {}
    for i, n in want:
        best[i] = min((-len(n), n), best.get(i, (0, "~")))
    assert {r["id"]: r["name"] for r in meeting.longest_contained(*given).collect()} == {i: n for i, (_, n) in best.items()}
    assert meeting.contained(given[0], given[1].limit(0)).collect() == []


def test_rates_of_a_user_with_most_events(spark):
    rng = random.Random(2)
    events = [(i, "hot" if i % 10 else f"u{i % 7}", rng.choice([rng.randrange(40_000), None, 7_200])) for i in range(2_000)] + [(9_000, None, 5), (9_001, None, 6)]
    frame = spark.createDataFrame(events, "event long, user string, at long")
    got = {r["event"]: r["allowed"] for r in meeting.within_rate(frame, "user", F.col("at"), 30).collect()}
    for event, user, at in events:
        assert got[event] == (at is not None and sum(1 for _, u, t in events if u == user and t is not None and at - 3600 <= t <= at) <= 30)


def test_budgets_count_distinct_links(spark):
    links = ["a", "a", "", None, "b", "a", "c", "b", "d"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "ord long, link string")
    cut = lambda most: ranking.last_scan(frame, "link", F.lit(True), "ord", most).first()["cut"]
    assert [cut(n) for n in (1, 2, 3, 4, 5)] == [0, 4, 6, 8, None]


def test_pages_are_scanned_once_for_all_three(spark):
    rules = reasons.Rules(required=("python", "go"), blocked=("fahrausweis noetig",))
    pages = [("x", "<p>Go und Fahrausweis n&ouml;tig</p>", 200), ("y", "<p>Python</p>", None), ("z", "nothing", 404), ("w", "Job not found", 200), (None, None, None)]
    blocked, required, gone = reasons.page_facts(spark.createDataFrame(pages, "url string, html string, status int"), rules)
    assert [{r["link"] for r in f.collect()} for f in (blocked, required, gone)] == [{"x"}, {"x", "y"}, {"z", "w"}]
