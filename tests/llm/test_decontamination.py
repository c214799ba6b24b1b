"""Winnowed benchmark passages against every window of every item, word for word."""

import hashlib
import random
import re

import pytest

from jobloom.llm import decontamination, queries

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, words string, at long, v long, row_no long, len long"
ITEMS = "item_id long, text string, name string, doc_id long"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, length=10):
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        n = min(len(words), length)
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        words, hit, held = words_of(text), set(), set()
        for n in range(1, length + 1):
            for i in range(len(words) - n + 1):
                if names := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    held |= names
        out.append((str(doc_id), len(words), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def table(spark, folder, docs, items):
    spark.createDataFrame([(*d, "w", 1, 2, 3, 4) for d in docs], DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*i, "n", 5) for i in items], ITEMS).repartition(2).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def found(spark, path):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op13_winnowing(spark, path).collect())


@pytest.fixture(scope="module")
def rows(spark):
    """Documents with items whole, cut, overlapping, in capitals and repeated; items short, empty, null and doubled."""
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = words_of(items[0][1]) + words_of(items[1][1])
    items += [(900, " ".join(long[4:30])), (901, "Only-four words; here"), (902, "solitary"), (903, "seven words that make up an item"), (904, ""), (905, None)]
    items += [(None, "an item without any id at all, of twelve words or so, yes"), (901, " ".join(long[:14])), (906, "na " * 25)]
    at = 50_000
    for size in (9, 10, 11, 13, 25):
        start = rng.randrange(len(long) - size)
        docs.append((at + size, f"before {'; '.join(long[start : start + size]).upper()} after"))
    docs += [(60_000, " ".join(long) * 3), (60_001, " ".join(long[:12] + long[6:20])), (60_002, "solitary solitary only four WORDS here"), (60_003, "na " * 40)]
    docs += [(60_004, "na " * 9), (60_005, None), (60_006, ""), (60_007, " \t;"), (60_008, "An item without any id at all of twelve words or so")]
    docs += [(None, "only four words here"), (None, " ".join(long[3:15])), (60_001, "another text with the same id"), (60_009, "word " * 30_000 + " ".join(long[5:16]))]
    docs += [(70_000 + i, f"{i} " + " ".join(long[2:24])) for i in range(50)]
    return docs, items


@pytest.mark.parametrize("few", [None, 3])
def test_winnowing(spark, rows, tmp_path, monkeypatch, few):
    """Also where nothing is small enough to broadcast."""
    docs, items = rows
    if few:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", few)
    assert found(spark, table(spark, tmp_path, docs, items)) == brute(docs, items)


def test_winnowing_without_short_items(spark, rows, tmp_path):
    docs, items = rows
    items = [(i, t) for i, t in items if not 0 < len(words_of(t)) < 10]
    assert found(spark, table(spark, tmp_path, docs, items)) == brute(docs, items)


def test_random_words_of_a_small_alphabet(spark, tmp_path):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs, items = [(i, line(rng.randrange(0, 60))) for i in range(300)], [(i, line(rng.randrange(6, 16))) for i in range(12)]
    assert found(spark, table(spark, tmp_path, docs, items)) == brute(docs, items)


def test_empty_tables(spark, tmp_path):
    docs = [(1, "some words in here"), (None, None)]
    assert found(spark, table(spark, tmp_path / "a", docs, [])) == brute(docs, [])
    assert found(spark, table(spark, tmp_path / "b", docs, [(1, None), (2, " . ")])) == brute(docs, [])
    assert found(spark, table(spark, tmp_path / "c", [], [(1, "some words")])) == []


def test_no_python_on_the_main_path(spark, rows, tmp_path):
    plan = queries.op13_winnowing(spark, table(spark, tmp_path, *rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
