"""The Jaccard join where ids repeat with different texts or are missing: rows are what links, ids only name them."""

import random
import re

import pytest

from jobloom.llm import jaccard_join

SCHEMA = "doc_id long, text string, mark long, of string, signature string"


def components(rows):
    """(doc_id, n_shingles, component_id) of each row, every pair compared."""
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id, root(i)) for i, (doc_id, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "o", "s") for a, b in rows], SCHEMA).repartition(3)


def found(spark, rows):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())


def wanted(rows):
    return sorted((str(a), n, str(c)) for a, n, c, _ in components(rows))


def test_an_id_with_two_texts_loses_no_link(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (1, "another text altogether of the same id as the first one")]
    assert found(spark, rows) == wanted(rows) == [("1", 7, "1"), ("1", 21, "1"), ("2", 22, "1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_and_missing_ids(spark, seed):
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(rng.randrange(12, 90))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
            rows.append((rng.choice([None, *range(1, 30)]), " ".join(words)))
    rows += rng.sample(rows, 15) + [(None, None), (None, ""), (3, " "), (3, "two words"), (4, "Two  words"), (None, "two words")]
    rng.shuffle(rows)
    assert found(spark, rows) == wanted(rows)

    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard_join.one_of_each(frame(spark, rows)).collect())
    groups = {}
    for (doc_id, text), (_, n, _, root) in zip(rows, components(rows), strict=True):
        if n:
            groups.setdefault(root, []).append((doc_id is None, doc_id or 0, text))
    empty = [(str(a), b or "") for (a, b), (_, n, _, _) in zip(rows, components(rows), strict=True) if not n]
    assert len({k for k in kept if k not in empty}) == len(groups)
    for members in groups.values():
        late, least, _ = min(members)[:3]
        stays = [m for m in members if (str(None if m[0] else m[1]), m[2]) in kept]
        assert {(a, b) for a, b, _ in stays} == {(late, least)} and len({t for _, _, t in stays}) == 1
    assert [k for k in kept if k in empty] == sorted(empty)
