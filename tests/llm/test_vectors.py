"""Vector codes and whitening against brute force, with odd vectors and rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from jobloom.llm import queries, vector_codes, whitening
from jobloom.llm.vector_codes import nearest

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, error long"


def written(spark, folder, rows):
    spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors of the smallest table with copies, odd ones, null and repeated ids and clashing extra columns."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    some = rows[3][1]
    rows += [(10_000 + i, some, None if i % 2 else 1) for i in range(60)]
    rows += [(20_000, None, 1), (20_001, [*some[:-1], None], 1), (20_002, [*some[:-1], float("nan")], 1), (20_003, [float("inf"), *some[1:]], 1)]
    rows += [(None, rows[5][1], 7), (None, rows[6][1], None), (10_000, rows[7][1], 2)]
    return rows, written(spark, tmp_path_factory.mktemp("vectors"), rows)


def kept(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    rows = kept(rows)
    length = max(len(v) for _, v, _ in rows)
    length += -length % parts
    ints = [[math.floor(scale * np.float64(c)) for c in v] + [0] * (length - len(v)) for _, v, _ in rows]
    width = length // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], ints[i]))[:entries]
    book = [[ints[i][p * width : (p + 1) * width] for i in first] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))

    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in ints]
    for _ in range(rounds):
        sums = defaultdict(list)
        for x in cut:
            for p in range(parts):
                sums[p, assign(x[p], p)[1]].append(x[p])
        for (p, e), members in sums.items():
            book[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[assign(x[p], p) for p in range(parts)] for x in cut]
    labels = defaultdict(int)
    for (_, _, label), f in zip(rows, found, strict=True):
        labels[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(v) for part in book for c in part for v in c).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), labels[r[2]], digest) for r, f in zip(rows, found, strict=True))


def codes(spark, path):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in queries.op11_segment_codes(spark, path).collect())


def test_codes(spark, vectors):
    rows, path = vectors
    assert codes(spark, path) == brute_codes(rows)


def test_codes_when_labels_are_too_many_to_broadcast(spark, vectors, monkeypatch):
    rows, path = vectors
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(vector_codes, "FREQUENT", 4)
    assert codes(spark, path) == brute_codes(rows)


def test_codes_of_few_short_and_huge_vectors(spark, tmp_path):
    rows = [(1, [0.5, -0.25, 0.1], 1), (2, [0.5], None), (3, [], None), (4, [0.1] * 9, 1)]
    assert codes(spark, written(spark, tmp_path / "a", rows)) == brute_codes(rows)
    huge = [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (3, [0.0] * 8, 1)]
    assert [r[2] for r in codes(spark, written(spark, tmp_path / "b", huge))] == [0, 0, 0]


def test_no_vectors(spark, tmp_path):
    path = written(spark, tmp_path, [(1, None, 1)])
    assert queries.op11_segment_codes(spark, path).collect() == []
    assert queries.op12_svd_whitening(spark, path).collect() == []


@pytest.mark.parametrize("width", [1, 2, 6, 8, 16])
def test_bounds_lose_no_entry(width):
    rng = np.random.default_rng(width)
    for scale in (2, 100, 1 << 27):
        x, book = rng.integers(-scale, scale, (400, width)), rng.integers(-scale, scale, (16, width))
        x[:100], book[3] = book[rng.integers(0, 16, 100)], book[1]
        index, least, measured = nearest(x, book)
        full = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (least == full.min(1)).all()
        assert width < 4 or measured < 0.9 * full.size


def brute_whitening(rows, components=16):
    rows = kept(rows)
    length = max(len(v) for _, v, _ in rows)
    ints = [tuple(math.floor(64 * np.float64(c)) + 1_000_000 for c in [*v, *[0.0] * (length - len(v))]) for _, v, _ in rows]
    fit = sorted(set(ints))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - t for c, t in zip(x, total, strict=True)] for x in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    own = np.array([[n * c - t for c, t in zip(x, total, strict=True)] for x in ints], float) / n
    deviations = [sum((n * c - t) ** 2 for c, t in zip(x, total, strict=True)) for x in ints]
    return n, deviations, own @ axes, values, np.trace(centred.T @ centred / n)


def test_whitening(spark, vectors):
    rows, path = vectors
    n, deviations, projected, values, trace = brute_whitening(rows)
    got = queries.op12_svd_whitening(spark, path).collect()
    assert len(got) == 16 * len(deviations) and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got) == sorted(deviations * 16)
    assert all(r["identity_error"] < 1e-9 and r["deviation_exact"] == str(r["deviation"]) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    for k in range(1, 17):
        assert np.allclose([r["explained"] for r in by[k]], values[k - 1] / trace, rtol=1e-9)
        want = projected[:, k - 1] / np.sqrt(values[k - 1])
        mine = np.array(sorted(r["whitened"] for r in by[k]))
        assert np.allclose(mine, np.sort(want), atol=1e-8) or np.allclose(mine, np.sort(-want), atol=1e-8)


def test_whitening_without_variance(spark, tmp_path):
    rows = [(1, [0.5, 0.25, 0.1], 1), (2, [0.1, 0.9], None), (3, [0.5, 0.25, 0.1], 2)]
    got = {(r["vec_id"], r["component"]): r for r in queries.op12_svd_whitening(spark, written(spark, tmp_path / "a", rows)).collect()}
    assert sorted(got) == [(i, k) for i in (1, 2, 3) for k in (1, 2, 3)]
    assert abs(abs(got[1, 1]["whitened"]) - 1) < 1e-9 and got[1, 1]["whitened"] == got[3, 1]["whitened"] == pytest.approx(-got[2, 1]["whitened"])
    assert all(got[i, k]["whitened"] is None for i in (1, 2, 3) for k in (2, 3)) and got[1, 1]["explained"] == 1
    same = queries.op12_svd_whitening(spark, written(spark, tmp_path / "b", rows[:1] * 3)).collect()
    assert len(same) == 9 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    huge = queries.op12_svd_whitening(spark, written(spark, tmp_path / "c", [(1, [1e9, 1.0], 1), (2, [-1e9, 1.0], 1), (3, [0.0, 0.0], 1)])).collect()
    assert all(r["deviation"] is None and int(r["deviation_exact"]) > 1 << 63 for r in huge if r["vec_id"] in (1, 2))


def test_merged_sketches_lose_nothing():
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (300, 12)) + np.arange(12) * 1000
    cuts = [0, 1, 3, 50, 51, 120, 300]
    merged = whitening._together(whitening.Sketch.of(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    assert merged.n == 300 and merged.total == rows.sum(0).tolist()
    assert np.allclose(merged.covariance(), np.cov(rows.T, bias=True), rtol=1e-11, atol=1e-9)
