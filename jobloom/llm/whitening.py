"""Whitening of vectors by hierarchical merging of singular value decompositions.

Each task of the fit keeps, of the vectors that it has read, their count, mean and all singular values and vectors of
the centred rows. Two such sketches merge without loss: the rows diag(s)V of both and one row more,
sqrt(n m / (n + m)) (mean - mean), have the same Gram matrix as all centred rows together, and are decomposed again.
Sketches of FAN tasks meet in one task, their results again, until one is left; no dimension is cut on the way.

An entry c stands for the integer floor(64 c) + 1,000,000. The constant cancels in whatever is centred, so it is never
added and the doubles keep their digits; sums and deviations are exact integers.

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped; entries beyond 2**30 on either
side count as that. Vectors shorter than the longest are filled with zero entries. Copies of a vector count once in
the fit and each get their rows. A component without variance, as with fewer distinct vectors than components, has a
null ``whitened`` and is left out of ``identity_error``; ``explained`` is null if all vectors are equal. A deviation
beyond 64 bits is null as a long and whole as text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import settled, shared_path, tabled
from jobloom.llm.vectors import integer_vectors, matrices

SCALE, COMPONENTS = 64, 16
#: Integers saturate here.
MOST = 1 << 36
#: Sketches that meet in one task.
FAN = 8
SKETCH = "part int, n bigint, total array<bigint>, mean array<double>, s array<double>, vt array<double>"


class Sketch(NamedTuple):
    """Of some rows: count, exact sums (integers only, else empty), mean, singular values and vectors when centred."""

    n: int
    total: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Sketch:
        whole = rows.dtype.kind == "i"
        total = rows.sum(0).tolist() if whole else []
        mean = np.array(total, np.float64) / len(rows) if whole else rows.mean(0)
        _, s, vt = np.linalg.svd(rows - mean, full_matrices=False)
        return cls(len(rows), total, mean, s, vt)

    def merged(self, other: Sketch) -> Sketch:
        n = self.n + other.n
        apart = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, apart]), full_matrices=False)
        total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        mean = np.array([t / n for t in total]) if total else (self.n * self.mean + other.n * other.mean) / n
        return Sketch(n, total, mean, s, vt)

    def covariance(self) -> np.ndarray:
        return (self.vt.T * (self.s * self.s / self.n)) @ self.vt


def _row(part: int, a: Sketch) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [a.n], "total": [a.total], "mean": [a.mean.tolist()], "s": [a.s.tolist()], "vt": [a.vt.reshape(-1).tolist()]})


def _read(r) -> Sketch:
    return Sketch(int(r.n), [int(t) for t in r.total], np.array(r.mean), np.array(r.s), np.array(r.vt).reshape(len(r.s), -1))


def _together(sketches: Iterable[Sketch]) -> Sketch | None:
    all_of = None
    for one in sketches:
        all_of = one if all_of is None else all_of.merged(one)
    return all_of


def sketched(table: DataFrame, length: int, seen=None) -> Sketch | None:
    """The sketch of all rows of a table of integer vectors, or of what ``seen`` makes of them; None without rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _together(Sketch.of(rows if seen is None else seen(rows)) for _, rows in matrices(batches, length))
        if found is not None:
            yield pa.RecordBatch.from_pandas(_row(TaskContext.get().partitionId(), found), schema=ARROW_SKETCH, preserve_index=False)

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        return _row(int(rows["part"].iloc[0]), _together(_read(r) for r in rows.itertuples()))

    level = settled(table.select("x").mapInArrow(of_task, SKETCH))
    top = level.agg(F.max("part")).first()[0]
    while top:
        level = settled(level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInPandas(of_group, SKETCH))
        top //= FAN
    return None if top is None else _read(level.first())


ARROW_SKETCH = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())), ("vt", pa.list_(pa.float64()))])


class Whitening(NamedTuple):
    """A fitted whitening: ``axes`` has a column a component with variance, divided by its standard deviation."""

    fit: Sketch
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @classmethod
    def of(cls, fit: Sketch, components: int) -> Whitening:
        s = np.zeros(max(len(fit.mean), len(fit.s)))
        s[: len(fit.s)] = fit.s
        rank = int((s > s.max(initial=0) * len(s) * 16 * np.finfo(float).eps).sum())
        used = min(rank, components)
        signs = np.sign(fit.vt[np.arange(used), np.abs(fit.vt[:used]).argmax(1)]) if used else np.zeros(0)
        deviations = s[:used] / np.sqrt(fit.n)
        return cls(fit, (fit.vt[:used] * (signs / deviations)[:, None]).T, s[:components] ** 2 / fit.n, float((s * s).sum() / fit.n))

    def applied(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.fit.mean) @ self.axes

    def deviations(self, rows: np.ndarray) -> list[int]:
        """sum of (n x - S)^2 over a row, from its exact products."""
        n, total = self.fit.n, self.fit.total
        most = max([0, *map(abs, total)]) + int(np.abs(rows).max(initial=0))
        kind = np.int64 if len(total) * most * most < 1 << 62 else object
        x, sums = rows.astype(kind), np.array(total, kind)
        constant = sum(t * t for t in total)
        return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip((x * x).sum(1), (x * sums).sum(1), strict=True)]


def whitened(frame: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_exact (as text)."""
    spark = frame.sparkSession
    table, length = integer_vectors(frame, SCALE, MOST, id_col, vector_col, None)
    distinct = tabled(table.select("x").distinct(), shared_path(spark, "fit"))
    fit = sketched(distinct, length)
    kind = f"vec_id {table.schema['vec_id'].dataType.simpleString()}"
    schema = f"{kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"
    if fit is None or not length:
        return spark.createDataFrame([], schema)
    white = Whitening.of(fit, components)
    shown, used = min(components, length), white.axes.shape[1]
    error = float(np.abs(sketched(distinct, length, white.applied).covariance() - np.eye(used)).max()) if used else 0.0
    explained = [float(v) / white.trace if white.trace else None for v in white.variances[:shown]]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in matrices(batches, length):
            values = np.full((len(rows), shown), np.nan)
            values[:, :used] = white.applied(rows)
            exact = white.deviations(rows)
            each = pa.array(np.repeat(np.arange(len(rows)), shown))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), fit.n)),
                    pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(each),
                    pa.array(values.reshape(-1), from_pandas=True),
                    pa.array(explained * len(rows), pa.float64()),
                    pa.array(np.full(len(each), error)),
                    pa.array(map(str, exact), pa.string()).take(each),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return table.mapInArrow(rows_of, schema)
