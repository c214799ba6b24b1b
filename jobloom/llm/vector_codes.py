"""Codes of vectors by the nearest entry of a small codebook for each of their parts.

The integers of a vector are cut into equal parts, and each part's codebook is fitted in a fixed number of rounds; a
round is one pass of Spark that sums parts by their nearest entry within tasks, so only those sums are shuffled and
only the codebooks (as many integers as ENTRIES vectors) reach the driver.

The nearest entry is found by segment-mean lower bounds. With a part cut into blocks of m places,

    |x - c|^2 >= sum over blocks of (sum x - sum c)^2 / m + (|x - mean x| - |c - mean c|)^2,

first with one block, then two, four and so on. An entry whose bound is above the distance of an entry already
measured can't be nearest; bounds are lowered by a slack thousands of times the rounding of doubles, so no entry is
lost by it. The entries left get their exact integer distance, and of equal ones the lowest index is taken.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped; components beyond 65,536
on either side count as that. Shorter vectors than the longest, and lengths that aren't a multiple of the parts, are
filled with zeros, which adds nothing to a distance. Null ids come last in the order that starts the codebook, equal
ids by their integers; with fewer rows than entries the codebook is as small. Equal labels share a sum, nulls too. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import BROADCAST_ROWS, settled, shared_path, tabled
from jobloom.llm.vectors import integer_vectors, matrices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers saturate here: sums and products of a part then stay within 64 bits.
MOST = 1 << 28
SLACK = 1e-12
#: A label with more than one in so many rows is met by broadcast.
FREQUENT = 1024


def outlines(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Coarse to fine: sums and residual norms of blocks, and the length of a block."""
    n, width = x.shape
    found, blocks = [], 1
    while blocks == 1 or (blocks < width and width % blocks == 0):
        m = width // blocks
        cut = x.reshape(n, blocks, m)
        sums = cut.sum(2)
        found.append((sums.astype(np.float64), np.sqrt((m * (cut * cut).sum(2) - sums * sums) / m), m))
        blocks *= 2
    return found


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of ``book`` for each row, and how many pairs were measured."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    slack = SLACK * ((x * x).sum(1)[:, None] + (book * book).sum(1)[None, :]).astype(np.float64)
    levels = list(zip(outlines(x), outlines(book), strict=True))
    (sums, norms, m), (their_sums, their_norms, _) = levels[0]
    low = (sums - their_sums.T) ** 2 / m + (norms - their_norms.T) ** 2 - slack
    best = _distances(x, book[low.argmin(1)])
    rows, entries = np.nonzero(low <= best[:, None])
    for (sums, norms, m), (their_sums, their_norms, _) in levels[1:]:
        low = ((sums[rows] - their_sums[entries]) ** 2 / m + (norms[rows] - their_norms[entries]) ** 2).sum(1) - slack[rows, entries]
        left = low <= best[rows]
        rows, entries = rows[left], entries[left]
    # The entry measured first is among those left, so every row has one; rows and entries ascend.
    found = _distances(x[rows], book[entries])
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(found, starts)
    index = np.minimum.reduceat(np.where(found == least[rows], entries, len(book)), starts)
    return index, least, len(x) + len(rows)


def _first_book(table: DataFrame, entries: int, parts: int, width: int) -> np.ndarray:
    """(part, entry, place) from the vectors of the smallest ids."""
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    book = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        book[i, : len(row["x"])] = row["x"]
    return book.reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def _next_book(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = book.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, rows in matrices(batches, parts * width):
            for p in range(parts):
                x = rows[:, p * width : (p + 1) * width]
                index, _, _ = nearest(x, book[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, x)
        p, e = np.nonzero(counts)
        places = np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(np.repeat(counts[p, e], width)), pa.array(sums[p, e].reshape(-1))],
            names=["part", "entry", "place", "n", "total"],
        )

    sums = table.select("x").mapInArrow(totals, "part int, entry int, place int, n bigint, total bigint")
    updated = book.copy()
    # At most as many rows as the codebooks have integers.
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        updated[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return updated


def fitted(table: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, place) for a table of integer vectors."""
    book = _first_book(table, entries, parts, -(-length // parts))
    for _ in range(rounds if book.size else 0):
        book = _next_book(table, book)
    return book


def coded(table: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code, error for a table of integer vectors."""
    parts, _, width = book.shape
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "x")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in matrices(batches, parts * width):
            found = [nearest(rows[:, p * width : (p + 1) * width], book[p]) for p in range(parts)]
            digits = np.stack([index for index, _, _ in found], 1).astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            error = np.sum([least for _, least, _ in found], 0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n != "x"), pa.array(code, pa.string()), pa.array(error)], names=[*(n for n in batch.schema.names if n != "x"), "code", "error"])

    return table.mapInArrow(codes, f"{kinds}, code string, error bigint")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of equal labels summed.

    Frequent labels, of which there are FREQUENT at most, are met by broadcast; all others are too rare to load one task.
    """
    labels = settled(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("label_rows")).withColumnRenamed("label", "label_of"))
    same = F.col("label").eqNullSafe(F.col("label_of"))
    if labels.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(labels), same).drop("label_of", "label_rows")
    least = labels.agg(F.sum("label_rows")).first()[0] / FREQUENT
    met = rows.join(F.broadcast(labels.filter(F.col("label_rows") > least)), same, "left")
    rest = met.filter("label_error is null").select(*rows.columns).join(labels.filter(F.col("label_rows") <= least), same)
    return met.filter("label_error is not null").unionByName(rest).drop("label_of", "label_rows")


def vector_codes(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each whole vector: vec_id, code, error, label_error, codebooks_sha256."""
    table, length = integer_vectors(frame, SCALE, MOST, id_col, vector_col, label_col)
    book = fitted(table, length)
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    rows = tabled(coded(table, book), shared_path(frame.sparkSession, "codes"))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Assignment to the codebook of round ``i`` and the codebook after it."""
    return f"""
d{i} AS MATERIALIZED (
  SELECT rn, part, entry, error FROM (
    SELECT *, row_number() OVER (PARTITION BY rn, part ORDER BY error, entry) AS r
    FROM (SELECT rn, e.part, entry, sum((x - v) * (x - v))::BIGINT AS error FROM e JOIN b{i} ON e.part = b{i}.part AND e.place = b{i}.place GROUP BY ALL)
  ) WHERE r = 1
), b{i + 1} AS MATERIALIZED (
  SELECT b{i}.part, b{i}.entry, b{i}.place, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, v) AS v
  FROM b{i} LEFT JOIN (
    SELECT e.part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN d{i} ON e.rn = d{i}.rn AND e.part = d{i}.part GROUP BY ALL
  ) t ON t.part = b{i}.part AND t.entry = b{i}.entry AND t.place = b{i}.place
),"""


ORACLE_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rn, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS MATERIALIZED (
  SELECT rn, i // (len // {PARTS}) AS part, i % (len // {PARTS}) AS place, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT rn, embedding, len(embedding) AS len, unnest(range(len(embedding))) AS i FROM k)
), b0 AS MATERIALIZED (
  SELECT part, rn - 1 AS entry, place, x AS v FROM e WHERE rn <= {ENTRIES}
), {"".join(_round_sql(i) for i in range(ROUNDS + 1))}
c AS MATERIALIZED (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM d{ROUNDS} GROUP BY rn
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN k USING (rn)
"""
