"""Tables of vectors as Arrow columns and numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import shared_path, tabled

#: Rows of a matrix that a task works on at once.
SLICE_ROWS = 4096


def whole(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which rows have a vector without null or non-finite entries, and those rows."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    kept = pc.is_valid(column).to_numpy(zero_copy_only=False)
    kept[pc.list_parent_indices(column).to_numpy()[~np.isfinite(flat)]] = False
    return kept, column.filter(pa.array(kept))


def integer_vectors(frame: DataFrame, scale: int, most: int, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, int]:
    """A table of vec_id, label (if asked for) and x, floor(scale * entry) of each vector that has no null or non-finite
    entry, and the length of the longest. Integers saturate at ``most`` on either side."""
    names = {"vec_id": id_col} | ({"label": label_col} if label_col else {})
    read = frame.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()), F.col(f"`{vector_col}`").alias("x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:-1]) + ", x array<bigint>"

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vectors = whole(batch.column(batch.num_columns - 1))
            flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy())]).astype(np.int32)
            others = [c.filter(pa.array(kept)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*others, pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=[*names, "x"])

    table = tabled(read.mapInArrow(floors, schema), shared_path(frame.sparkSession, "vectors"))
    return table, table.agg(F.max(F.size("x"))).first()[0] or 0


def matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, each with its column x as a matrix of ``length`` columns; shorter vectors end in zeros."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            column = part.column(part.schema.get_field_index("x"))
            lengths = pc.list_value_length(column).to_numpy()
            rows = np.zeros((part.num_rows, length), np.int64)
            rows[np.arange(length) < lengths[:, None]] = column.flatten().to_numpy()
            yield part, rows
