"""What the training-data operators share: cutting lineage, seeded keys, null-safe text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows of a few words each.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch that carries whole texts.
ARROW_ROWS = 500
#: Rows of a batch read from Parquet: with the usual 4,096 one of long texts takes hundreds of MB.
READ_ROWS = 256
#: Bytes of such a batch; a longer single row comes alone.
ARROW_BYTES = "4m"
#: Bits of a seeded key.
KEY_BITS = 60


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share; deleted when the JVM ends.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="jobloom-"))
    folder = context.getCheckpointDir()
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of this run, through the store that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, kept in the shared checkpoint folder so that no lost executor brings them into doubt."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def tabled(frame: DataFrame, path: str) -> DataFrame:
    """The rows of ``frame`` as a table in the shared folder: columns pack several times smaller than a checkpoint's rows."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_batches(frame: DataFrame) -> None:
    """Bounds how many whole texts a task holds at once, in batches read from Parquet and in those sent to Python.

    Spark reads these settings when a plan runs, so they stay for this session; tighter ones are left as they are.
    """
    conf = frame.sparkSession.conf
    for name, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", 4096, READ_ROWS)):
        rows = int(conf.get(name, str(usual)))
        if rows <= 0 or rows > most:
            conf.set(name, str(most))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that none of ``taken`` equals, whatever the case."""
    have = {c.lower() for c in taken}
    found = []
    for name in names:
        n = 0
        while (new := f"{name}_{n}") in have:
            n += 1
        have.add(new)
        found.append(new)
    return found


#: Bits of a bitmap for each key in it, and most bits of one (32 MB, so bounded wherever it is sent).
BITS_A_KEY, MOST_BITS = 16, 1 << 28


def apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` (long) may be among ``keys`` (settled, one long column), and rows whose key certainly is not.

    A bitmap with a size from the counted keys is broadcast in pieces of 4 KB, so only rows it lets through need
    to be shuffled to meet ``keys`` exactly; one key in about BITS_A_KEY gets through by chance. With more keys than
    a bitmap of MOST_BITS can tell apart all rows are of the first kind.
    """
    n = keys.count()
    if n == 0:
        return rows.filter(F.lit(False)), rows
    bits = max(1 << 15, 1 << (BITS_A_KEY * n - 1).bit_length())
    if bits > 8 * MOST_BITS:
        return rows, rows.filter(F.lit(False))
    bits = min(bits, MOST_BITS)
    slot_name, piece_name, bits_name = fresh(rows.columns, "slot", "piece", "bits")
    slot = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    pieces = settled(keys.select(slot.alias(slot_name)).groupBy(F.shiftright(slot_name, 15).alias(piece_name)).agg(F.bitmap_construct_agg(F.col(slot_name) % 32768).alias(bits_name)))
    marked = rows.withColumn(slot_name, F.pmod(key, F.lit(bits)))
    of = F.shiftright(slot_name, 15)
    joined = marked.join(F.broadcast(pieces), of == F.col(piece_name), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits_name), F.shiftright(F.col(slot_name) % 32768, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(slot_name) % 8).cast("int")) == 1, F.lit(False))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return joined.filter(hit).select(*kept), joined.filter(~hit).select(*kept)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def seeded_key(seed: int, *columns: Column) -> Column:
    """A number of KEY_BITS bits, the same for the same seed and values on every run."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))
    return F.conv(F.substring(hashed, 1, KEY_BITS // 4), 16, 10).cast("long")


def small_or_joined(side: DataFrame) -> DataFrame:
    """``side`` marked for broadcast if its counted rows are few, else as it is."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def given_back() -> None:
    """Hands memory that this worker no longer uses back to the system: reused workers would keep it for their life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most_bytes`` at most; a longer single row comes alone. After the last one
    free memory is given back."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and held + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)
    given_back()
