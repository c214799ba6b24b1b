"""Token ids in segments of separately compressed documents with one trained dictionary.

A store is a folder of two Parquet tables that any Spark file system can hold: ``dictionary`` (one row: its
SHA-256 and bytes) and ``segments``. A segment holds up to SEGMENT_BYTES of consecutive documents as one binary:

    "TKS1" | dictionary SHA-256 (32 bytes) | count n (u32)
    | n ids of documents (i64) | n flags: id is null (u8) | n counts of tokens (u32) | n+1 frame offsets (u64)
    | n zstandard frames, each the document's token ids as little-endian u32, compressed with the dictionary

Segments carry their first and last id as columns, so one document is read by pushing its id down to the segments
and decompressing its own frame only.

The dictionary is trained on the serialised ids of the SAMPLE_DOCS documents with the smallest seeded keys, of longer
texts on a slice of SAMPLE_CHARS characters (both are parameters); every document is written, whatever its length.

Edge cases: a null or empty text holds the end id only; rows with a null id come first; repeated rows are written
as often as they come; an empty table gives a store without segments. Too few samples give an empty dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import seeded_key, settled, slices, small_batches, whole_text
from jobloom.llm.tokens import WordEncoder, encoder

MAGIC = b"TKS1"
SEGMENT_BYTES = 4 << 20
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1500, 6_000, 64 << 10
SEGMENTS = "part int, segment int, first_id long, last_id long, n_docs long, n_ids long, part_start long, body binary"


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """Dictionary bytes from a bounded sample of documents, of long ones a seeded slice; empty if there are too few."""
    import zstandard

    n = F.length("text")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > 0)
    # Ids are chosen before any text moves; of a long text only a slice at a seeded place does.
    chosen = settled(texts.select("id", seeded_key(seed, F.col("id")).alias("key")).orderBy("key", "id").limit(sample_docs).select("id").distinct())
    start = F.when(n > sample_chars, F.pmod(F.xxhash64("id"), n - sample_chars)).otherwise(0).cast("int")
    rows = texts.join(F.broadcast(chosen), "id", "left_semi").select(F.substring("text", start + 1, F.lit(sample_chars)).alias("text")).take(sample_docs)
    encode = encoder(WordEncoder, vocabulary)
    end = struct.pack("<I", end_id)
    samples = [encode(r["text"]) + end for r in rows]
    total = sum(map(len, samples))
    if len(samples) < 50 or total < 4 * 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(documents: list[tuple[int | None, int, bytes]], digest: bytes) -> bytes:
    """One segment of (id, tokens, frame)."""
    n = len(documents)
    ids = np.array([d[0] or 0 for d in documents], dtype="<i8")
    nulls = np.array([d[0] is None for d in documents], dtype="u1")
    counts = np.array([d[1] for d in documents], dtype="<u4")
    offsets = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(d[2]) for d in documents], out=offsets[1:])
    return b"".join([MAGIC, digest, struct.pack("<I", n), ids.tobytes(), nulls.tobytes(), counts.tobytes(), offsets.tobytes(), *(d[2] for d in documents)])


class Segment:
    """Reads one segment's documents in any order."""

    def __init__(self, body: bytes, dictionary: bytes):
        import zstandard

        if body[:4] != MAGIC:
            raise ValueError("not a segment")
        if body[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        (n,) = struct.unpack_from("<I", body, 36)
        self.ids = np.frombuffer(body, "<i8", n, 40)
        self.nulls = np.frombuffer(body, "u1", n, 40 + 8 * n)
        self.counts = np.frombuffer(body, "<u4", n, 40 + 9 * n)
        self.offsets = np.frombuffer(body, "<u8", n + 1, 40 + 13 * n)
        self.body, self.base = memoryview(body), 40 + 13 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> bytes:
        """The i-th document's ids as little-endian u32."""
        at, to = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        return self.reader.decompress(self.body[at:to], max_output_size=4 * int(self.counts[i]))

    def find(self, doc_id: int) -> list[int]:
        """Places of this id."""
        return np.flatnonzero((self.ids == doc_id) & (self.nulls == 0)).tolist()


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents in ascending order of their ids."""
    spark = docs.sparkSession
    small_batches(docs)
    dictionary = train_dictionary(docs, vocabulary, end_id, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encode = encoder(WordEncoder, vocabulary)
        part = TaskContext.get().partitionId()
        writer = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=False)
        held: list[tuple[int | None, int, bytes]] = []
        size = number = before = 0

        def segment():
            ids = sum(d[1] for d in held)
            known = [d[0] for d in held if d[0] is not None]
            values = [part, number, min(known, default=None), max(known, default=None), len(held), ids, before, _pack(held, digest)]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")]), ids

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                held.append((doc_id, len(ids) // 4, writer.compress(ids)))
                size += len(held[-1][2])
                if size >= SEGMENT_BYTES:
                    made, ids_made = segment()
                    yield made
                    held, size, number, before = [], 0, number + 1, before + ids_made
        if held:
            yield segment()[0]

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(write, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    body = bytes(row["body"])
    if hashlib.sha256(body).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return body


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = _dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    # One row a writing task, so no more than the tasks the driver has scheduled itself.
    sums = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment = Segment(body.as_py(), dictionary)
                sums_before = starts[part] + before + np.concatenate([[0], np.cumsum(segment.counts.astype(np.int64))[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.ids, mask=segment.nulls.astype(bool)),
                        pa.array(sums_before, pa.int64()),
                        pa.array(segment.counts.astype(np.int64)),
                        pa.array([zlib.crc32(segment.tokens(i)) for i in range(len(segment))], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("part", "part_start", "body").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this id; only segments that may hold it are read, only its frames decompressed."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/segments").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("body").toLocalIterator()
    found = []
    for row in rows:
        segment = Segment(bytes(row["body"]), dictionary)
        found += [np.frombuffer(segment.tokens(i), "<u4").tolist() for i in segment.find(doc_id)]
    return found
