"""MPEG audio columns: building, resynchronising, and indexing elementary streams.

``parse_stream`` reads any MPEG-1/2/2.5 stream, Layer I to III: it skips ID3v2 tags, finds frame headers and, after
damage, the next header that is followed by an agreeing one (a frame whose checksum is wrong and whose end meets no
agreeing header is damage too); it reads Xing/Info tables and the counts of VBRI headers, verifies the
checksum of protected Layer III frames, and returns the exact duration and each frame's byte offset and sample.

Payloads are stored losslessly in the main-data area of protected MPEG-2 Layer III mono frames of 576 samples
(144 kbit/s, 16 kHz: 648 bytes, of which 576 hold payload), behind an ID3v2 tag and an Info frame with the counts
and seek table, so any parser finds the structure and the payload is read back byte for byte.

Edge cases: a null or empty text is one frame of padding; equal texts give equal streams; rows keep their ids, null
or repeated; an empty table gives an empty result. Streams without a frame have duration 0. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import shared_path, slices, small_batches, whole_text

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz by version
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}

UNIT, FRAME, SIDE = 576, 648, 9
#: Sync, MPEG-2, Layer III, protected; 144 kbit/s, 16 kHz, no padding; mono.
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])
BODY = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return table


_TABLE = _crc_table()


@lru_cache(4096)
def checksum(protected: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    value = 0xFFFF
    for byte in protected:
        value = (value << 8 & 0xFFFF) ^ _TABLE[value >> 8 ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padded: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != "1" else 1152

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbits // self.hertz + self.padded) * 4
        return self.samples // 8 * self.kbits * 1000 // self.hertz + self.padded

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


@lru_cache(65536)
def read_header(raw: bytes) -> Header | None:
    """The header in four bytes; None if they hold none or a free-format one."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(raw[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(raw[1] >> 1 & 3)
    rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer is None or rate in (0, 15) or hz == 3:
        return None
    return Header(version, layer, not raw[1] & 1, KBITS[version == "1", layer][rate], HERTZ[version][hz], raw[2] >> 1 & 1, raw[3] >> 6 == 3)


@dataclass
class Stream:
    tag_bytes: int = 0
    title: str = ""
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: bytes = b""
    hertz: int = 0
    samples: int = 0
    skipped: int = 0
    checked: int = 0
    broken: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0

    def seek(self, second: float) -> int | None:
        """The offset of the frame that sounds at this time, for constant frame lengths in samples."""
        if not self.offsets or not 0 <= second < self.seconds:
            return None
        return self.offsets[int(second * self.hertz * len(self.offsets) // self.samples)]


def _tag(data: memoryview) -> tuple[int, str]:
    """Size and title of an ID3v2 tag at the start."""
    if bytes(data[:3]) != b"ID3" or len(data) < 10:
        return 0, ""
    size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    title, at, end = "", 10, min(10 + size, len(data))
    while at + 10 <= end and data[at]:
        name = bytes(data[at : at + 4])
        length = int.from_bytes(data[at + 4 : at + 8], "big") if data[3] == 3 else sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        if name == b"TIT2" and length > 1:
            title = bytes(data[at + 11 : at + 10 + length]).decode("latin-1", "replace")
        at += 10 + length
    return min(10 + size + 10 * bool(data[5] & 0x10), len(data)), title


def _agrees(other: Header | None, h: Header) -> bool:
    return other is not None and (other.version, other.layer, other.hertz) == (h.version, h.layer, h.hertz)


def _next_header(data: memoryview, whole: bytes, at: int) -> int:
    """The next place with a header whose frame ends at another header of its kind or at the end; len if none."""
    while (at := whole.find(b"\xff", at)) >= 0:
        h = read_header(whole[at : at + 4])
        if h and h.length:
            after = at + h.length
            other = read_header(whole[after : after + 4]) if after < len(whole) else h
            if after <= len(whole) and (_agrees(other, h) or whole[after : after + 3] == b"TAG"):
                return at
        at += 1
    return len(whole)


def parse_stream(whole: bytes) -> Stream:
    """Structure of a stream; see the module's docstring."""
    found = Stream()
    data = memoryview(whole)
    found.tag_bytes, found.title = _tag(data)
    at, end = found.tag_bytes, len(whole)
    first = True
    while at < end:
        h = read_header(whole[at : at + 4])
        if h is None or not h.length or at + h.length > end:
            if whole[at : at + 3] == b"TAG" and end - at == 128:
                break
            to = _next_header(data, whole, at + 1)
            found.skipped += to - at
            at = to
            continue
        if first:
            first = False
            found.hertz = h.hertz
            place = at + 4 + 2 * h.protected + h.side
            kind = whole[place : place + 4]
            if h.layer == 3 and kind in (b"Xing", b"Info"):
                (flags,) = struct.unpack_from(">I", whole, place + 4)
                place += 8
                if flags & 1:
                    (found.declared_frames,) = struct.unpack_from(">I", whole, place)
                    place += 4
                if flags & 2:
                    (found.declared_bytes,) = struct.unpack_from(">I", whole, place)
                    place += 4
                if flags & 4:
                    found.toc = whole[place : place + 100]
                at += h.length
                continue
            if whole[at + 36 : at + 40] == b"VBRI":
                found.declared_bytes, found.declared_frames = struct.unpack_from(">II", whole, at + 46)
                at += h.length
                continue
        if h.protected and h.layer == 3:
            wrong = checksum(whole[at + 2 : at + 4] + whole[at + 6 : at + 6 + h.side]) != int.from_bytes(whole[at + 4 : at + 6], "big")
            after = at + h.length
            if wrong and after < end and not _agrees(read_header(whole[after : after + 4]), h):
                to = _next_header(data, whole, at + 1)  # neither its checksum nor what follows speaks for a frame
                found.skipped += to - at
                at = to
                continue
            found.checked += 1
            found.broken += wrong
        found.offsets.append(at)
        found.lengths.append(h.length)
        found.samples += h.samples
        at += h.length
    return found


def store_payload(payload: bytes) -> bytes:
    """The stream that holds a payload of a positive multiple of UNIT bytes."""
    units = len(payload) // UNIT
    side = bytes(SIDE)
    head = HEADER + struct.pack(">H", checksum(HEADER[2:] + side)) + side
    frames = np.zeros((units, FRAME), dtype=np.uint8)
    frames[:, :BODY] = np.frombuffer(head, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    title = f"payload of {len(payload)} bytes".encode()
    text = b"\x00" + title
    entry = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    tag = b"ID3\x03\x00\x00" + bytes(len(entry) >> s & 0x7F for s in (21, 14, 7, 0)) + entry
    total = (units + 1) * FRAME
    table = bytes(min(255, 256 * i // 100) for i in range(100))
    info = (head + b"Info" + struct.pack(">III", 7, units, total) + table).ljust(FRAME, b"\0")
    return tag + info + frames.tobytes()


def read_payload(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stored stream, from the frames that parsing finds."""
    stream = stream or parse_stream(media)
    if not stream.offsets:
        return b""
    low, n = stream.offsets[0], len(stream.offsets)
    if stream.offsets[-1] - low == (n - 1) * FRAME and not stream.skipped:
        frames = np.frombuffer(media, np.uint8, n * FRAME, low).reshape(n, FRAME)
        return frames[:, BODY : BODY + UNIT].tobytes()
    return b"".join(media[o + BODY : o + BODY + UNIT] for o in stream.offsets)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a stream."""
    small_batches(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                sizes.append(len(raw))
                media.append(store_payload(raw + b"\xff" * ((-len(raw)) % UNIT or UNIT * (not raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(build, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each whole text's stream to a Parquet folder and gives the rows read back from it.

    Storing and reading are separate stages, so a task holds one Python worker; row groups are kept small because
    every task buffers one of streams.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "media")
    with_media(docs, id_col, text_col).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored streams back: payload digests, stream digests and structure."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            rows = []
            for cell in batch.column(2):
                whole = cell.as_py()
                stream = parse_stream(whole)
                payload = read_payload(whole, stream)
                seek = zlib.crc32(np.array(stream.offsets, dtype="<u8").tobytes())
                feature = f"frames={len(stream.offsets)};declared={stream.declared_frames};samples={stream.samples};hz={stream.hertz};crc_ok={stream.checked - stream.broken};skipped={stream.skipped};seek_crc32={seek}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature, stream.seconds, stream.offsets))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)
