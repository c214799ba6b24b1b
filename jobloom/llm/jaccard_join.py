"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles, as 64-bit hashes; hashes only find candidates, links are
verified on the words themselves. Under one order of all shingles (rarer
classes first, then by bits of the hash), two sets of Jaccard similarity t or more share at least k of their first
n - ceil(t*n) + k shingles, for every k up to ceil(t*n). Each document's k grows with the estimated cost of its
candidates (how many its prefix would meet, times its size); a pair needs min(k, k') shared prefix shingles before it
is verified.

The work is kept linear where groups are large:

1. Classes of frequency come from counts over all documents, kept in bitmaps of fixed size. (Each task counts its
   own documents and passes on shingles it met twice; a shingle's class only affects speed, never the result.)
2. Documents with equal words become one representative.
3. Shingles that no other representative of a similar size has in its prefix go before anything is shuffled for
   pairs: tasks send packed parts of hashes by range, and what two sent comes back as a bitmap sized from their number. Where that
   would pass MOST_BITS every shingle goes on, with the same result. Texts are shuffled for verification only if a
   pair names them that its sets' parity sketches don't rule out.
4. A round of stars: each member of a shingle's list is verified against one centre, a member most like the rest of
   some list they share, that of most shared lists. Verified links make components; lists whose members are all in
   one component are done.
5. What is left is exact: every pair of members of different components in a list that shares enough prefix
   shingles, and whose places in the prefixes and parity marks leave room for enough more, is verified. Pairs inside
   a component can't change it. No link between components is lost. Of each pair only the shingles within the prefix
   that its two sizes allow count, and of shingles shared in a run only the run's ends make a row.

Edge cases: a null, empty or blank text has an empty set and stays alone; with fewer than five words the whole
sequence is the one shingle; repeated rows are equal sets. Rows are told apart by their place, so ids may repeat with
different texts: each such row has its own set and links, and a component goes by the smallest id of its rows. Rows
with a null id link like others; a component of such rows alone is null. Very long texts are hashed in blocks. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import MOST_BITS, apart, dropped, fresh, given_back, settled, shared_path, slices, small_batches, small_or_joined, tabled

WIDTH = 5
#: Document counts from which a shingle is of class 1, 2 and 3. They double while more shingles than an eighth of
#: a bitmap's bits reach class 1, so that the bitmaps stay sparse however large the corpus is.
CLASSES = (32, 512, 8192)
#: Bits of each of the classes' bitmaps (4 MB each); false bits only put a shingle in a higher class.
MAP_BITS = 1 << 25
#: Most shared prefix shingles asked for.
MOST_MATCHES = 12
#: 64-bit words of a set's marks.
MARK_WORDS = 4
#: Sets of more shingles carry no marks: these would be too full to tell anything.
MARKED = 500
#: Members from which on a shingle's list is long.
LONG = 64
#: Bytes of text that are hashed at once.
BLOCK = 4 << 20
#: Prefix shingles that a range of hashes holds on average, and that a task sorts at once.
RANGE, SORTED = 1 << 20, 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = [np.uint64(pow(int(_P), 2 * k + 1, 1 << 64)) for k in range(WIDTH)]
#: What stays of eight bytes of which the first 0 to 8 belong to a word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The lower-cased words of some texts in a row: ``hashes`` and ``lengths`` of each, its bytes in eights from
    ``eights[first]`` on, and the place of the first word of each text in ``bounds`` (one more than texts)."""

    hashes: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    eights: np.ndarray
    bounds: np.ndarray


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, hashes, lengths, firsts and eights of the words of a block of bytes; none goes across a place of ``cuts``.

    A word's hash is a scrambled sum of scrambles of its eights, each keyed by its place.
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = cuts[cuts < n]
    begins[at] = inside[at]
    at = cuts[cuts > 0] - 1
    ends[at] = inside[at]
    starts, lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths -= starts
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    padded[:n][(data >= 65) & (data <= 90)] += 32
    every = np.ndarray((n + 1,), "<u8", buffer=padded, strides=(1,))
    many = (lengths + 7) >> 3
    after = np.cumsum(many)
    first = after - many
    total = int(after[-1]) if len(after) else 0
    nth = np.arange(total) - np.repeat(first, many)
    at = np.repeat(starts, many) + 8 * nth
    eights = every[at] & _FIRST_BYTES[np.minimum(np.repeat(lengths, many) - 8 * nth, 8)]
    scrambled = _mixed(eights ^ _mixed((nth + 1).astype(np.uint64) * _P))
    sums = np.add.reduceat(scrambled, first) if total else np.zeros(0, np.uint64)
    return starts, _mixed(sums + lengths.astype(np.uint64)), lengths, first, eights


def words_of(texts: pa.Array) -> Words:
    """The words of whole texts, hashed in blocks that end at a blank or at a text's end."""
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1] if rows else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if rows else None
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    parts, bounds, at, words, held = [], np.zeros(rows + 1, np.int64), 0, 0, 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data) and to not in offsets[np.searchsorted(offsets, to) :][:1]:
            window = data[to : to + BLOCK]
            blank = np.flatnonzero((window == 32) | ((window >= 9) & (window <= 13)))
            ends = offsets[np.searchsorted(offsets, to)]
            if len(blank) or ends <= to + BLOCK:
                to = min(to + int(blank[0]) if len(blank) else len(data), int(ends))
                break
            to = min(to + BLOCK, len(data))
        low, high = np.searchsorted(offsets, at), np.searchsorted(offsets, to, side="right")
        starts, hashes, lengths, first, eights = _words(data[at:to], offsets[low:high] - at)
        bounds[low:high] = words + np.searchsorted(starts, offsets[low:high] - at)
        parts.append((hashes, lengths, first + held, eights))
        words, held, at = words + len(hashes), held + len(eights), to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none.astype(np.uint64), bounds)
    bounds[offsets == len(data)] = words
    return Words(*(c[0] if len(c) == 1 else np.concatenate(c) for c in zip(*parts, strict=True)), bounds)


def _shingles(words: Words) -> np.ndarray:
    """Hashes of all runs of WIDTH words, those across texts included."""
    joint = np.zeros(max(len(words.hashes) - WIDTH + 1, 0), dtype=np.uint64)
    for k in range(WIDTH):
        joint += words.hashes[k : k + len(joint)] * _POWERS[k]
    return _mixed(joint)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of fewer words."""
    whole = len(hashes)
    for w in hashes.tolist():
        whole = ((whole + w) * int(_P) + 7) % (1 << 64)
    return _mixed(np.array([whole], dtype=np.uint64))


def shingle_sets(texts: pa.Array, words: Words | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words or words_of(texts)
    joint = _shingles(words)
    found = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            own = np.sort(joint[a : b - WIDTH + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            found.append(_short(words.hashes[a:b]) if b > a else np.zeros(0, np.uint64))
    return found


def signature(words: Words, i: int) -> bytes:
    """A digest of the i-th text's words: equal for equal sequences of words only."""
    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
    digest = hashlib.blake2b(words.lengths[a:b].tobytes(), digest_size=16)
    if b > a:
        to = int(words.first[b]) if b < len(words.first) else len(words.eights)
        digest.update(words.eights[int(words.first[a]) : to].tobytes())
    return digest.digest()


def _same_words(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> bool:
    """Whether the words at these places are equal one by one."""
    n = x.lengths[i]
    if not np.array_equal(n, y.lengths[j]):
        return False
    a, b, many = x.first[i], y.first[j], (n + 7) >> 3
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.array_equal(x.eights[np.repeat(a, many) + nth], y.eights[np.repeat(b, many) + nth])


def _same_shingles(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> bool:
    return all(_same_words(x, i[at : at + BLOCK // 64] + k, y, j[at : at + BLOCK // 64] + k) for k in range(WIDTH) for at in range(0, len(i), BLOCK // 64))


def _listed(words: Words, i: int, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The i-th text's distinct shingles, the place of each, and whether equal hashes are equal words throughout."""
    a, b = int(words.bounds[i]), int(words.bounds[i + 1]) - WIDTH + 1
    own, place, of = np.unique(joint[a:b], return_index=True, return_inverse=True)
    again = np.flatnonzero(place[of] != np.arange(b - a))
    return own, place + a, _same_shingles(words, again + a, words, place[of[again]] + a)


def _plainly(words: Words, i: int) -> set[tuple]:
    """The i-th text's set by its words alone; for texts in which two shingles have one hash."""
    def word(k: int) -> bytes:
        return int(words.lengths[k]).to_bytes(8, "little") + words.eights[int(words.first[k]) : int(words.first[k]) + (int(words.lengths[k]) + 7 >> 3)].tobytes()

    own = [word(k) for k in range(int(words.bounds[i]), int(words.bounds[i + 1]))]
    return {tuple(own[k : k + WIDTH]) for k in range(max(len(own) - WIDTH + 1, 1))} if own else set()


def least_shared(n: int, percent: int) -> int:
    """ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Shingles met in two documents of one task or more, with how many: (token, n), some in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def counts():
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often], pa.int64())], ["token", "n"])

        for batch in slices(batches, "text", 1 << 20):
            for s in shingle_sets(batch.column(0)):
                waiting.append(s)
                held += len(s)
            if held > 1_000_000:
                yield counts()
                waiting, held = [], 0
        if held:
            yield counts()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "token long, n long")


def frequency_maps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray]:
    """Bitmaps, one a class, of the shingles that are in so many documents; at most 12 MB reach the driver."""
    totals = _counted(docs, id_col, text_col).groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= CLASSES[0])
    classes = F.array(*(F.lit(c) for c in CLASSES))
    bit = F.pmod(F.col("token"), F.lit(MAP_BITS)) + 1
    totals = settled(totals)
    times = 1
    while totals.filter(F.col("n") >= CLASSES[0] * times).count() > MAP_BITS // 8:
        times *= 2
    rows = (
        totals.select(bit.alias("bit"), F.explode(F.filter(classes, lambda c: c * F.lit(times) <= F.col("n"))).alias("class"))
        .groupBy("class", F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
        .collect()
    )
    maps = [np.zeros(MAP_BITS // 8, dtype=np.uint8) for _ in CLASSES]
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        maps[CLASSES.index(row["class"])][at : at + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return maps


def _is_set(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens.view(np.int64) % MAP_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _in(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether a bitmap of a power of two of bits holds the tokens, by their first bits."""
    at = tokens >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _prefix(tokens: np.ndarray, maps: list[np.ndarray], percent: int) -> tuple[np.ndarray, int, int]:
    """Prefix tokens, matches asked for, and how many of all tokens are of a frequent class."""
    level = sum(_is_set(m, tokens).astype(np.int8) for m in maps)
    # Within a class by the lower half first, so that the upper bits of prefixes, which bitmaps go by, are spread evenly.
    order = np.lexsort(((tokens << np.uint64(32)) | (tokens >> np.uint64(32)), level))
    n = len(tokens)
    need = least_shared(n, percent)
    shortest = n - need + 1
    # Candidates that the prefix is estimated to bring, by the lower bound of each shingle's class, times the cost of
    # verifying one. One more match costs one more shingle and is taken to leave a quarter of the candidates.
    cost = n * int(np.array([1, *CLASSES])[level[order[:shortest]]].sum() - shortest + 1)
    matches = 1
    while matches < min(MOST_MATCHES, need) and cost > 4**matches:
        matches += 1
    return tokens[order[: shortest + matches - 1]], matches, int((level > 0).sum())


def _parities(tokens: np.ndarray, slots: int) -> np.ndarray:
    at = (tokens >> np.uint64(20)).astype(np.int64) % slots
    if slots <= 1 << 16:
        return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8))
    odd = np.zeros(slots, dtype=np.uint8)
    np.bitwise_xor.at(odd, at, np.uint8(1))
    return np.packbits(odd)


def _marks(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set over 256 slots; two sets differ in at least as many shingles as their marks do in bits."""
    return _parities(tokens, 64 * MARK_WORDS).view(np.int64)


def _sketch(tokens: np.ndarray) -> bytes:
    """The same parities over a power of two of slots, two a shingle at least; halves laid over each other by
    exclusive or give those over half the slots."""
    return _parities(tokens, max(256, 1 << (2 * len(tokens) - 1).bit_length() if len(tokens) else 0)).tobytes()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of id and text), text (never null): rows equal in id and text are alike."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(own.alias("doc_id"), F.xxhash64(own.isNull(), own, text).alias("mark"), text.alias("text"))


def _prefixes(docs: DataFrame, maps, id_col: str, text_col: str, percent: int) -> DataFrame:
    """row_no, doc_id, mark (see ``_marked``), n, signature (of the words), common (per mille of frequent shingles), matches, prefix (binary), marks, sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", 1 << 20):
            n, signatures, common, matches, prefix, marks, sketch = [], [], [], [], [], [], []
            words = words_of(batch.column(3))
            for i, tokens in enumerate(shingle_sets(batch.column(3), words)):
                n.append(len(tokens))
                marks.append(_marks(tokens) if len(tokens) <= MARKED else None)
                sketch.append(_sketch(tokens))
                signatures.append(signature(words, i))
                if len(tokens):
                    p, k, often = _prefix(tokens, own, percent)
                    common.append(1000 * often // len(tokens))
                    matches.append(k)
                    prefix.append(p.tobytes())
                else:
                    common.append(0)
                    matches.append(0)
                    prefix.append(b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(signatures, pa.binary()), pa.array(common, pa.int32()), pa.array(matches, pa.int32()), pa.array(prefix, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["row_no", "doc_id", "mark", "n", "signature", "common", "matches", "prefix", "marks", "sketch"],
            )

    read = _marked(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "mark", "text")
    return read.mapInArrow(build, "row_no long, doc_id long, mark long, n long, signature binary, common int, matches int, prefix binary, marks array<long>, sketch binary")


def band_edges(percent: int) -> np.ndarray:
    """Least sizes of bands: two sets that are similar enough are of one band or of neighbouring ones."""
    edges = [1]
    while edges[-1] < 1 << 32:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, dtype=np.int64)


def _keyed(tokens: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Hashes of shingles together with a band of sizes."""
    return _mixed(tokens ^ _mixed(bands.astype(np.uint64) * _P))


def _shared_tokens(representatives: DataFrame, percent: int) -> np.ndarray | None:
    """A bitmap of prefix shingles that two representatives have that are not too different in size, and of a few
    others; None if it would be too large.

    Each shingle is sent with the band of its set's size and with the next one, so that sets of neighbouring bands
    meet in one of them. These hashes are dealt into ranges of about RANGE of them; 32 bits behind the range's go to the task that holds it,
    packed as byte planes of their differences.
    """
    total = 2 * (representatives.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0)
    edges_of = band_edges(percent)
    ranges = max(5, int(total // RANGE).bit_length())
    inner = min(32, max(15, (int(total) - 1).bit_length()) + 1 - ranges, MOST_BITS.bit_length() - 1 - ranges)
    if total > 16 * MOST_BITS:
        return None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(waiting):
            tokens = np.sort(np.concatenate(waiting))
            tokens = tokens[np.concatenate([[True] * min(2, len(tokens)), tokens[2:] != tokens[:-2]])]
            of = (tokens >> np.uint64(64 - ranges)).astype(np.int64)
            low = ((tokens >> np.uint64(32 - ranges)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edges = np.searchsorted(of, np.arange((1 << ranges) + 1))
            rows = np.flatnonzero(edges[1:] > edges[:-1])
            planes = [np.diff(low[edges[r] : edges[r + 1]], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for r in rows.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(planes, pa.binary())], ["of", "planes"])

        waiting, held = [], 0
        for batch in batches:
            bands = np.searchsorted(edges_of, np.asarray(batch.column(1)), side="right")
            for prefix, band in zip(batch.column(0), bands, strict=True):
                tokens = np.frombuffer(prefix.as_py(), dtype=np.uint64)
                waiting += [_keyed(tokens, band), _keyed(tokens, band + 1)]
                held += 2 * len(tokens)
                if held > SORTED:
                    yield packed(waiting)
                    waiting, held = [], 0
        if held:
            yield packed(waiting)

    def meet(table: pa.Table) -> pa.Table:
        values = [np.cumsum(np.frombuffer(p.as_py(), dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32) for p in table.column("planes")]
        low = np.sort(np.concatenate(values))
        bits = np.zeros(1 << inner, dtype=np.uint8)
        bits[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - inner)] = 1
        return pa.table({"of": pa.array([table.column("of")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = np.zeros(1 << (ranges + inner - 3), dtype=np.uint8)
    piece = 1 << (inner - 3)
    for row in representatives.select("prefix", "n").mapInArrow(send, "of long, planes binary").groupBy("of").applyInArrow(meet, "of long, bits binary").collect():
        found[row["of"] * piece : (row["of"] + 1) * piece] = np.frombuffer(row["bits"], dtype=np.uint8)
    return found


def _token_bitmap(tokens: DataFrame) -> np.ndarray | None:
    """A bitmap by the first bits of the one column's settled hashes, sized from their count; None if it would be too large."""
    n = tokens.count()
    width = max(15, (16 * n).bit_length())
    if 1 << width > 8 * MOST_BITS:
        return None
    width = min(width, MOST_BITS.bit_length() - 1)
    slot = F.shiftrightunsigned(F.col(tokens.columns[0]), 64 - width)
    rows = tokens.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect()
    found = np.zeros(1 << (width - 3), dtype=np.uint8)
    for row in rows:
        found[row["piece"] * 4096 : row["piece"] * 4096 + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return found


#: Bits of a shingle's place and of its rank in ``at``, matches above them.
AT_BITS = 28


def _entries(representatives: DataFrame, percent: int, shared: np.ndarray | None, only: np.ndarray | None = None, long: np.ndarray | None = None, carried: tuple[str, ...] = (), runs: bool = False) -> DataFrame:
    """One row a prefix shingle that both bitmaps (of ``_shared_tokens`` and of shingles) hold: token, id, n, at
    (matches, place, and shingles before it that ``shared`` lacks) and ``carried`` columns; with ``runs``, before and
    after (its neighbours among the rows of its set), then (the place of that after) and long (whether the bitmap of
    long lists holds the shingle; without one all are)."""
    sent = representatives.sparkSession.sparkContext.broadcast((shared, only, long))
    edges_of = band_edges(percent)
    types = {f.name: f.dataType.simpleString() for f in representatives.schema.fields}
    names = ["token", "id", "n", "at", *carried, *(("before", "after", "then", "long") if runs else ())]
    schema = "token long, id long, n long, at long" + "".join(f", {c} {types[c]}" for c in carried) + (", before long, after long, then int, long boolean" if runs else "")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                prefixes = part.column(0).to_pylist()
                tokens = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
                lengths = np.array([len(p) // 8 for p in prefixes], dtype=np.int64)
                row = np.repeat(np.arange(part.num_rows), lengths)
                begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
                place = np.arange(len(tokens)) - begin
                shared, only, long = sent.value
                keep = np.ones(len(tokens), bool)
                if shared is not None:
                    band = np.searchsorted(edges_of, np.asarray(part.column(2)), side="right")[row]
                    keep = _in(shared, _keyed(tokens, band)) | _in(shared, _keyed(tokens, band + 1))
                alone = np.concatenate([[0], np.cumsum(~keep)])
                lone = alone[:-1] - alone[begin] if len(tokens) else place
                if only is not None:
                    keep &= _in(only, tokens)
                of_row, own, at = row[keep], tokens[keep].view(np.int64), place[keep]
                packed = (np.asarray(part.column(3)).astype(np.int64)[of_row] << 2 * AT_BITS) | (at << AT_BITS) | lone[keep]
                taken = pa.array(of_row)
                columns = [pa.array(own), part.column(1).take(taken), part.column(2).take(taken), pa.array(packed, pa.int64()), *(part.column(4 + i).take(taken) for i in range(len(carried)))]
                if runs:
                    edge = np.concatenate([[True], of_row[1:] != of_row[:-1], [True]]) if len(own) else np.ones(1, bool)
                    columns.append(pa.array(np.concatenate([[0], own[:-1]]) if len(own) else own, pa.int64(), mask=edge[:-1]))
                    columns.append(pa.array(np.concatenate([own[1:], [0]]) if len(own) else own, pa.int64(), mask=edge[1:]))
                    columns.append(pa.array(np.concatenate([at[1:], at[:1]]).astype(np.int32), pa.int32(), mask=edge[1:] if len(own) else None))
                    columns.append(pa.array(_in(long, tokens[keep]) if long is not None else np.ones(len(own), bool)))
                yield pa.RecordBatch.from_arrays(columns, names)
        given_back()

    return representatives.select("prefix", "id", "n", "matches", *carried).mapInArrow(spread, schema)


def _unpacked(frame: DataFrame, prefix: str = "") -> DataFrame:
    """``at`` as matches, pos and lone."""
    at, low = F.col(f"{prefix}at"), (1 << AT_BITS) - 1
    return frame.withColumns({f"{prefix}matches": F.shiftright(at, 2 * AT_BITS), f"{prefix}pos": F.shiftright(at, AT_BITS).bitwiseAND(low), f"{prefix}lone": at.bitwiseAND(low)}).drop(f"{prefix}at")


def _reachable(x: str, y: str, percent: int):
    """Whether two sets that share the shingle at these places can still be similar enough.

    What they share up to there is at most what either has before it that another prefix has as well, and that one;
    behind it, at most what the shorter rest holds.
    """
    most = F.least(F.col(f"{x}pos") - F.col(f"{x}lone"), F.col(f"{y}pos") - F.col(f"{y}lone")) + 1 + F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos")) - 1
    return _enough(most, x, y, percent)


def _enough(shared, x: str, y: str, percent: int):
    return shared * (100 + percent) >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))


def _within(place: str, x: str, y: str, percent: int):
    """Whether these places are so early that a pair of these sizes that is similar enough shares as many shingles as
    asked up to here."""
    both = F.col(f"{x}n") + F.col(f"{y}n")
    least = F.ceil(percent * both / (100 + percent)) - F.least(f"{x}matches", f"{y}matches")
    return (F.col(f"{x}{place}") < F.col(f"{x}n") - least) & (F.col(f"{y}{place}") < F.col(f"{y}n") - least)


def _alike(x: str, y: str, percent: int):
    """Whether two sets can be similar enough as far as their marks tell how many shingles they differ in."""
    differ = sum(F.bit_count(F.get(f"{x}marks", F.lit(i)).bitwiseXOR(F.get(f"{y}marks", F.lit(i)))) for i in range(MARK_WORDS))
    both = F.col(f"{x}n") + F.col(f"{y}n")
    return differ.isNull() | ((both - differ) * (100 + percent) >= 2 * percent * both)


def _paired(joined: DataFrame, x: str, y: str, percent: int, runs: bool = False) -> DataFrame:
    """a, b, shared: pairs of rows joined by a shingle that share enough of their prefixes and can be similar enough.

    Joined rows are reachable and within (see there). With ``runs``, each pair is joined by every shingle that both prefixes have. Then a row whose neighbours on both
    sides are shared too says nothing new: only the ends of such runs stay, and their ranks give the number shared.
    Within a run ``_reachable`` can only turn from true to false, and a false one rules the pair out, so a pair of
    which a run's first row is left without its last goes.
    """
    shared, whole = F.count(F.lit(1)), F.lit(True)
    if runs:
        begins = ~F.coalesce(F.col(f"{x}before") == F.col(f"{y}before"), F.lit(False))
        ends = ~F.coalesce((F.col(f"{x}after") == F.col(f"{y}after")) & _within("then", x, y, percent), F.lit(False))
        joined = joined.filter(begins | ends)
        rank = F.col(f"{x}pos") - F.col(f"{x}lone")
        shared = F.sum(F.when(ends, rank + 1).otherwise(0) - F.when(begins, rank).otherwise(0))
        whole = F.sum(begins.cast("int")) == F.sum(ends.cast("int"))
    sums = joined.groupBy(F.col(f"{x}id").alias("a"), F.col(f"{y}id").alias("b")).agg(
        shared.alias("shared"),
        whole.alias("whole"),
        F.first(F.least(f"{x}matches", f"{y}matches")).alias("asked"),
        F.first(f"{x}n").alias("xn"),
        F.first(f"{y}n").alias("yn"),
        F.max(f"{x}pos").alias("xlast"),
        F.max(f"{y}pos").alias("ylast"),
    )
    return sums.filter(F.col("whole") & (F.col("shared") >= F.col("asked")) & _enough(F.col("shared") + F.least(F.col("xn") - F.col("xlast"), F.col("yn") - F.col("ylast")) - 1, "x", "y", percent)).select("a", "b", "shared")


def _named(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose id ``pairs`` name, and few others, so that only they are shuffled."""
    ids = settled(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().select(F.xxhash64("id").alias("key")))
    return apart(rows, F.xxhash64("id"), ids)[0]


def _screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out; two sets differ in at least as many shingles as these do
    in bits. ``sketches``: id, n, sketch."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (np.asarray(batch.column(2)) + np.asarray(batch.column(3))).tolist()
            keep = []
            for total, x, y in zip(both, batch.column(4), batch.column(5), strict=True):
                x, y = sorted((np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y)), key=len)
                differ = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())
                keep.append((total - differ) * (100 + percent) >= 2 * percent * total)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    pairs = settled(pairs)
    sketches = _named(sketches, pairs)
    of_a = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    of_b = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(screen, "a long, b long")


def _linked(x: Words, i: int, of_x: tuple, y: Words, j: int, of_y: tuple, percent: int) -> bool:
    """Whether two texts' sets are similar enough, equal hashes held against the words they stand for."""
    (own_x, at_x, clean_x), (own_y, at_y, clean_y) = of_x, of_y
    both, a, b = np.intersect1d(own_x, own_y, assume_unique=True, return_indices=True)
    if 100 * len(both) < percent * (len(own_x) + len(own_y) - len(both)) and clean_x and clean_y:
        return False
    if clean_x and clean_y and _same_shingles(x, at_x[a], y, at_y[b]):
        return True
    left, right = _plainly(x, i), _plainly(y, j)
    return 100 * len(left & right) >= percent * len(left | right)


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, by their words; ``rows`` are marked documents.

    ``sets`` name a row of each representative by id and mark. Representatives of fewer than WIDTH words never are: their sequences differ.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = last_words = last_set = None
        for batch in slices(batches, "text_b", 1 << 20):
            for part in slices(iter([batch]), "text_a", 2 << 20):
                words = words_of(part.column(3))
                joint, size = _shingles(words), np.diff(words.bounds)
                keep = []
                for i, x in enumerate(part.column(0).to_pylist()):
                    if x != last or last_words is None:
                        last, last_words = x, words_of(part.column(2).slice(i, 1))
                        last_set = _listed(last_words, 0, _shingles(last_words)) if last_words.bounds[1] >= WIDTH else None
                    keep.append(last_set is not None and size[i] >= WIDTH and _linked(last_words, 0, last_set, words, i, _listed(words, i, joint), percent))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    pairs = settled(pairs)
    named = _named(sets.select("id", "of", "mark"), pairs)
    for x in ("a", "b"):
        pairs = pairs.join(named.select(*(F.col(c).alias(f"{x}_{c}") for c in ("of", "mark")), F.col("id").alias(x)), x)
    pairs = settled(pairs)
    marks = settled(pairs.select(F.col("a_mark").alias("mark")).union(pairs.select("b_mark")).distinct())
    likely = apart(rows.select("mark", _of().alias("of"), "text"), F.col("mark"), marks)[0]
    # Rows equal in id and text come once.
    texts = likely.groupBy("mark", "of").agg(F.first("text").alias("text"))
    with_b = pairs.join(texts.select(F.col("mark").alias("b_mark"), F.col("of").alias("b_of"), F.col("text").alias("text_b")), ["b_mark", "b_of"])
    with_both = with_b.join(texts.select(F.col("mark").alias("a_mark"), F.col("of").alias("a_of"), F.col("text").alias("text_a")), ["a_mark", "a_of"])
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id reachable, for every id in ``links`` (a, b).

    Each round takes the smallest label among neighbours and then the label of that label; labels are settled in
    the checkpoint folder after each round, and the loop ends when none changed.
    """
    edges = settled(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = settled(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("id"), "label"))
    while True:
        near = edges.join(labels.select(F.col("id").alias("y"), F.col("label").alias("theirs")), "y").groupBy(F.col("x").alias("id")).agg(F.min("theirs").alias("least"))
        nearer = labels.join(near, "id").select("id", "label", F.least("label", "least").alias("next"))
        jumped = settled(
            nearer.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next", "left").select("id", "label", F.coalesce("far", "next").alias("far")).select("id", F.least("label", "far").alias("now"), "label")
        )
        labels = jumped.select("id", F.col("now").alias("label"))
        if not jumped.filter("now < label").head(1):
            return labels


def _of():
    """An id that is never null, to be met together with a mark."""
    return F.coalesce("doc_id", F.lit(-1).cast("long"))


def _representatives(heavy: DataFrame, narrow: DataFrame, sets: DataFrame) -> DataFrame:
    """id, n, common, matches, prefix, marks, sketch of one row for each set of words, its first.

    Only rows that a bitmap of the others lets through are shuffled.
    """
    more = settled(narrow.filter("n > 0").join(sets.select("signature", "id"), "signature").filter("row_no != id").select("row_no"))
    columns = ["id", "n", "common", "matches", "prefix", "marks", "sketch"]
    maybe, others = apart(heavy.filter("n > 0").withColumnRenamed("row_no", "id"), F.xxhash64("id"), more.select(F.xxhash64("row_no").alias("key")))
    return others.select(columns).union(maybe.join(more, F.col("id") == F.col("row_no"), "left_anti").select(columns))


def _remaining(rest: DataFrame, open_lists: DataFrame, percent: int, path: str) -> DataFrame:
    """a, b: pairs of members of different components of a list that share enough of their prefixes.

    Short lists meet themselves. In a long one, members of its main component, that of most members, meet the others
    and never their own.
    """
    sides = ("id", "n", "at", "component", "before", "after", "then", "marks")
    named = lambda frame, x: frame.select("token", *(F.col(c).alias(f"{x}_{c}") for c in sides))
    flat = ("id", "n", "matches", "pos", "lone", "before", "after", "then")

    def likely(met: DataFrame) -> DataFrame:
        met = _unpacked(_unpacked(met, "l_"), "r_").filter("l_component != r_component")
        return met.filter(_within("pos", "l_", "r_", percent) & _reachable("l_", "r_", percent)).filter(_alike("l_", "r_", percent))

    short = rest.filter(~F.col("long"))
    met = likely(named(short, "l").join(named(short, "r"), "token").filter("l_id < r_id"))
    ordered = met.select(*(F.col(f"{b}_{c}").alias(f"{to}_{c}") for to, b in (("x", "l"), ("y", "r")) for c in flat))

    right = tabled(rest.filter("long").join(open_lists, "token").filter("component != main").drop("members"), path)
    others = right.select("token", "main", *(F.col(c).alias(f"r_{c}") for c in sides))
    # A pair meets in one orientation or, where the list's main component changes, in both.
    met = likely(named(rest.filter("long"), "l").join(others, "token").filter("l_component = main or l_id < r_id")).withColumn("turn", F.col("l_id") > F.col("r_id"))
    turned = met.select(*(F.when(F.col("turn"), F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{to}_{c}") for to, a, b in (("x", "l", "r"), ("y", "r", "l")) for c in flat))
    return _paired(ordered.unionByName(turned), "x_", "y_", percent, runs=True).select("a", "b")


def _labelled(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark, n, signature of each row of ``docs``, and signature, least (smallest id), label (one for each
    component) of each set of words."""
    small_batches(docs)
    spark = docs.sparkSession
    folder = shared_path(spark, "jaccard")
    maps = frequency_maps(docs, id_col, text_col)
    heavy = tabled(_prefixes(docs, maps, id_col, text_col, percent), f"{folder}/prefixes")
    narrow = settled(heavy.select("row_no", "doc_id", "mark", "n", "signature"))
    first = F.min(F.struct(F.col("row_no").alias("id"), _of().alias("of"), "mark"))
    sets = settled(narrow.filter("n > 0").groupBy("signature").agg(first.alias("first"), F.min("doc_id").alias("least")).select("signature", "first.*", "least"))
    representatives = tabled(_representatives(heavy, narrow, sets), f"{folder}/representatives")
    dropped(spark, f"{folder}/prefixes")
    texts = _marked(docs, id_col, text_col)
    sketches = representatives.select("id", "n", "sketch")

    shared = _shared_tokens(representatives, percent)
    # A member's rank as a centre: more frequent shingles, then fewer shingles; the last bits tell equal ones apart.
    rank = F.shiftleft(F.col("common").cast("long"), 53).bitwiseOR(F.shiftleft(F.greatest(F.lit((1 << 30) - 1) - F.col("n"), F.lit(0)), 23)).bitwiseOR(F.pmod(F.xxhash64("id"), F.lit(1 << 23)))
    entries = tabled(_entries(representatives.withColumn("rank", rank), percent, shared, carried=("rank",)), f"{folder}/entries")
    centre = entries.groupBy("token").agg(F.max_by("id", "rank").alias("c_id"), F.max_by("n", "rank").alias("c_n"), F.max_by("at", "rank").alias("c_at"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    members = entries.select("token", *(F.col(c).alias(f"m_{c}") for c in ("id", "n", "at")))
    met = _unpacked(_unpacked(members.join(centre, "token").filter("m_id != c_id"), "m_"), "c_")
    pairs = _paired(met.filter(_reachable("c_", "m_", percent) & _within("pos", "c_", "m_", percent)), "c_", "m_", percent).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = settled(_verified(_screened(pairs, sketches, percent), sets, texts, percent))
    dropped(spark, f"{folder}/entries")
    labels = components(links)

    bare = representatives.select("id", "n", "matches", "prefix", "marks")
    linked, others = apart(bare, F.xxhash64("id"), settled(labels.select(F.xxhash64("id").alias("key"))))
    linked = tabled(linked.join(labels, "id", "left").select(*bare.columns, F.coalesce("label", "id").alias("component")), f"{folder}/linked")
    labelled = others.withColumn("component", F.col("id")).unionByName(linked)
    of = _entries(labelled, percent, shared, carried=("component",)).groupBy("token", "component").agg(F.count(F.lit(1)).alias("many"))
    open_lists = of.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("many").alias("members"), F.max_by("component", "many").alias("main")).filter("parts > 1")
    open_lists = settled(open_lists.select("token", "main", "members"))
    long_lists = _token_bitmap(open_lists.filter(F.col("members") > LONG).select("token"))
    rest = _entries(labelled, percent, shared, _token_bitmap(open_lists.select("token")), long_lists, carried=("component", "marks"), runs=True)
    links = links.union(settled(_verified(_screened(_remaining(rest, open_lists, percent, f"{folder}/rest"), sketches, percent), sets, texts, percent)))
    dropped(spark, folder)
    labels = components(links)

    return narrow.drop("row_no"), settled(sets.join(labels, "id", "left").select("signature", "least", F.coalesce("label", "id").alias("label")))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    rows, sets = _labelled(docs, percent, id_col, text_col)
    least = settled(sets.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("many")))
    # A set that is a component by itself has its name at hand; only sets of larger ones meet theirs.
    alone = sets.join(small_or_joined(least.filter("many > 1")), "label", "left").select("signature", F.when(F.col("many") > 1, F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(alone, "signature", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of the smallest id of each component, with all columns; rows without an id go behind others.

    Where an id comes with several texts in one component, one of these stays. Rows with an empty set all stay, and
    so do copies of a row equal in id and text to one that stays. Only rows that a bitmap of those to drop lets
    through are shuffled.
    """
    rows, sets = _labelled(docs, percent, id_col, text_col)
    told = settled(rows.filter("n > 0").select("doc_id", "mark", "signature").distinct().join(sets.select("signature", "label"), "signature").select("label", "mark", _of().alias("of"), F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark").alias("rank")))
    best = settled(told.groupBy("label").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many"))
    gone, of = fresh(docs.columns, "gone", "of")
    drop = settled(told.join(small_or_joined(best), "label").filter("rank != best").select(F.col("mark").alias(gone), F.col("of").alias(of)))
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(own.isNull(), own, text)
    maybe, others = apart(docs, mark, drop.select(gone))
    return others.union(maybe.join(drop, (mark == F.col(gone)) & (F.coalesce(own, F.lit(-1).cast("long")) == F.col(of)), "left_anti"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(i)
  WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
"""
