"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is its counts by length, at most ``capacity``
numbers, whatever the number of documents. The driver reduces and packs those counts in bulk and gets a list of
bin patterns with multiplicities, bounded by the capacity as well. Rows then find their place by arithmetic: the
r-th piece of its length goes to the pattern whose range of that length holds r. Ranks come from counts of hash
ranges summed ahead and row numbers inside a range, so no length is ranked in one task.

Reduction, in falling order of length l with the largest fitting partner p among all that is not fixed:
- nothing fits: l alone; l + p is the capacity exactly: the pair;
- no two of the smallest fit beside l: the pair dominates every other set;
- two but no three fit: the pair, if p is at least the best sum of two; or the best two (p, q), if they fill l up
  exactly and no two items above q fit beside l.
What isn't settled so goes to best-fit in falling order, each length in the tightest open bin.

Edge cases: a null or empty text is the end id alone, one token; a repeated row is packed as often as it comes (rows
equal in id and text are interchangeable); a null id is packed like any other. A text longer than the capacity is
cut into full pieces, of which the first may be shorter. An empty table gives an empty result.

With a column of groups each sequence holds pieces of one group: the counts of each are packed by themselves, so the
driver holds ``capacity`` numbers a group, and at most one sequence a group is less full for it. Null is a group.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import settled, slices, small_batches, whole_text
from jobloom.llm.tokens import MOST_KEPT, ByteEncoder, encoder

#: Ranges of the hash in which pieces of one length are ranked.
RANGES = 1024

Pattern = tuple[tuple[int, int], ...]


class _Left:
    """Counts by length that are still to be packed, with neighbour search."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.sorted.pop(bisect_left(self.sorted, length))

    def at_most(self, room: int) -> int | None:
        i = bisect_left(self.sorted, room + 1)
        return self.sorted[i - 1] if i else None

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The n smallest items above a length, fewer if there are no more."""
        found: list[int] = []
        for length in self.sorted[bisect_left(self.sorted, above + 1) :]:
            found += [length] * min(n - len(found), self.counts[length])
            if len(found) == n:
                break
        return found


def _best_two(left: _Left, room: int) -> tuple[int, int] | None:
    """Lengths a >= b of two items with the largest sum within room; of equal sums the one with the largest a."""
    best = None
    for a in reversed(left.sorted):
        if best and 2 * a < best[0]:
            break
        b = left.at_most(min(a, room - a)) if a < room else None
        if b == a and left.counts[a] < 2:
            b = left.at_most(a - 1)
        if b is not None and (best is None or a + b > best[0]):
            best = (a + b, a, b)
    return best and best[1:]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Counter[Pattern], dict[int, int]]:
    """Bins that some best packing has, by pattern, and the counts that remain."""
    fixed: Counter[Pattern] = Counter()
    left = _Left(counts)
    passed: set[int] = set()

    def fix(items: list[int], n: int) -> None:
        fixed[tuple(sorted(Counter(items).items(), reverse=True))] += n
        for length, k in Counter(items).items():
            left.take(length, n * k)

    for large in sorted(left.counts, reverse=True):
        # Partners come from all that is not fixed, lengths that were passed over included.
        while large in left.counts and large not in passed:
            n, room = left.counts[large], capacity - large
            partner = left.at_most(room)
            if partner == large and n == 1:
                partner = left.at_most(large - 1)
            if partner is None:
                fix([large], n if room < large else 1)
                continue
            times = n // 2 if partner == large else min(n, left.counts[partner])
            small = left.smallest(3)
            if large + partner == capacity or len(small) < 3 or sum(small[:2]) > room:
                fix([large, partner], times)
                continue
            if sum(small) > room and partner != large:
                two = _best_two(left, room)
                if two is None or partner >= sum(two):
                    fix([large, partner], 1)
                    continue
                above = left.smallest(2, two[1])
                if sum(two) == room and two[0] == partner and large not in two and (len(above) < 2 or sum(above) > room):
                    fix([large, *two], 1)
                    continue
            passed.add(large)
    return fixed, dict(left.counts)


def best_fit_falling(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit of all items in falling order, many bins at a time; bins by pattern."""
    open_bins: dict[int, Counter[tuple[tuple[int, int], ...]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            insort(rooms, room)
        open_bins[room][pattern] += n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, n)
                put(capacity - each * length, ((length, each),), n // each)
                n %= each
                continue
            room = rooms[i]
            pattern, bins = next(iter(open_bins[room].items()))
            each = min(room // length, n)  # a bin just used stays the tightest until it's full
            used = min(bins, n // each)
            open_bins[room][pattern] -= used
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(bisect_left(rooms, room))
            put(room - each * length, (*pattern, (length, each)), used)
            n -= used * each
    total: Counter[Pattern] = Counter()
    for patterns in open_bins.values():
        total.update(patterns)
    return total


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of (length, items) and their numbers of bins, for all items, in a fixed order."""
    fixed, remain = reduce_by_dominance(counts, capacity)
    return sorted((fixed + best_fit_falling(remain, capacity)).items(), reverse=True)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most_kept: int = MOST_KEPT, group_col: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian u32) and lane, the
    group as text.

    ``most_kept`` bounds what a worker keeps of encoded words; it changes memory and time, never ids.
    """
    small_batches(docs)
    end = struct.pack("<I", end_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", lane string" * (group_col is not None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteEncoder, vocabulary, most_kept)
        for batch in slices(batches, "text", 4 << 20):
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                at = 0
                for k, to in enumerate(range(first, n + 1, capacity)):
                    held = ids[4 * at : 4 * to]
                    rows.append(i)
                    out.append((k, at, to - at, zlib.crc32(held), held if with_ids else None))
                    at = to
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            taken = [c.take(pa.array(rows, pa.int64())) for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([taken[0], *(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *taken[1:]], [c.split()[0] for c in schema.split(", ")])

    # A group's name begins with a sign, so that null is none of the others.
    lane = [] if group_col is None else [F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.lit("")).alias("lane")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *lane).mapInArrow(cut, schema)


def place(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces, lane by lane if they have one."""
    lane = ["lane"] if "lane" in cut.columns else []
    keys = [*lane, "length"]
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANGES)).cast("int")
    rows = settled(cut.withColumn("range", spread))
    sums = settled(rows.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n")))
    # At most ``capacity`` rows a lane, whatever the input.
    counts: dict[str | None, dict[int, int]] = {}
    for r in sums.groupBy(*keys).agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lane"] if lane else None, {})[r["length"]] = r["n"]

    slots, sequence = defaultdict(list), 0
    for name in sorted(counts, key=lambda x: x or ""):
        used: Counter[int] = Counter()
        for pattern, bins in pack_counts(counts[name], capacity):
            at = 0
            for length, each in pattern:
                slots[name, length].append((used[length], each, sequence, at))
                used[length] += bins * each
                at += length * each
            sequence += bins
    by_length = {key: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(own), strict=True)) for key, own in slots.items()}

    ahead = sums.select(*keys, "range", (F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).alias("before"))
    inside = Window.partitionBy(*keys, "range").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(ahead, [*keys, "range"]).withColumn("rank", F.col("rank") + F.col("before")).drop("range", "before")
    sent = cut.sparkSession.sparkContext.broadcast(by_length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            lanes = np.array(batch.column("lane").to_pylist() if lane else [None] * len(rank), dtype=object)
            for name in set(lanes.tolist()):
                of_lane = lanes == name
                for value in np.unique(length[of_lane]).tolist():
                    own = of_lane & (length == value)
                    first, each, bins_from, at = places[name, value]
                    k = np.searchsorted(first, rank[own], side="right") - 1
                    inner = rank[own] - first[k]
                    sequence_id[own] = bins_from[k] + inner // each[k]
                    offset[own] = at[k] + inner % each[k] * value
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence_id), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.select(*[f.name for f in kept], "rank").mapInArrow(find, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most_kept: int = MOST_KEPT, group_col: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids); a sequence holds one group."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return place(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids, most_kept, group_col), capacity).select(*names)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, **columns) -> DataFrame:
    """One row a sequence: sequence_id and its ids, joined in order of offset."""
    packed = pack(docs, vocabulary, capacity, end_id, with_ids=True, **columns)
    inner = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inner.alias("inner")).select("sequence_id", F.expr("transform(inner, x -> x.doc_id)").alias("doc_ids"), F.expr("aggregate(inner, X'', (s, x) -> concat(s, x.ids))").alias("ids"))
