"""Benchmark passages in documents by winnowing, in DataFrame functions only.

Of every window of consecutive words the smallest k-gram hash is its fingerprint. A passage that a document and an
item share gives both the same windows and so the same fingerprints: with k-grams of 5 words, 6 of them a window, no
shared span of 10 words goes unseen. Documents keep only those places whose fingerprint some item has; a hit is then
extended to the words of its whole window, which must equal a window of an item word for word. An item shorter than a
window is one window of its own length, with fingerprints of windows of that length.

Nothing moves between tasks but hits. Windows are distinct on the side of the items, so a hit meets one row however
many items hold the passage; each set of items that hold the same window has a number, and documents with equal sets
of such numbers share one list of items, so pairs of document and item are never listed for a passage that many hold.

Edge cases: null and empty texts have no words; an item without words is no window and never hit. A null item_id is
an item whose name is empty; equal item_ids are one item whose texts all count. Rows with null or repeated ids are told
apart by their place. Without hits, n_items is 0 and the digest that of the empty text. Without items no document
is hit; an empty table of documents gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import BROADCAST_ROWS, apart, settled, shared_path, small_batches, tabled, whole_text

#: What stands between words, once A-Z are lowered.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a window, and of the k-grams in it.
WINDOW, GRAM = 10, 5
#: The key of a document's own row, which stands among its places.
OWN = 0
#: Beyond a broadcast, a frequent window is met in so many places.
SALTS = 16


def _words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _fingerprint(n: int) -> Column:
    """The smallest k-gram hash of the window of ``n`` words at a place."""
    k = min(GRAM, n)
    grams = [F.xxhash64(*(F.get("hashes", F.col("at") + i + j) for j in range(k))) for i in range(n - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def places(rows: DataFrame, text_col: str, lengths: list[int]) -> DataFrame:
    """Adds n_words, words and, a row for each place and length, len, at and v: the fingerprint of the window of len
    words there. Every row has one place more, at -1, of length 0 and with the key OWN.

    Words are hashed once as an array; places come from it as rows of generated code, which no lambda slows down.
    """
    kept = [c for c in rows.columns if c != text_col]
    read = rows.select(*kept, _words(whole_text(text_col)).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashes = F.concat(F.array(F.lit(None).cast("long")), F.col("hashes"))
    spread = read.select(*kept, F.size("words").alias("n_words"), "words", "hashes", F.posexplode(hashes).alias("at", "hash")).withColumn("at", F.col("at") - 1)
    windows = [F.struct(F.lit(n).alias("len"), _fingerprint(n).alias("v")) for n in lengths]
    own = F.array(F.struct(F.lit(0).alias("len"), F.lit(OWN).cast("long").alias("v")))
    keyed = spread.select(*kept, "n_words", "words", "at", F.explode(F.when(F.col("at") < 0, own).otherwise(F.array(*windows))).alias("of"))
    return keyed.select(*kept, "n_words", "words", "at", F.col("of.len").alias("len"), F.col("of.v").alias("v")).filter("at + len <= n_words")


def _window() -> Column:
    """The words of a place, which hold no blank, joined by blanks."""
    return F.array_join(F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len")), " ")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows (window, len, v, items: number of their set of items), those sets (items, names), and the
    lengths of windows that there are, ``length`` and shorter ones."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name"), F.col(f"`{text_col}`").alias("text"))
    count = F.least(F.size(_words(whole_text("text"))), F.lit(length))
    lengths = sorted(r["n"] for r in items.select(count.alias("n")).filter("n > 0").distinct().collect())
    if not lengths:
        lengths = [length]
    # An item shorter than a window is held as one place of its own length.
    own = F.least(F.col("n_words"), F.lit(length))
    found = places(items, "text", lengths).filter(F.col("len") == own).select("name", "len", "v", _window().alias("window"))
    listed = found.groupBy("window", "len", "v").agg(F.array_sort(F.collect_set("name")).alias("names"))
    listed = tabled(listed, shared_path(benchmark.sparkSession, "windows"))
    sets = settled(listed.select("names").distinct().select(F.monotonically_increasing_id().alias("items"), "names"))
    return settled(listed.join(sets, "names").select("window", "len", "v", "items")), sets, lengths


def _met(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose window is one of ``known``, with the number of its items."""
    if known.count() <= BROADCAST_ROWS:
        return hits.join(F.broadcast(known), "window")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")).join(salted, ["window", "salt"]).drop("salt")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Every place of a document where a window of an item stands, and the sets of items.

    The first has row_no, doc_id, n_words, at, len and items; each row of ``docs`` has one row more, at -1, with items null.
    """
    small_batches(docs)
    known, sets, lengths = windows(benchmark, item_col, "text", length)
    prints = settled(known.select("v").union(docs.sparkSession.range(1).select(F.lit(OWN).cast("long").alias("v"))).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spread = places(rows, "text", lengths)
    likely = spread.join(F.broadcast(prints), "v", "left_semi") if prints.count() <= BROADCAST_ROWS else apart(spread, F.col("v"), prints)[0]
    table = tabled(likely.select("row_no", "doc_id", "n_words", "at", "len", _window().alias("window")), shared_path(docs.sparkSession, "places"))
    plain = ["row_no", "doc_id", "n_words", "at", "len"]
    found = _met(table.filter("len > 0"), known.select("window", "items")).select(*plain, "items")
    return table.filter("len = 0").select(*plain, F.lit(None).cast("long").alias("items")).unionByName(found), sets


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", length: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: row_no, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, sets = hits(docs, benchmark, id_col, text_col, item_col, length)
    # A document's own row comes first and adds nothing: it ends where the document begins.
    ahead = Window.partitionBy("row_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("len") > 0, F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.max(F.when(F.col("len") > 0, F.col("at") + F.col("len")).otherwise(0)).over(ahead)))).otherwise(0)
    counted = settled(
        found.withColumn("new", new)
        .groupBy("row_no")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set("items")).alias("held"))
    )
    lists = counted.filter("n_hit > 0").select("held").distinct()
    names = lists.select("held", F.explode("held").alias("items")).join(sets, "items").select("held", F.explode("names").alias("name"))
    sorted_names = F.array_sort(F.collect_set("name"))
    listed = settled(names.groupBy("held").agg(sorted_names.alias("names")).select(F.col("held"), F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")))
    clean = counted.filter("n_hit = 0").withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    by_list = counted.filter("n_hit > 0")
    met = by_list.join(F.broadcast(listed), "held") if listed.count() <= BROADCAST_ROWS else by_list.join(listed, "held")
    columns = ["row_no", "doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    return clean.select(*columns).unionByName(met.select(*columns)).withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``report`` without the place of a row."""
    return report(docs, benchmark, **options).drop("row_no")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS name, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT name, least(len(words), {WINDOW}) AS n, array_to_string(words[i + 1 : i + least(len(words), {WINDOW})], ' ') AS part
  FROM (SELECT *, unnest(range(greatest(len(words) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(words) > 0)
), p AS (
  SELECT rn, i, n, array_to_string(words[i + 1 : i + n], ' ') AS part
  FROM (SELECT *, unnest(range(len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)
), h AS (
  SELECT rn, i, p.n, name FROM p JOIN w ON w.n = p.n AND w.part = p.part
), t AS (
  SELECT rn, count(DISTINCT place) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS place FROM h) GROUP BY rn
), s AS (
  SELECT rn, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256 FROM (SELECT DISTINCT rn, name FROM h) GROUP BY rn
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN t USING (rn) LEFT JOIN s USING (rn)
"""
