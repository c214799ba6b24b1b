"""Exact duplicate removal with a split for heavy digests.

A Misra-Gries summary of the digests names at most ``counters`` candidates; every digest that makes up more
than 1/counters of the rows is among them. Their true counts and winners are then computed exactly, and those
winners (a table of at most ``counters`` rows) are broadcast, so that rows of heavy groups are settled where
they are read. All other digests are too rare to load one task and go through an ordinary shuffle.

Edge cases: a null text counts as empty; the empty text is a text like any other. Of equal texts the one with
most code points stays, then the smallest id (a null id comes last), then the first row read. Rows repeated in
full are told apart by their place, so exactly one of them stays. An empty table gives an empty result. Other
columns are not read by ``duplicate_groups`` and only passed on by ``without_duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import apart, fresh, settled, small_batches, whole_text

BLANKS = "[\\x20\\x09-\\x0D]+"


def text_digest(text: str = "text"):
    """SHA-256 of the text without blanks, in lowercase hex."""
    return F.sha2(F.regexp_replace(whole_text(text), BLANKS, ""), 256)


def _groups(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, mark (hash of id and text), keep_id, group_size, kept, text_sha256."""
    small_batches(docs)
    narrow = settled(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.col(id_col), whole_text(text_col)).alias("mark"),
            text_digest(text_col).alias("digest"),
            F.length(whole_text(text_col)).alias("chars"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )
    rank = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_no").alias("r"))

    frequent = narrow.stat.freqItems(["digest"], 1.0 / counters)
    candidates = frequent.select(F.explode(frequent.columns[0]).alias("digest"))
    winners = settled(
        narrow.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("heavy_size"), F.min(rank).alias("heavy_best"))
        .filter("heavy_size > 1")
    )
    marked = narrow.join(F.broadcast(winners), "digest", "left")

    heavy = marked.filter("heavy_size is not null").select("doc_id", "mark", "digest", "row_no", F.col("heavy_size").alias("group_size"), F.col("heavy_best").alias("best"))
    group = Window.partitionBy("digest")
    light = (
        marked.filter("heavy_size is null")
        .select("doc_id", "mark", "digest", "row_no", F.count(F.lit(1)).over(group).alias("group_size"), F.min(rank).over(group).alias("best"))
    )
    return heavy.unionByName(light).select(
        "doc_id",
        "mark",
        F.col("best.i").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.r")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, id_col, text_col, counters).drop("mark")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that a bitmap of the dropped ones lets through are shuffled; the others are passed on where they are
    read. Of rows equal in id and text one stays, whichever was read first.
    """
    marks = _groups(docs, id_col, text_col, counters).groupBy("mark", "doc_id", "text_sha256").agg(F.count_if(~F.col("kept")).alias("gone"), F.count_if("kept").alias("stay")).filter("gone > 0")
    gone = settled(marks.select("mark", "doc_id", "text_sha256", "stay"))
    maybe, others = apart(docs, F.xxhash64(F.col(id_col), whole_text(text_col)), gone.select("mark"))

    mark, digest, stay, row = fresh(docs.columns, "mark", "digest", "stay", "row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    told = gone.select(F.col("mark").alias(mark), F.col("doc_id").alias(fresh(docs.columns, "id")[0]), F.col("text_sha256").alias(digest), F.col("stay").alias(stay))
    own = maybe.select(F.struct(*columns).alias(row), F.xxhash64(F.col(id_col), whole_text(text_col)).alias("m"), F.col(id_col).alias("i"), text_digest(text_col).alias("d"))
    met = own.join(told, (F.col("m") == F.col(mark)) & F.col("i").eqNullSafe(F.col(told.columns[1])) & (F.col("d") == F.col(digest)), "left")
    passed = met.filter(F.col(stay).isNull()).select(f"{row}.*")
    repeated = met.filter(F.col(stay) > 0).groupBy("m", "i", "d").agg(F.first(row).alias(row)).select(f"{row}.*")
    return others.union(passed).union(repeated)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
