"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded key within their source; row r of n gets the fractional rank (2r+1)/2n; the corpus
is ordered by that and cut into runs whose counts differ by one at most, so each shard has the mixture of the
whole. No ordering passes through one task: ranks and positions come from counts of fixed ranges of the key and
of the fractional rank, summed ahead, and from row numbers inside one such range.

Edge cases: a null source is a source of its own; a null text has size 1 and the checksum of no bytes; ties in
the key fall to id, checksum and size, and rows equal in all of them are interchangeable. Fewer rows than shards
leave the last shards empty; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import KEY_BITS, fresh, seeded_key, settled, shared_path, tabled, whole_text

#: Ranges of the key for each source, and ranges of the fractional rank.
KEY_RANGES, RANK_RANGES = 1024, 4096


def source_name(source: str = "source") -> Column:
    """A source's name that is never null: null sorts behind all others."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, and ``carried`` columns."""
    narrow = settled(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source_name(source_col).alias("src"),
            (F.octet_length(whole_text(text_col)) + 1).cast("long").alias("size"),
            F.crc32(whole_text(text_col)).alias("text_crc32"),
            seeded_key(seed, F.col(id_col)).alias("key"),
            *carried,
        ).withColumn("part", F.shiftright("key", KEY_BITS - (KEY_RANGES - 1).bit_length()))
    )
    tie = ["key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]

    counts = narrow.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("src")
    ahead = counts.select(
        "src",
        "part",
        (F.sum("n").over(by_source.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("of_source"),
    )
    within = Window.partitionBy("src", "part").orderBy(*tie)
    ranked = settled(
        narrow.withColumn("local", F.row_number().over(within) - 1)
        .join(ahead, ["src", "part"])
        .withColumn("frac", (2 * (F.col("before") + F.col("local")) + 1).cast("double") / (2 * F.col("of_source")).cast("double"))
        .withColumn("range", F.floor(F.col("frac") * RANK_RANGES).cast("int"))
        .select("doc_id", "src", "size", "text_crc32", "key", "frac", "range", *carried)
    )

    # RANK_RANGES rows at most, whatever the input: one task may order them.
    sums = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    starts = sums.select("range", (F.sum("n").over(everything.orderBy("range")) - F.col("n")).alias("start"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("range").orderBy("frac", "src", *tie)
    placed = ranked.withColumn("local", F.row_number().over(inside) - 1).join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("local"))
    shard = F.expr(f"(place * {shards}) div total")
    return placed.withColumn("shard_no", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard_no").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard_no * total + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carried,
    )


def write_shards(docs: DataFrame, path: str, **options) -> str:
    """Writes ``docs`` as Parquet, one folder for each shard, rows in the order of their slots; returns the name of the
    column that names the shard: ``shard``, or another where ``docs`` has such a column.

    Rows are numbered in a table first and meet their shard by that number, so ids may repeat or be missing.
    """
    spark = docs.sparkSession
    row, slot, other = fresh(docs.columns, "row", "slot", "shard")
    shard = "shard" if "shard" not in {c.lower() for c in docs.columns} else other
    numbered = tabled(docs.withColumn(row, F.monotonically_increasing_id()), shared_path(spark, "shards"))
    plan = shard_rows(numbered, carried=(row,), **options).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = numbered.join(plan, row).drop(row)
    joined.repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
    return shard
