"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the budget by weight, clamped at ``epochs`` times its own size; what the clamp
frees is shared again by weight until no source is above its clamp. That fixed point is a water level L with
target = least(cap, L * weight): with sources ordered by cap/weight, L is the largest of
(budget - caps before) / (weights from here on), so windows over the sources give it without iterating.

Documents of a source are then taken floor(target/size) whole times and, for the fraction left, once more in the
order of a seeded key until the fraction is met to within half a document. The order is cut by sums over ranges of
the key, so no source is ordered in one task; what remains for each source is one key, the cut.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own and comes last; the key
is of id and text, so rows without an id or with the same one are cut like others; rows equal in both are taken in
their place until the fraction is met; a source of size 0 has target 0; an empty table gives an empty result. Columns
beyond those named are passed on by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import KEY_BITS, fresh, seeded_key, settled, small_batches, small_or_joined, whole_text
from jobloom.llm.sharding import source_name

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights by place of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Ranges of the key in which a source is ordered, at least; there are more from RANGE_ROWS rows each on.
KEY_RANGES, RANGE_ROWS = 4096, 4096


def water_level(sources: DataFrame, weights: Sequence[float], epochs: float) -> DataFrame:
    """Adds ``target`` to one row a source (src, source_size)."""
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(everything.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    ahead = everything.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything)
    level = F.max((F.col("budget") - F.col("caps_before")) / F.col("weights_left")).over(everything)
    return (
        capped.withColumn("budget", budget)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(rest))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
        .select("src", "source_size", "target")
    )


def _key(seed: int, id_col: str, text_col: str):
    """Seeded by id and text, so that rows without an id or with the same one are cut like others."""
    return seeded_key(seed, F.col(id_col), F.md5(whole_text(text_col)))


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    small_batches(docs)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source_name(source_col).alias("src"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        _key(seed, id_col, text_col).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )


def _cuts(measured: DataFrame, weights: Sequence[float], epochs: float) -> DataFrame:
    """One row a source: src, source_size, target, whole (times every row is taken), and the cut of those taken once
    more: all rows of smaller keys than ``cut`` and ``extra`` of the rows of that key (-1: none)."""
    bits = KEY_BITS - max(KEY_RANGES, measured.count() // RANGE_ROWS).bit_length()
    ranged = measured.withColumn("part", F.shiftright("key", bits))
    sums = settled(ranged.groupBy("src", "part").agg(F.sum("size").alias("part_size")))
    plan = settled(
        water_level(sums.groupBy("src").agg(F.sum("part_size").alias("source_size")), weights, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("once_more", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    before = F.sum("part_size").over(Window.partitionBy("src").orderBy("part")) - F.col("part_size")
    # The one range of each source in which its fraction is met; all rows of earlier ranges are taken.
    border = (
        sums.select("src", "part", "part_size", before.alias("before"))
        .join(plan.select("src", "once_more"), "src")
        .filter("before < once_more")
        .groupBy("src", "once_more")
        .agg(F.max(F.struct("part", "before")).alias("at"))
        .select("src", "once_more", F.col("at.part").alias("part"), F.col("at.before").alias("before"))
    )
    # Rows of one key are alike and summed before they meet, so a window holds the distinct keys of one range.
    keys = ranged.filter("size > 0").join(border, ["src", "part"]).groupBy("src", "part", "key", "before", "once_more").agg(F.sum("size").alias("key_size"), F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("src", "part").orderBy("key")
    ahead = F.col("before") + F.sum("key_size").over(inside) - F.col("key_size")
    taken = F.least(F.col("rows"), F.greatest(F.lit(0), F.floor((F.col("once_more") - F.col("ahead")) * F.col("rows") / F.col("key_size") + F.lit(0.5))))
    last = keys.withColumn("ahead", ahead).withColumn("extra", taken).filter("extra > 0").groupBy("src").agg(F.max(F.struct("key", "extra", "rows")).alias("last"))
    start = border.select("src", F.shiftleft(F.col("part").cast("long"), bits).alias("range_start"))
    return settled(
        plan.join(start, "src", "left")
        .join(last, "src", "left")
        .select("src", "source_size", "target", "whole", F.coalesce("last.key", F.col("range_start"), F.lit(-1)).alias("cut"), F.coalesce("last.extra", F.lit(0)).alias("extra"), F.coalesce("last.rows", F.lit(0)).alias("rows"))
    )


def _last_places(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """src, last: the place up to which rows of a cut's key are taken, where it takes some of them only.

    Counts of the parts that rows were written in tell the part of the last one; only that part is ordered.
    """
    split = cuts.filter("extra > 0 and extra < rows").select("src", F.col("cut").alias("key"), "extra")
    rows = measured.join(small_or_joined(split), ["src", "key"]).select("src", "extra", "place", F.shiftright("place", 33).alias("part"))
    counts = rows.groupBy("src", "extra", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")
    at = counts.withColumn("before", before).filter("before < extra and before + n >= extra").select("src", "part", "before")
    nth = F.row_number().over(Window.partitionBy("src", "part").orderBy("place"))
    return settled(rows.join(at, ["src", "part"]).withColumn("nth", nth + F.col("before")).filter("nth = extra").select("src", F.col("place").alias("last")))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = 3.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, times."""
    measured = settled(_measured(docs, seed, id_col, text_col, source_col))
    cuts = _cuts(measured, weights, epochs)
    cuts = small_or_joined(settled(cuts.join(_last_places(measured, cuts), "src", "left")))
    more = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("extra") > 0) & (F.col("last").isNull() | (F.col("place") <= F.col("last"))))
    times = F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0)
    return measured.join(cuts, "src").withColumn("times", times).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = 3.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of ``docs``; a row taken n times comes n times.

    Of rows equal in id and text at the cut, copies of any one stand for those taken once more.
    """
    name, key, src, whole, cut, extra, rows, times, copy, row = fresh(docs.columns, "name", "key", "src", "whole", "cut", "extra", "rows", "times", "copy", "row")
    measured = settled(_measured(docs, seed, id_col, text_col, source_col))
    cuts = _cuts(measured, weights, epochs).select(F.col("src").alias(src), F.col("whole").alias(whole), F.col("cut").alias(cut), F.col("extra").alias(extra), F.col("rows").alias(rows))
    read = docs.withColumns({name: source_name(source_col), key: _key(seed, id_col, text_col)}).filter(F.col(text_col).rlike(WORD))
    met = read.join(small_or_joined(cuts), F.col(name) == F.col(src))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    more = (F.col(key) < F.col(cut)) | ((F.col(key) == F.col(cut)) & (F.col(extra) == F.col(rows)) & (F.col(extra) > 0))
    again = met.withColumn(times, F.col(whole) + more.cast("int")).filter(F.col(times) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*columns)
    some = met.filter((F.col(key) == F.col(cut)) & (F.col(extra) > 0) & (F.col(extra) < F.col(rows)))
    one = some.groupBy(name, extra).agg(F.first(F.struct(*columns)).alias(row))
    return again.union(one.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(extra).cast("long"))).alias(copy)).select(f"{row}.*"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws(':', '29', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, {KEY_BITS // 4}))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s
), t AS (
  SELECT source, source_size, least(cap, max(lev) OVER () * weight) AS target FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) - d.size / 2.0 <= w.target - w.whole * w.source_size AS more
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN more AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken,
       CASE WHEN size > 0 THEN whole + more::INT ELSE 0 END::INT AS times
FROM r
"""
