"""Rows that meet by a key where few keys may hold most rows, and texts that meet the names they contain.

Null keys meet nothing. Names and texts are taken as they are: callers normalise them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.settling import settled, tabled

#: A key with more than one in so many rows is met by broadcast: there are no more such keys than this.
FREQUENT = 1024
#: Letters of a name by which texts find it.
HEAD = 6


def with_key_minimum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the least value among the rows of a key.

    Frequent keys, which are few, are broadcast with their least value; rows of the others are shuffled, and no such
    key is large enough to load a task.
    """
    least = settled(rows.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_n")))
    total = least.agg(F.sum("_n")).first()[0] or 0
    frequent = least.filter(F.col("_n") * FREQUENT > total).drop("_n")
    met = rows.join(F.broadcast(frequent), F.col(key) == F.col("_key"), "left").drop("_key")
    rest = met.filter(F.col(name).isNull()).drop(name).join(least.filter(F.col("_n") * FREQUENT <= total).drop("_n"), F.col(key) == F.col("_key")).drop("_key")
    return met.filter(F.col(name).isNotNull()).unionByName(rest)


def roots(parents: DataFrame) -> tuple[DataFrame, int]:
    """Rows (ord, parent), where a parent comes earlier or is the row itself, with ``root`` in place of parent, and the
    number of rounds: each doubles the steps that a row has gone, so chains of n rows take log2(n) of them."""
    here, rounds = tabled(parents.select("ord", F.col("parent").alias("root"))), 0
    while True:
        open_ones = here.filter("ord != root")
        counts = settled(open_ones.groupBy(F.col("root").alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
        # What stands behind each target, looked up once for a target and then handed to the rows that point there.
        behind = tabled(counts.join(here.select(F.col("ord").alias("_at"), F.col("root").alias("_next")), "_at"))
        moving = behind.filter("_next != _at")
        if not moving.head(1):
            return here, rounds
        total = counts.agg(F.sum("_n")).first()[0]
        frequent, others = moving.filter(F.col("_n") * FREQUENT > total), moving.filter(F.col("_n") * FREQUENT <= total)
        once = here.join(F.broadcast(frequent.select("_at", "_next")), F.col("root") == F.col("_at"), "left").select("ord", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_done"))
        # Rows that have gone already look for a target that no row has, each for another one, and so stay spread.
        sought = once.withColumn("_sought", F.when(F.col("_done"), F.concat(F.lit("-"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("+"), F.col("root").cast("string"))))
        met = sought.join(others.select(F.concat(F.lit("+"), F.col("_at").cast("string")).alias("_sought"), "_next"), "_sought", "left")
        here, rounds = tabled(met.select("ord", F.coalesce("_next", "root").alias("root"))), rounds + 1


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of ``texts`` (id, text) and ``names`` (name) that they contain, each once: id, name.

    Every place of a text offers its next letters, as many as the head of some name has (HEAD at most), and meets the
    names with that head by an equal join; what follows is compared in place. Empty names and texts meet nothing.
    """
    known = names.select("name").filter("name != ''").distinct().select("name", F.left("name", F.lit(HEAD)).alias("head"))
    sizes = sorted(r["n"] for r in known.select(F.length("head").alias("n")).distinct().collect())
    if not sizes:
        return texts.select("id", F.lit("").alias("name")).filter(F.lit(False))
    own = texts.filter(F.length("text") > 0)
    places = own.select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    heads = places.select("id", "text", "at", F.explode(F.array(*map(F.lit, sizes))).alias("n")).filter("at + n - 1 <= length(text)")
    # What follows a head is as long as the longest name, so whole texts are not carried to the join.
    longest = known.agg(F.max(F.length("name"))).first()[0]
    offered = heads.select("id", F.substring("text", F.col("at"), F.col("n")).alias("head"), F.substring("text", F.col("at"), F.lit(longest)).alias("rest")).distinct()
    return offered.join(known, "head").filter(F.startswith("rest", "name")).select("id", "name").distinct()


def longest_contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id and the longest name in its text, of equally long ones the first; texts without one have no row."""
    return contained(texts, names).groupBy("id").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"))


def within_rate(events: DataFrame, key: str, seconds: Column, most: int, span: int = 3600) -> DataFrame:
    """Adds ``allowed``: whether at most ``most`` events of a key, itself included, fall in the ``span`` seconds up to one.

    Time is cut into spans, and an event is counted with those of its own span and of the one before, so a key with
    most of all events is spread over as many tasks as it has spans. Events of the same second count for each other;
    those without a time are not allowed, null keys are a key of their own.
    """
    own = events.withColumns({"_at": seconds.cast("long"), "_row": F.monotonically_increasing_id()})
    span_of = F.floor(F.col("_at") / span)
    seen = own.select(F.col(key).alias("_key"), "_at", "_row", F.explode(F.array(F.struct(span_of.alias("span"), F.lit(True).alias("own")), F.struct((span_of + 1).alias("span"), F.lit(False).alias("own")))).alias("_s"))
    recent = Window.partitionBy("_key", "_s.span").orderBy("_at").rangeBetween(-span, 0)
    counted = seen.filter("_at is not null").withColumn("_n", F.count(F.lit(1)).over(recent)).filter("_s.own").select("_row", "_n")
    return own.join(counted, "_row", "left").withColumn("allowed", F.coalesce(F.col("_n") <= most, F.lit(False))).drop("_row", "_at", "_n")
