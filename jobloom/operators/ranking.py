"""Scores, rejection reasons, reviews, ranks and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import first_hit, norm_dedupe, present
from jobloom.operators.meeting import roots, with_key_minimum
from jobloom.settling import settled

# Seniority patterns in their order
SENIORITY = (
    "\\bsenior\\b", "\\bsr\\.?\\s", "\\blead\\b", "\\bprincipal\\b", "\\bhead\\s+of\\b", "\\bdirector\\b", "\\bchief\\b", "\\bvp\\b",
    "\\bvice\\s+president\\b", "\\bleiter(in)?\\b", "\\bleitung\\b", "\\bteam\\s*lead(er)?\\b", "\\barchitect\\b", "\\barchitekt\\b", "\\bc[ist]o\\b",
)
# Places that are clearly abroad
FOREIGN = ("united states", "usa", "uk only", "london", "paris", "amsterdam", "berlin only", "münchen only")
# Words too common for a fingerprint
NOISE = ("ag", "gmbh", "sa", "ltd", "group", "und", "and", "der", "die", "das")


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the distinct words a lower-case text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in sorted(set(words))), F.lit(0))


def title_score(title: Column, positive: Sequence[str], negative: Sequence[str]) -> tuple[Column, Column]:
    """Score (10 a hit, -20 a negative hit) and label."""
    low = F.lower(present(title))
    good, bad = hits(low, positive), hits(low, negative)
    label = F.when((good >= 2) & (bad == 0), "exact").when((good >= 1) & (bad == 0), "good").otherwise("weak")
    return good * 10 - bad * 20, label


def match_label(label: Column, score: Column) -> Column:
    """Labels only rise with the score."""
    return F.when(score >= 20, "exact").when((score >= 10) & (label != "exact"), "good").otherwise(label)


def fit(label: Column, score: Column, least: int = 1) -> Column:
    return F.when(F.lower(label).isin("exact", "good") & (score >= least), "OK").otherwise("DECISION")


def seniority(title: Column) -> Column:
    """The first pattern's match, in list order; null if none."""
    return F.coalesce(*(F.nullif(F.lower(F.trim(F.regexp_extract(present(title), f"(?i)(?U){p}", 0))), F.lit("")) for p in SENIORITY))


def hard_reason(title: Column, company: Column, text: Column, companies=(), keywords=(), languages=(), requirements=(), includes=(), foreign=FOREIGN, location: Column | None = None, raw_title: Column | None = None) -> Column:
    """The first rule that rejects, as category:hit; null where none does. Title and raw title are searched together,
    for languages and requirements with the text behind them."""
    firm = F.lower(present(company))
    head = F.lower(F.concat_ws(" ", present(title), present(raw_title if raw_title is not None else title)))
    whole = F.concat_ws(" ", head, F.lower(present(text)))
    rules = [F.concat(F.lit("seniority:"), seniority(title))]
    for name, where, words in (("blacklist_company", firm, companies), ("blacklist_keyword", head, tuple(dict.fromkeys(keywords))), ("language_requirement", whole, languages), ("requirements_blocklist", whole, requirements)):
        if words:
            rules.append(F.concat(F.lit(f"{name}:"), first_hit(where, words)))
    if includes:
        rules.append(F.when(first_hit(head, includes).isNull(), F.lit("include_keyword:no_match")))
    if foreign and location is not None:
        rules.append(F.concat(F.lit("location:foreign:"), first_hit(F.lower(present(location)), foreign)))
    return F.coalesce(*rules)


def final_score(rule: Column, reviewed: Column, fallback: Column) -> Column:
    """0.6 rule score scaled from -30..80 to 0..100 and 0.4 review, half-even to one place; the rule alone on fallback."""
    scaled = (F.greatest(F.lit(-30.0), F.least(F.lit(80.0), rule.cast("double"))) + 30) / 110 * 100
    return F.when(fallback, F.bround(scaled, 1)).otherwise(F.bround(0.6 * scaled + 0.4 * reviewed, 1))


def fingerprint(title: Column, company: Column) -> Column:
    """First four words of the title and two of the company, sorted, without noise."""

    def words(text: Column, n: int) -> Column:
        own = F.array_except(F.array_distinct(F.split(norm_dedupe(text), " ")), F.array(*(F.lit(w) for w in (*NOISE, ""))))
        return F.array_join(F.slice(F.array_sort(own), 1, n), " ")

    return F.concat_ws("|", words(title, 4), words(company, 2))


def best_of(frame: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """One row a key: the largest score, the earliest of equal ones."""
    window = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return frame.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def first_of(frame: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the earliest."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def greedy_clusters(frame: DataFrame) -> DataFrame:
    """Adds ``cluster`` (ord of the row that opened it) to rows with ord (distinct, not null), source_id, url and print.

    A row joins the cluster of the first of its keys that an earlier row has registered, else opens one; a key is
    never registered anew. So a key's cluster is that of the first row that has it, and each row points to that
    row of its first such key: pointers are followed by doubling, no component ever meets in one task. Null and empty
    ids and urls are no keys; a blank fingerprint is one like any other, a null one counts as blank.
    """
    kinds = ((0, "i", "source_id"), (1, "u", "url"), (2, "p", "print"))
    listed = F.array(*(F.struct(F.lit(i).alias("nth"), F.concat(F.lit(sign), present(F.col(c))).alias("key")) for i, sign, c in kinds))
    keys = settled(frame.select("ord", F.explode(listed).alias("k")).select("ord", "k.nth", "k.key").filter(~F.col("key").isin("i", "u")))
    owned = with_key_minimum(keys, "key", "ord", "owner")
    earlier = F.when(F.col("owner") < F.col("ord"), F.struct("nth", "owner"))
    parents = owned.groupBy("ord").agg(F.min(earlier)["owner"].alias("parent")).select("ord", F.coalesce("parent", "ord").alias("parent"))
    found, _ = roots(parents)
    return frame.join(found.withColumnRenamed("root", "cluster"), "ord")


def best_in_clusters(frame: DataFrame) -> DataFrame:
    """One row of each cluster (ord, cluster, score_final, score_rule and others): the best, of equal ones the earliest.

    A final score of 0 or null stands back for the rule's; a null rule score counts as 0.
    """
    score = F.coalesce(F.nullif(F.col("score_final").cast("double"), F.lit(0.0)), F.col("score_rule").cast("double"), F.lit(0.0))
    best = frame.groupBy("cluster").agg(F.min(F.struct((-score).alias("s"), "ord"))["ord"].alias("ord"))
    return frame.join(best.select("ord"), "ord", "left_semi")


def within_budget(frame: DataFrame, needs: str, order: str, most: int) -> DataFrame:
    """Adds ``allowed``: whether a row that needs a fetch is among the first ``most`` that do.

    The last of them comes from a bounded top-k, so no task orders all rows. Orders are distinct and not null.
    """
    cut = frame.filter(F.col(needs)).select(order).orderBy(order).limit(most).agg(F.max(order).alias("_cut"))
    return frame.join(F.broadcast(cut)).withColumn("allowed", F.coalesce(F.col(needs) & (F.col(order) <= F.col("_cut")), F.lit(False))).drop("_cut")


def last_scan(frame: DataFrame, link: str, needs: Column, order: str, most: int) -> DataFrame:
    """One row, ``cut``: the order of the row that uses the ``most``-th distinct link among those that need a scan; null
    while there are fewer. Rows up to it are scanned, rows behind it are not, even for a link seen before.

    Links are told by the first row that uses each, and only the first ``most`` of these are ordered.
    """
    first = frame.filter(needs & (present(F.col(link)) != "")).groupBy(link).agg(F.min(order).alias("at")).orderBy("at").limit(most)
    return first.agg(F.when(F.count(F.lit(1)) >= most, F.max("at")).alias("cut"))


def shown_score(final: Column, score: Column) -> Column:
    """What rows are sorted by: the final score, and where it is 0 or null the score; 0 without either."""
    return F.coalesce(F.nullif(final.cast("double"), F.lit(0.0)), score.cast("double"), F.lit(0.0))


def raw_capped(rows: DataFrame, kept: int, order: str = "ord", times: int = 2) -> DataFrame:
    """The rows that a run takes in before it filters: the first ``times`` as many as it may keep, by a bounded top-k; no
    positive number is no cap."""
    return rows.orderBy(order).limit(kept * times) if kept > 0 else rows
