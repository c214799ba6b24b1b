"""The keyed state of postings over runs: merge, ages, reminders, marks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TERMINAL = ("new", "notified"), ("applied", "ignored", "closed")


def merge(state: DataFrame, batch: DataFrame, stamp: Column, most_missing: int = 3, most_days: int = 7) -> DataFrame:
    """The next state: one full outer join of state and batch by uid.

    New rows enter as new; seen rows are stamped, and closed ones reopen (notified if ever sent); rows that didn't
    come count a missing run and close after ``most_missing`` runs or ``most_days`` whole days. A guard of 0 is off.
    An empty batch changes nothing: callers skip the merge then.
    """
    s, b = state.alias("s"), batch.alias("b")
    joined = s.join(b, F.col("s.uid") == F.col("b.uid"), "full_outer")
    came, known = F.col("b.uid").isNotNull(), F.col("s.uid").isNotNull()
    ended = F.col("s.status").isin(*TERMINAL)
    missing = F.col("s.missing_runs") + 1
    days = F.floor((F.unix_timestamp(stamp) - F.unix_timestamp("s.last_seen")) / 86400)
    gone = F.lit(False)
    if most_missing > 0:
        gone = gone | (missing >= most_missing)
    if most_days > 0:
        gone = gone | (days >= most_days)
    status = (
        F.when(~known, "new")
        .when(came & (F.col("s.status") == "closed"), F.when(F.col("s.last_sent").isNotNull(), "notified").otherwise("new"))
        .when(came | ended, F.col("s.status"))
        .when(gone, "closed")
        .otherwise(F.col("s.status"))
    )
    return joined.select(
        F.coalesce("s.uid", "b.uid").alias("uid"),
        status.alias("status"),
        F.when(known, F.col("s.first_seen")).otherwise(stamp).alias("first_seen"),
        F.when(came, stamp).otherwise(F.col("s.last_seen")).alias("last_seen"),
        F.col("s.last_sent").alias("last_sent"),
        F.when(came | ~known, 0).when(ended, F.col("s.missing_runs")).otherwise(missing).cast("int").alias("missing_runs"),
    )


def reminder_due(last_sent: Column, now: Column, days: int, daily: bool = False) -> Column:
    if daily or days <= 0:
        return F.lit(True)
    return last_sent.isNull() | (F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_sent)) / 86400) >= days)


def classified(state: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """Adds ``section``: new, reminder or open for rows seen in this run and not ended."""
    seen = (F.col("last_seen") == now) & ~F.col("status").isin(*TERMINAL)
    return state.withColumn("section", F.when(~seen, "").when(F.col("last_sent").isNull(), "new").when(reminder_due(F.col("last_sent"), now, days), "reminder").otherwise("open"))


# Words that mark a posting in the tracker
APPLIED_WORDS = ("applied", "apply", "done", "sent", "bewerbung", "gesendet")
IGNORED_WORDS = ("ignored", "ignore", "skip", "no", "nein")
EMPTY_BOX, TICKED_BOX = "\u2610", "\u2611"
TICKED_WORDS = ("1", "true", "t", "yes", "y", "ja", "j", "x", TICKED_BOX)
EMPTY_WORDS = ("0", "false", "no", "nein")


def checkbox(value: Column) -> Column:
    """An empty or a ticked box; other words stay."""
    raw = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when((raw == "") | F.lower(raw).isin(*EMPTY_WORDS), EMPTY_BOX).when(F.lower(raw).isin(*TICKED_WORDS), TICKED_BOX).otherwise(raw)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``ord``: their own, else the order in which they are read."""
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())


def marked(state: DataFrame, marks: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Applies manual marks (uid, action, done, and ord if given): words of the action go before the ticked box.

    With ``applied_at`` in the state, a posting that becomes applied gets the stamp and one that becomes ignored none.
    Of several marks of one uid the last row counts, blank or not; a null uid meets nothing.
    """
    last = in_order(marks).groupBy(F.col("uid").alias("_uid")).agg(F.max_by(F.struct("action", "done"), "ord").alias("_last"))
    said = last.select("_uid", F.lower(F.trim(F.coalesce("_last.action", F.lit("")))).alias("_action"), checkbox(F.col("_last.done")).alias("_done"))
    to = F.when(F.col("_action").isin(*APPLIED_WORDS), "applied").when(F.col("_action").isin(*IGNORED_WORDS), "ignored").when(F.col("_done") == TICKED_BOX, "applied")
    joined = state.join(said, state["uid"] == said["_uid"], "left").withColumn("_to", to)
    if "applied_at" in state.columns and stamp is not None:
        changes = F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("status"))
        joined = joined.withColumn("applied_at", F.when(changes, F.when(F.col("_to") == "applied", stamp)).otherwise(F.col("applied_at")))
    return joined.withColumn("status", F.coalesce("_to", "status")).drop("_uid", "_action", "_done", "_to")


def counts(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count_if(F.col("status").isin(*OPEN)).alias("n_open"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in TERMINAL),
        F.count(F.lit(1)).alias("n_total"),
    )
