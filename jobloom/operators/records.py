"""The stored state of postings: loading, migration, identifiers, tracker rows, views and counts.

State rows have uid, status, source, canonical_url, link, title, company, location, first_seen_at, last_seen_at,
last_sent_at, applied_at, score, match (strings as stored; null and empty are the same). Rows without a uid are
dropped on loading; an empty state gives empty results and zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import present
from jobloom.functions.urls import job_uid, state_canonical
from jobloom.operators.lifecycle import EMPTY_BOX, OPEN, TERMINAL, TICKED_BOX, checkbox, in_order

FIELDS = ("uid", "status", "source", "canonical_url", "link", "title", "company", "location", "first_seen_at", "last_seen_at", "last_sent_at", "applied_at", "score", "match")
# Sources that only collect from others
AGGREGATORS = ("careerjet", "jobrapido", "jooble")


def moment(text: Column) -> Column:
    """An ISO time; null where it is none."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text))


def score_value(score: Column) -> Column:
    return F.coalesce(score.try_cast("double"), F.lit(0.0))


def loaded(records: DataFrame) -> DataFrame:
    """A list of records (ord, job_uid, ...) as one row for each uid: the last one given counts."""
    own = records.filter(present(F.col("job_uid")) != "")
    rest = [c for c in records.columns if c not in ("ord", "job_uid")]
    return own.groupBy(F.col("job_uid").alias("uid")).agg(F.max_by(F.struct(*rest), "ord").alias("row")).select("uid", "row.*")


def migrated(entries: DataFrame, now: Column) -> DataFrame:
    """State rows from the older list of seen postings: ``key`` alone, or the fields of a posting.

    All count as sent; of entries with one uid the last by ``ord`` stays.
    """
    bare = present(F.col("key")) != ""
    uid = F.when(bare, F.left(F.sha2(F.concat(F.lit("legacy|"), F.col("key")), 256), F.lit(16))).otherwise(job_uid(F.col("source"), F.col("link"), F.col("title"), F.col("company"), F.col("location")))
    text = lambda c: F.when(bare, "").otherwise(present(F.col(c)))
    rows = entries.select(
        "ord", uid.alias("job_uid"), F.lit("notified").alias("status"), F.when(bare, "legacy").otherwise(present(F.col("source"))).alias("source"),
        F.when(bare, "").otherwise(state_canonical(F.col("link"))).alias("canonical_url"), *(text(c).alias(c) for c in ("link", "title", "company", "location")),
        now.alias("first_seen_at"), now.alias("last_seen_at"), now.alias("last_sent_at"),
    )
    return loaded(rows)


def resolved(state: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ask_id, prefix, url) with ``uid``: the only one that begins with the prefix, or, without a prefix, the
    only one whose link or canonical link is the URL; null for none or several."""
    rows = state.select("uid", F.trim(present(F.col("link"))).alias("_link"), state_canonical(F.col("link")).alias("_own"), state_canonical(F.col("canonical_url")).alias("_canon"))
    wanted_prefix = asked.filter(present(F.col("prefix")) != "").select("ask_id", "prefix")
    sizes = sorted(r["n"] for r in wanted_prefix.select(F.length("prefix").alias("n")).distinct().collect())
    # Each uid offers its beginnings of the lengths that are asked for; the first and the last of a beginning tell whether it is the only one.
    offered = rows.select("uid", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("n")).select(F.left("uid", F.col("n")).alias("prefix"), "uid")
    by_prefix = wanted_prefix.join(offered.groupBy("prefix").agg(F.min("uid").alias("low"), F.max("uid").alias("high")), "prefix").select("ask_id", F.explode(F.array("low", "high")).alias("uid"))
    named = asked.filter((present(F.col("prefix")) == "") & (F.trim(present(F.col("url"))) != "")).select("ask_id", F.trim("url").alias("_url"), state_canonical(F.col("url")).alias("_target"))
    forms = rows.select("uid", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("exact"), F.col("_own").alias("form")), F.struct(F.lit(0).alias("exact"), F.col("_canon").alias("form")), F.struct(F.lit(1).alias("exact"), F.col("_link").alias("form"))))).alias("f")).select("uid", "f.*").filter("form != ''")
    wanted = named.select("ask_id", F.explode(F.array(F.struct(F.lit(0).alias("want"), F.col("_target").alias("text")), F.struct(F.lit(1).alias("want"), F.col("_url").alias("text")))).alias("w")).select("ask_id", "w.*")
    by_url = wanted.join(forms, (F.col("text") == F.col("form")) & (F.col("want") == F.col("exact"))).select("ask_id", "uid")
    found = by_prefix.unionByName(by_url).groupBy("ask_id").agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    return asked.join(found, "ask_id", "left").select(*(asked[c] for c in asked.columns), F.when(F.col("low") == F.col("high"), F.col("low")).alias("uid"))


def tracker_rows(state: DataFrame, manual: DataFrame, with_closed: bool = False) -> DataFrame:
    """Rows of the tracker: state with the hand-written columns (uid, erledigt, aktion, notes), rank by last sight.

    Applied and ignored postings are ticked; their action is filled in where it is blank.
    """
    own = state if with_closed else state.filter(present(F.col("status")) != "closed")
    by_hand = manual.select(F.col("uid").alias("_uid"), "erledigt", "aktion", "notes")
    kept = own.join(by_hand, own["uid"] == F.col("_uid"), "left").drop("_uid")
    ended = F.col("status").isin("applied", "ignored")
    typed = F.when(F.trim(present(F.col("aktion"))) != "", F.col("aktion"))
    return kept.select(
        "uid", present(F.col("status")).alias("status"), present(F.col("applied_at")).alias("applied_at"),
        F.when(ended, TICKED_BOX).when(F.trim(present(F.col("erledigt"))) != "", checkbox(F.col("erledigt"))).otherwise(EMPTY_BOX).alias("erledigt"),
        F.coalesce(typed, F.when(ended, F.col("status")), F.lit("")).alias("aktion"), F.when(F.trim(present(F.col("notes"))) != "", F.col("notes")).otherwise("").alias("notes"),
        *(present(F.col(c)).alias(c) for c in ("title", "company", "location", "source")), F.coalesce(F.nullif("link", F.lit("")), F.col("canonical_url"), F.lit("")).alias("link"),
        *(present(F.col(c).cast("string")).alias(c) for c in ("first_seen_at", "last_seen_at", "last_sent_at", "score", "match")),
        F.coalesce(moment(F.col("last_seen_at")), F.timestamp_seconds(F.lit(0))).alias("seen"),
    )


def visible(state: DataFrame, now: Column, with_done: bool, with_closed: bool, days: int = 60) -> DataFrame:
    """Rows the view shows: open ones, others only if asked for and seen of late (unreadable times count as late)."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("new"))
    recent = F.coalesce(moment(F.col("last_seen_at")) >= now - F.expr(f"interval {days} days"), F.lit(True)) if days > 0 else F.lit(True)
    hidden = ((status == "closed") & ~(F.lit(with_closed) & recent)) | (status.isin("applied", "ignored") & ~(F.lit(with_done) & recent))
    return state.withColumn("status", status).filter(~hidden)


def view_counts(state: DataFrame, now: Column, with_closed: bool, days: int = 60) -> DataFrame:
    """Counts of the view; closed rows that are shown count as open as well."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("new"))
    shown = visible(state, now, True, with_closed, days).filter(~F.col("status").isin("applied", "ignored")).agg(F.count(F.lit(1)).alias("n_open"))
    rest = state.agg(*(F.count_if(status == s).alias(f"n_{s}") for s in TERMINAL), F.count(F.lit(1)).alias("n_total"))
    return shown.join(F.broadcast(rest))


def status_group(status: Column) -> Column:
    return F.when((present(status) == "") | status.isin(*OPEN), "open").otherwise(status)


def matching(rows: DataFrame, text: str = "", groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose fields contain the text and whose status is of the groups; without them all."""
    whole = F.lower(F.concat_ws(" ", *(present(F.col(c)) for c in ("title", "company", "location", "source", "status", "uid"))))
    own = rows.filter(F.contains(whole, F.lit(text.strip().lower()))) if text.strip() else rows
    return own.filter(status_group(F.col("status")).isin(*groups)) if groups else own


# Order of statuses and of labels
STATUS_RANKS = {"new": 0, "notified": 1, "applied": 2, "ignored": 3, "closed": 4}
MATCH_RANKS = {"exact": 0, "good": 1, "weak": 2, "unknown": 3}


def sort_value(key: str) -> Column:
    """What rows of the view are sorted by."""
    ranked = lambda c, ranks, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), c), F.lit(other))
    seconds = lambda c: F.coalesce(F.unix_timestamp(moment(F.col(c))), F.lit(0))
    number = lambda c, other: F.coalesce(F.col(c).try_cast("double"), F.lit(float(other)))
    values = {
        "status": lambda: ranked(F.col("status"), STATUS_RANKS, 99), "match": lambda: ranked(F.lower("match"), MATCH_RANKS, 99), "commute": lambda: number("commute_min", 9999), "score": lambda: number("score", 0),
        "applied_at": lambda: seconds("applied_at"), "first_seen": lambda: seconds("first_seen_at"), "last_seen": lambda: seconds("last_seen_at"),
        **{k: (lambda c=c: F.lower(present(F.col(c)))) for k, c in (("title", "title"), ("company", "company"), ("source", "source"), ("uid", "uid"))},
    }
    return values.get(key, values["last_seen"])()


def commute_class(minutes: Column) -> Column:
    return F.when(minutes <= 30, "good").when(minutes <= 45, "mid").when(minutes <= 75, "warn").otherwise("bad")


def aggregators_closed(state: DataFrame, aggregators: tuple[str, ...] = AGGREGATORS) -> DataFrame:
    """Postings of aggregators that have not ended are closed."""
    hit = F.lower(F.trim(present(F.col("source")))).isin(*aggregators) & ~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    return state.withColumn("status", F.when(hit, "closed").otherwise(F.col("status")))


def after_send(state: DataFrame, sent: DataFrame, stamp: Column) -> DataFrame:
    """Postings whose uid was sent are notified, with the time."""
    uids = sent.select(F.col("uid").alias("_uid")).distinct()
    joined = state.join(uids, state["uid"] == uids["_uid"], "left")
    hit = F.col("_uid").isNotNull()
    return joined.withColumn("status", F.when(hit, "notified").otherwise(F.col("status"))).withColumn("last_sent_at", F.when(hit, stamp).otherwise(F.col("last_sent_at"))).drop("_uid")


def view_marked(state: DataFrame, marks: DataFrame, stamp: Column) -> DataFrame:
    """Marks of the view (uid, mark, and ord if given): open goes back to notified or new by whether it was sent; applied
    sets its time. Of several marks of one uid the last counts."""
    known = in_order(marks).filter(F.col("mark").isin("open", "applied", "ignored"))
    said = known.groupBy(F.col("uid").alias("_uid")).agg(F.max_by("mark", "ord").alias("_mark"))
    joined = state.join(said, state["uid"] == said["_uid"], "left")
    again = F.when(present(F.col("last_sent_at").cast("string")) != "", "notified").otherwise("new")
    status = F.when(F.col("_mark") == "open", again).otherwise(F.coalesce("_mark", "status"))
    at = F.when(F.col("_mark") == "applied", stamp).when(F.col("_mark").isNull(), F.col("applied_at"))
    return joined.withColumn("status", status).withColumn("applied_at", at).drop("_uid", "_mark")


def applied_upsert(state: DataFrame, sent: DataFrame, stamp: Column) -> DataFrame:
    """Applications sent (uid, title, company, location, source, link, document, archived, and ord if given) entered as
    applied, new ones inserted; records that nothing was sent for stay as they are, their documents included.

    A field that is empty in the application keeps its value, the canonical link and documents are the application's;
    of several of one uid the last counts. The time they were applied for by hand is not touched.
    """
    names = ("title", "company", "location", "source", "link")
    kept = ("canonical_url", "last_seen_at", "last_sent_at", "applied_at", "application_doc", "application_doc_archived", "application_sent_at")
    own = state.withColumns({c: F.lit(None).cast("string") for c in (*names, *kept, "first_seen_at") if c not in state.columns})
    given = in_order(sent.withColumns({c: F.lit(None).cast("string") for c in (*names, "document", "archived") if c not in sent.columns}))
    new = given.groupBy(F.col("uid").alias("_uid")).agg(F.max_by(F.struct(*names, "document", "archived"), "ord").alias("_new"))
    joined = own.join(new, own["uid"] == new["_uid"], "full_outer")
    hit = F.col("_uid").isNotNull()
    on_hit = lambda value, c: F.when(hit, value).otherwise(F.col(c))
    filled = lambda c: F.coalesce(F.nullif(F.col(f"_new.{c}"), F.lit("")), F.col(c))
    canonical = F.coalesce(F.nullif(state_canonical(F.col("_new.link")), F.lit("")), F.nullif("canonical_url", F.lit("")), F.lit(""))
    changed = {c: on_hit(filled(c), c) for c in names} | {c: on_hit(stamp, c) for c in ("last_seen_at", "last_sent_at", "application_sent_at")}
    changed |= {"status": on_hit(F.lit("applied"), "status"), "canonical_url": on_hit(canonical, "canonical_url"), "first_seen_at": on_hit(F.coalesce(F.nullif(F.col("first_seen_at").cast("string"), F.lit("")), stamp), "first_seen_at")}
    changed |= {"application_doc": on_hit(present(F.col("_new.document")), "application_doc"), "application_doc_archived": on_hit(present(F.col("_new.archived")), "application_doc_archived"), "uid": F.coalesce("uid", "_uid")}
    return joined.withColumns(changed).drop("_uid", "_new")


# The fields of a record, and the names under which a posting may give some of them, in their order
RECORD = ("uid", "source", "canonical_url", "link", "title", "company", "location", "first_seen_at", "last_seen_at", "last_sent_at", "status", "score", "match", "date", "commute_min", "missing_runs")
ALIASES = {
    "source": ("source", "portal", "origin", "site"), "link": ("link", "url", "apply_url", "applyLink"), "external_id": ("external_id", "job_id", "id"),
    "title": ("title", "job_title", "position"), "company": ("company", "employer"), "location": ("location", "city"),
}


def identified(rows: DataFrame) -> DataFrame:
    """Postings with uid and canonical_url, told by the link, else by the portal's own id, else by their texts.

    Each field is the first that isn't empty among its names; names that the rows don't have are passed over.
    """
    have = set(rows.columns)
    of = lambda field: F.coalesce(*(F.nullif(present(F.col(f"`{c}`").cast("string")), F.lit("")) for c in ALIASES[field] if c in have), F.lit(""))
    link, source = F.trim(of("link")), F.coalesce(F.nullif(F.trim(of("source")), F.lit("")), F.lit("unknown"))
    own = F.trim(of("external_id"))
    by_id = F.left(F.sha2(F.concat_ws("|", F.lit("id"), source, own), 256), F.lit(16))
    uid = F.when((state_canonical(link) == "") & (own != ""), by_id).otherwise(job_uid(source, link, of("title"), of("company"), of("location")))
    return rows.withColumns({"uid": uid, "canonical_url": state_canonical(link)})


def merged(state: DataFrame, batch: DataFrame, stamp: Column, most_missing: int = 3, most_days: int = 7) -> DataFrame:
    """The next state with every field of ``RECORD`` (all but missing_runs and commute_min as text).

    ``batch`` has uid, canonical_url, link and the fields of a posting. A record that came takes what the posting says
    and keeps what that leaves empty; a commute of 0 counts as said. Ages, closing and reopening are as in
    ``lifecycle.merge``; days count from a readable last_seen_at only. Of rows of one uid the last by ``ord`` (or as
    read) counts. An empty batch changes nothing, as a run that found nothing says nothing of the postings; null
    uids meet nothing and are dropped from the batch.
    """
    said = ("source", "canonical_url", "link", "title", "company", "location", "score", "match", "date", "commute_min")
    given = in_order(batch.withColumns({c: F.lit(None).cast("int" if c == "commute_min" else "string") for c in said if c not in batch.columns})).filter("uid is not null")
    came = given.groupBy(F.col("uid").alias("_uid")).agg(F.max_by(F.struct(*said), "ord").alias("_b"))
    joined = state.select(*RECORD).join(came, F.col("uid") == F.col("_uid"), "full_outer")
    hit, known = F.col("_uid").isNotNull(), F.col("uid").isNotNull()
    text = lambda c: F.nullif(F.col(f"_b.{c}").cast("string"), F.lit(""))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("new"))
    ended = status.isin(*TERMINAL)
    missing = F.coalesce("missing_runs", F.lit(0)) + 1
    days = F.coalesce(F.floor((F.unix_timestamp(moment(stamp)) - F.unix_timestamp(moment(F.col("last_seen_at")))) / 86400), F.lit(0))
    gone = F.lit(False)
    gone = gone | (missing >= most_missing) if most_missing > 0 else gone
    gone = gone | (days >= most_days) if most_days > 0 else gone
    again = F.when(present(F.col("last_sent_at")) != "", "notified").otherwise("new")
    empty = ("link", "title", "company", "location", "source", "score", "match", "date")
    changed = {c: F.when(hit, F.coalesce(text(c), F.when(known, F.col(c)), F.lit(""))).otherwise(F.col(c)) for c in empty}
    own_link = F.coalesce(text("link"), F.lit(""))
    changed["canonical_url"] = F.when(hit, F.coalesce(text("canonical_url"), F.nullif("canonical_url", F.lit("")), F.nullif(state_canonical(own_link), F.lit("")), own_link)).otherwise(F.col("canonical_url"))
    changed["commute_min"] = F.coalesce("_b.commute_min", "commute_min")
    changed["first_seen_at"] = F.when(known, F.col("first_seen_at")).otherwise(stamp)
    changed["last_seen_at"] = F.when(hit, stamp).otherwise(F.col("last_seen_at"))
    changed["missing_runs"] = F.when(hit, 0).when(ended, F.col("missing_runs")).otherwise(missing).cast("int")
    changed["status"] = F.when(~known, "new").when(hit & (status == "closed"), again).when(hit, status).when(~ended & gone, "closed").otherwise(F.col("status"))
    changed["uid"] = F.coalesce("uid", "_uid")
    after = joined.select(*(changed.get(c, F.col(c)).alias(c) for c in RECORD))
    # A batch without rows leaves the state alone, decided where the rows are: one flag of one row is all that is sent.
    some = given.select(F.lit(1).alias("_some")).limit(1)
    return after.join(F.broadcast(some), how="left_semi").unionByName(state.select(*RECORD).join(F.broadcast(some), how="left_anti"))


def alive(cache: DataFrame, now_seconds: float, hours: float) -> DataFrame:
    """Keys of searches known to be empty: readable times no older than the limit; none if the limit is off."""
    at = F.col("at").try_cast("double")
    return cache.filter(at.isNotNull() & (F.lit(now_seconds) - at <= hours * 3600)) if hours > 0 else cache.filter(F.lit(False))


def lock_active(age_minutes: Column, ttl: Column, daily: bool) -> Column:
    """Whether another run's lock holds: the daily run's below its limit, the mail run's up to it and never without one."""
    return age_minutes < ttl if daily else ~((ttl <= 0) | (age_minutes > ttl))


def mail_stats(state: DataFrame, sections: DataFrame, scraped: DataFrame | None = None, added: DataFrame | None = None, dry_run: bool = False, sent: bool = False) -> DataFrame:
    """Counts of a mail run in one row: the state's, those of the sections (uid, section), of the rows ``scraped`` (uid)
    and of those ``added`` to the state; what isn't given counts 0."""
    whole = state.agg(F.count(F.lit(1)).alias("state_total"), F.count_if(F.col("status") == "closed").alias("marked_closed_count"), F.count_if(F.col("status") == "applied").alias("applied_count"), F.count_if(F.col("status") == "ignored").alias("ignored_count"))
    seen = sections.agg(F.count_if(F.col("section") != "").alias("active_seen_this_run"), *(F.count_if(F.col("section") == s).alias(f"mailed_{s}_count") for s in ("new", "reminder")))
    found = whole.join(F.broadcast(seen))
    if scraped is not None:
        found = found.join(F.broadcast(scraped.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scraped_total"), F.count(F.lit(1)).alias("unique_total"))))
    if added is not None:
        found = found.join(F.broadcast(added.agg(F.count(F.lit(1)).alias("newly_added"))))
    missing = {c: F.lit(0).cast("long") for c in ("scraped_total", "unique_total", "newly_added") if c not in found.columns}
    return found.withColumns(missing | {"dry_run": F.lit(dry_run), "mail_sent": F.lit(sent)})


def saved(state: DataFrame, folder: str, version: int) -> str:
    """Writes a snapshot of the state as JSON lines, a folder for each version; returns its path."""
    path = f"{folder}/version={version}"
    state.write.mode("overwrite").json(path)
    return path


def nth_by(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``nth``, the place of a row within its key."""
    return frame.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
