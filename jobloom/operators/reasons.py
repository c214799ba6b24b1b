"""The collector's chain of reasons to drop a posting; the first that holds is reported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import contains_any, in_order, norm_collector, present
from jobloom.functions.titles import backfilled
from jobloom.operators.ranking import last_scan
from jobloom.settling import settled
from jobloom.sources.html import detail_text
from jobloom.sources.portals import skipped_host


@dataclass(frozen=True)
class Rules:
    """Terms and places come normalised; an empty tuple switches a rule off."""

    remote: tuple[str, ...] = ()
    allow_remote: bool = True
    hard_places: tuple[str, ...] = ()
    search_places: tuple[str, ...] = ()
    allowed_places: tuple[str, ...] = ()
    strict: bool = False
    most_minutes: int = 0
    required: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    listing_sources: tuple[str, ...] = ()
    place_bonus: int = 2


def norm_key(title: Column, company: Column, link: Column) -> Column:
    """Letters, digits and underscores of title and company, and the link up to its query."""
    bare = [F.regexp_replace(F.lower(present(c)), "[^\\p{L}\\p{N}_]+", "") for c in (title, company)]
    return F.concat_ws("|", *bare, F.regexp_replace(F.lower(present(link)), "[?#].*$", ""))


def blocked_in(text: Column, terms) -> Column:
    """A term as it is, or the words of one in their order with gaps, in a normalised text."""
    hit = contains_any(text, terms)
    for term in terms:
        if " " in term:
            hit = hit | in_order(text, term)
    return hit


def required_in(text: Column, terms) -> Column:
    """Terms of at most two letters count as whole words only."""
    short = [t for t in terms if len(t) <= 2]
    hit = contains_any(text, [t for t in terms if len(t) > 2])
    return hit | F.arrays_overlap(F.split(text, " "), F.array(*(F.lit(t) for t in short))) if short else hit


def listing_link(link: Column) -> Column:
    """Links of result pages: without a digit, or with the listing word in the last two parts and no detail."""
    tail = F.array_join(F.slice(F.reverse(F.split(F.regexp_replace(present(link), "/+$", ""), "/")), 1, 2), "/")
    return ~present(link).rlike("\\d") | (F.contains(tail, F.lit("stellenangebote")) & ~F.contains(tail, F.lit("detail")))


# What a page says that is gone
GONE = ("404", "page not found", "seite nicht gefunden", "not found", "nicht gefunden", "job not found", "no longer available", "not available")


def page_facts(pages: DataFrame, rules: Rules, most_chars: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What scans of pages (url, html, and status if given) find, each page read once: links whose text has a blocked term,
    has a required term, or is gone (a status from 400 on, or a page that says so). Of a page's text the first
    ``most_chars`` characters count, as the scan's setting has it; several pages of one link count together."""
    html = F.left(present(F.col("html")), F.lit(most_chars))
    failed = F.coalesce(F.col("status") >= 400, F.lit(False)) if "status" in pages.columns else F.lit(False)
    read = pages.select(F.col("url").alias("link"), norm_collector(detail_text(html)).alias("text"), (failed | contains_any(F.lower(html), GONE)).alias("gone"))
    blocked = blocked_in(F.col("text"), rules.blocked) if rules.blocked else F.lit(False)
    required = required_in(F.col("text"), rules.required) if rules.required else F.lit(False)
    facts = settled(read.select("link", blocked.alias("blocked"), required.alias("required"), "gone"))
    return facts.filter("blocked").select("link"), facts.filter("required").select("link"), facts.filter("gone").select("link")


def collector_reasons(
    postings: DataFrame, rules: Rules, minutes: DataFrame | None = None, blocked_pages: DataFrame | None = None, dead_links: DataFrame | None = None,
    rescued_pages: DataFrame | None = None, most_blocked: int | None = None, most_rescued: int | None = None, dead_sources: tuple[str, ...] | None = None,
) -> DataFrame:
    """Postings (ord, title, raw_title, company, location, link, source) with back-filled fields and ``reason``.

    ``minutes`` (place, minutes) are travel times, ``blocked_pages`` and ``dead_links`` (link) what scans of pages
    found; ``rescued_pages`` are those whose page has a required term that the posting lacks. Of postings with one key the
    first that nothing else drops stays. ``most_blocked`` and ``most_rescued`` are budgets of distinct links: behind the
    row that uses up one nothing is scanned for it (None: no budget); hosts that are never read cost nothing and
    block nothing. Only links of ``dead_sources`` can be dead (None: all). Only ord and key are shuffled for duplicates.
    """
    own = backfilled(postings)
    # Three normal forms: of each place by itself, of all fields, and of the fields that blocked terms are looked for in.
    text = lambda *names: norm_collector(F.concat_ws(" ", *(present(F.col(c)) for c in names)))
    own = own.withColumns({"_spot": text("location", "title", "raw_title"), "_all": text("title", "raw_title", "company", "location", "link"), "_blob": text("title", "raw_title", "location")})
    lines = F.concat_ws("\u2028", *(present(F.col(c)) for c in ("location", "title", "raw_title")))
    own = own.withColumn("_places", F.array_join(F.transform(F.split(lines, "\u2028"), norm_collector), "\n"))
    for name, frame in (("_blocked", blocked_pages), ("_dead", dead_links), ("_rescued", rescued_pages)):
        if frame is None:
            own = own.withColumn(name, F.lit(False))
        else:
            hits = frame.select(F.col("link").alias("_link")).distinct().withColumn(name, F.lit(True))
            own = own.join(hits, own["link"] == hits["_link"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_link")
    remote = contains_any(F.col("_spot"), rules.remote)
    near = contains_any(F.col("_places"), rules.search_places) if rules.search_places else F.lit(True)
    allowed = contains_any(F.col("_places"), rules.allowed_places) if rules.allowed_places else F.lit(True)
    steps = []
    if not rules.allow_remote:
        steps.append((remote, "remote_blocked"))
    if rules.hard_places:
        steps.append((~contains_any(F.col("_places"), rules.hard_places), "hard_location"))
    travel = minutes is not None and rules.most_minutes > 0
    if travel:
        own = own.join(minutes.groupBy(F.col("place").alias("location")).agg(F.min("minutes").alias("_minutes")), "location", "left")
        far = F.col("_minutes").isNull() | (F.col("_minutes") > rules.most_minutes)
        steps += [(~remote & (F.col("location") != "") & far, "transit_blocked"), (~remote & (F.col("location") == "") & ~(near | allowed), "location_unknown")]
    if rules.strict:
        applies = remote if travel else F.lit(True)
        steps += [(applies & ~near, "local_mismatch"), (applies & ~allowed, "allowed_mismatch")]
    if rules.required:
        lacks = ~required_in(F.col("_all"), rules.required)
        if rescued_pages is not None and most_rescued is not None:
            reached = F.coalesce(*(F.when(hit, F.lit(True)) for hit, _ in steps), F.lit(False)) if steps else F.lit(False)
            cut = last_scan(own, "link", lacks & ~reached, "ord", most_rescued)
            own = own.join(F.broadcast(cut.withColumnRenamed("cut", "_rescues"))).withColumn("_rescued", F.col("_rescued") & (F.col("_rescues").isNull() | (F.col("ord") <= F.col("_rescues")))).drop("_rescues")
        steps.append((lacks & ~(F.col("_rescued") & (present(F.col("link")) != "")), "include_keywords"))
    if rules.companies:
        steps.append((F.lower("company").isin(*rules.companies), "company_blacklist"))
    if rules.blocked:
        steps.append((blocked_in(F.col("_blob"), rules.blocked), "blocked_keywords"))
    steps.append((F.col("_dead") & (F.lit(True) if dead_sources is None else F.coalesce(F.col("source").isin(*dead_sources), F.lit(False))), "aggregator_link"))
    if rules.listing_sources:
        steps.append((F.col("source").isin(*rules.listing_sources) & listing_link(F.col("link")), "category_link"))
    own = own.withColumn("_early", F.coalesce(*(F.when(hit, F.lit(name)) for hit, name in steps)))
    own = own.withColumn("_key", F.when(F.col("_early").isNull(), F.sha2(norm_key(F.col("title"), F.col("company"), F.col("link")), 256)))
    if most_blocked is not None:
        unread = skipped_host(F.col("link"), whole_domain=True)
        own = settled(own.withColumn("_blocked", F.col("_blocked") & ~unread))
        # Up to the budget's last row a run without one does the same, so its rows tell where the budget ends.
        free = own.filter("_key is not null and not _blocked").groupBy(F.col("_key").alias("_of")).agg(F.min("ord").alias("_free"))
        scanned = own.filter("_key is not null").join(free, own["_key"] == free["_of"], "left").filter("_free is null or ord <= _free")
        cut = last_scan(scanned, "link", ~unread, "ord", most_blocked).withColumnRenamed("cut", "_last")
        own = own.join(F.broadcast(cut)).withColumn("_blocked", F.col("_blocked") & (F.col("_last").isNull() | (F.col("ord") <= F.col("_last")))).drop("_last")
    first = own.filter("_key is not null and not _blocked").groupBy(F.col("_key").alias("_of")).agg(F.min("ord").alias("_first"))
    own = own.join(first, own["_key"] == first["_of"], "left")
    late = F.when(F.col("ord") > F.col("_first"), "duplicate").when(F.col("_blocked"), "detail_blocklist")
    own = own.withColumn("near_place", near & F.lit(bool(rules.search_places))).withColumn("allowed_place", allowed & F.lit(bool(rules.allowed_places)))
    return own.withColumn("reason", F.coalesce("_early", F.when(F.col("_key").isNotNull(), late))).drop("_places", "_all", "_blob", "_spot", "_blocked", "_dead", "_rescued", "_early", "_key", "_of", "_first", "_minutes")


def boosted(score: Column, location: Column, rules: Rules, allowed: Column, minutes: Column | None = None, most: int = 75, penalty: int = 5) -> Column:
    """The score with a point for a searched place, the bonus of an allowed one and less for long ways (0 at least)."""
    total = score + contains_any(norm_collector(location), rules.search_places).cast("int")
    total = total + F.when(allowed, rules.place_bonus).otherwise(0)
    return total if minutes is None else F.when(minutes >= most, F.greatest(total - penalty, F.lit(0))).otherwise(total)
