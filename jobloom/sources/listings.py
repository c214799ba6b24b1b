"""Postings out of saved pages: search results of portals page by page, result cards, and career pages of firms.

Pages are rows (or files, read by Spark's own reader, whose folders name source, query, place and page, so searches
that aren't asked for are never read). What one page holds is found inside its row; only links are shuffled, to keep
the first of equal ones and the first few of a search.

Null and empty pages hold nothing; a search without pages gives no rows; pages that are missing between others are
passed over, as failed ones are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions.text import contains_any, present
from jobloom.functions.titles import LABELS
from jobloom.functions.urls import bare_link, company_from_host
from jobloom.operators.ranking import title_score
from jobloom.settling import settled
from jobloom.sources import html, markup
from jobloom.sources.portals import CAREER, PAGED, PLACED, TOPIC_LINKS, TOPICS, detail_link, plain_detail_link, without_tracking

# What the targets of postings contain, in the order in which they are looked for
SELECTORS = ("/detail/", "/jobs/detail/", "/de/jobs/detail/", "/emploi/detail/", "/jobad/", "/job/")
# Words that date a line
DATED = "(?iU)\\b(heute|gestern|vorgestern|letzte woche|letzten monat|vor \\d+\\s*(tagen|wochen|monaten?))\\b"
# Words of a firm's links to postings, how such links never begin, and how many are taken of a site
CAREER_WORDS = ("career", "karriere", "stellen", "job", "jobs", "position", "positions", "vacancy", "vacancies")
OTHER_LINKS = ("mailto:", "tel:", "javascript:")
CAREER_LINKS = 40
SEARCH = ("source", "query", "place", "page")
COLUMNS = ("at", "title", "company", "location", "link", "raw_title", "date")


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages saved under source=/query=/place=/page=: source, query, place, page, html."""
    read = spark.read.option("wholetext", True).text(folder)
    return read.select(*(F.col(c).cast("string").alias(c) for c in SEARCH[:3]), F.col("page").cast("int").alias("page"), F.col("value").alias("html"))


def save_pages(pages: DataFrame, folder: str) -> None:
    """Writes pages (source, query, place, page, html), a file each, which ends in a line break."""
    pages.select(*SEARCH, F.col("html").alias("value")).repartition(*SEARCH).write.partitionBy(*SEARCH).text(folder)


def _base(source: Column) -> Column:
    """What links of a portal are seen from."""
    known = [(p[0], p[1].split("?")[0]) for p in PLACED] + [(t[0], t[1]) for t in TOPICS] + [(CAREER[0], CAREER[1].split("?")[0]), *PAGED]
    return F.coalesce(*(F.when(source == name, F.lit(url)) for name, url in known), F.lit(""))


def _own_link(source: Column, link: Column) -> Column:
    """Whether a link is of the portal's domain and pattern; portals without such rules take any."""
    rules = [(name, domain, pattern) for name, _, _, domain, pattern in PLACED] + [(name, name, pattern) for name, pattern in TOPIC_LINKS.items()]
    found = F.lit(True)
    for name, domain, pattern in rules:
        found = F.when(source == name, F.contains(link, F.lit(domain)) & link.rlike(pattern)).otherwise(found)
    return found


def selected_links(pages: DataFrame, base: str) -> DataFrame:
    """Links of postings by ``SELECTORS``, one after the other: the page's columns, at, title, link, raw_title; seen from
    the address in the column ``base``.

    A link's title is its first line that is neither label nor date, else its first; without text its label counts.
    Of equal bare links of a page the first stays, by selector and then by place.
    """
    rest = [c for c in pages.columns if c != "html"]
    rows = html.anchors(pages, base=base).withColumnRenamed("link", "_link").filter(plain_detail_link(F.col("_link")))
    hits = F.filter(F.transform(F.array(*map(F.lit, SELECTORS)), lambda s, i: F.when(F.contains(F.col("href"), s), i)), lambda i: i.isNotNull())
    shown = markup.lines(F.col("inner"))
    label = F.trim(present(markup.attribute(F.col("tag"), "aria-label")))
    rows = rows.withColumn("_lines", F.when(F.size(shown) > 0, shown).when(label != "", F.array(label)).otherwise(F.array().cast("array<string>"))).withColumn("_by", F.array_min(hits))
    noise = lambda x: x.rlike(f"(?iU)({'|'.join(LABELS)})") | x.rlike(DATED)
    title = F.coalesce(F.get(F.filter("_lines", lambda x: ~noise(x)), F.lit(0)), F.get("_lines", F.lit(0)))
    rows = rows.filter(F.col("_by").isNotNull() & (F.size("_lines") > 0)).select(*rest, (F.shiftleft(F.col("_by").cast("long"), 40) + F.col("at")).alias("at"), title.alias("title"), F.col("_link").alias("link"), F.array_join("_lines", "\n").alias("raw_title"))
    first = rows.groupBy(*rest, bare_link(F.col("link")).alias("_bare")).agg(F.min_by(F.struct("at", "title", "link", "raw_title"), "at").alias("_row"))
    return first.select(*rest, "_row.*")


def _structured(pages: DataFrame, plain: Column) -> DataFrame:
    """JSON-LD rows of pages that link to one posting, by the plain rule or by that of the link's host."""
    rows = html.json_ld_rows(pages, only_details=False)
    rule = F.when(plain, plain_detail_link(F.col("link"))).otherwise(detail_link(F.col("link")))
    place = F.when(plain, F.col("location")).otherwise(F.coalesce(F.nullif("location", F.lit("")), F.trim(present(F.col("place")))))
    return rows.filter((F.col("link") != "") & rule).withColumn("location", place).withColumn("raw_title", F.col("title"))


def portal_rows(pages: DataFrame, limit: int | None = 25) -> DataFrame:
    """Postings of saved search pages (source, query, place, page, html): source, query, place, page, at and ``COLUMNS``.

    A page's JSON-LD postings count, and where it has none its links. Portals of several pages are read up to the first
    page without postings, equal bare links once a search; of others the first page is read, equal links but for
    tracking once a page of links. Then the first ``limit`` of a search stay.
    """
    several = F.coalesce(F.col("source").isin(*(name for name, _ in PAGED)), F.lit(False))
    read = pages.select(*SEARCH, _base(F.col("source")).alias("base"), "html").filter(several | (F.col("page") == 1))
    search = list(SEARCH)
    structured = settled(_structured(read, several).select(*search, *COLUMNS))
    same = lambda frame: frame.select(*(F.col(c).alias(f"_{c}") for c in search)).distinct()
    bare = same(structured)
    unstructured = lambda links: links.join(bare, F.expr(" and ".join(f"{c} <=> _{c}" for c in search)), "left_anti")
    whole = lambda links, place: links.select(*search, "at", "title", F.lit("").alias("company"), place.alias("location"), "link", "raw_title", F.lit("").alias("date"))

    by_selector = whole(selected_links(read.filter(several), "base"), F.lit(""))
    rows = html.anchors(read.filter(~several), base="base").filter((F.col("href") != "") & (F.length("text") >= 6))
    rows = rows.filter(detail_link(F.col("link")) & _own_link(F.col("source"), F.col("link")))
    first = rows.groupBy(*search, without_tracking(F.col("link")).alias("_key")).agg(F.min_by(F.struct(F.col("at").cast("long").alias("at"), F.col("text").alias("title"), "link", F.col("text").alias("raw_title")), "at").alias("_row"))
    by_rule = whole(first.select(*search, "_row.*"), present(F.col("place")))

    every = settled(structured.withColumn("at", F.col("at").cast("long")).unionByName(unstructured(by_selector.unionByName(by_rule))))
    site = F.to_json(F.struct(*SEARCH[:3]))
    paged = html.paged_rows(every.filter(several).withColumn("site", site), read.filter(several).select(site.alias("site"), "page", (present(F.col("html")) == "").alias("failed")), limit).drop("site")
    single = every.filter(~several)
    if limit is not None and limit > 0:
        place = F.row_number().over(Window.partitionBy(*search).orderBy("at"))
        single = single.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
    return single.unionByName(paged.select(*single.columns))


def result_cards(pages: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], limit: int | None = 25) -> DataFrame:
    """Cards of a page of results: the page's columns, at, title, company, location, link, score, match.

    A card is an anchor of class tapItem with a target; its title is the element made for it, else all its text. The
    first ``limit`` cards of a page stay.
    """
    rest = [c for c in pages.columns if c != "html"]
    cards = F.filter(markup.anchors(F.col("html")), lambda a: markup.of_class(a["tag"], "tapItem"))
    some = F.slice(cards, 1, limit) if limit is not None else cards
    rows = pages.select(*rest, F.posexplode(some).alias("at", "card"))
    inner = F.col("card.inner")
    said = lambda tag, name: markup.element_text(inner, tag, name)
    rows = rows.select(*rest, "at", F.coalesce(said("span", "jobTitle"), markup.joined_text(inner)).alias("title"), present(said("span", "companyName")).alias("company"), present(said("div", "companyLocation")).alias("location"), F.col("card.href").alias("link"))
    score, label = title_score(F.col("title"), positive, negative)
    return rows.withColumn("score", score).withColumn("match", label)


def career_rows(pages: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], words: tuple[str, ...] = CAREER_WORDS, least: int = 0, limit: int = CAREER_LINKS) -> DataFrame:
    """Links of career pages (site, url, company, html) that look like postings: site, at, title, company, link, score, match.

    Of equal links of a site the first counts, with its text. A link must have one of the words in itself or its text,
    or a score above 0, and at least the least score; the first ``limit`` of a site stay. Without a company the
    host names it, without a text the link's last part the posting.
    """
    base = F.col("url")
    rows = html.anchors(pages.select("site", "url", "company", "html"), base="url")
    other = F.lit(False)
    for begin in OTHER_LINKS:
        other = other | F.startswith(F.col("href"), F.lit(begin))
    rows = rows.filter((F.col("href") != "") & ~other & (F.col("link") != base))
    company = F.coalesce(F.nullif("company", F.lit("")), company_from_host(base))
    first = rows.select("site", company.alias("company"), "at", "text", "link").groupBy("site", "link").agg(F.min_by(F.struct("at", "text", "company"), "at").alias("_row")).select("site", "link", "_row.*")
    score, label = title_score(F.coalesce(F.nullif("text", F.lit("")), F.col("link")), positive, negative)
    scored = first.withColumn("score", score).withColumn("match", label)
    told = contains_any(F.lower("link"), words) | contains_any(F.lower("text"), words) | (F.col("score") > 0) if words else F.lit(True)
    kept = scored.filter(told & (F.col("score") >= least)).withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter(F.col("_n") <= limit)
    title = F.coalesce(F.nullif("text", F.lit("")), F.regexp_extract("link", "([^/]*)$", 1))
    return kept.select("site", "at", title.alias("title"), "company", "link", "score", "match")
