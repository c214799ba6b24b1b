"""Postings out of HTML pages: anchors, link rows and JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import once, present
from jobloom.functions.urls import bare_link
from jobloom.sources import markup
from jobloom.sources.markup import cut_kept, unescaped
from jobloom.sources.portals import detail_link, plain_detail_link

ORIGIN = "^([A-Za-z][A-Za-z0-9+.-]*:)//[^/?#]*"
# Links taken of a site
SITE_LINKS = 25
SCRIPT = "(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
#: How deep graphs may lie in graphs.
GRAPHS = 4


def _steps(path: Column) -> Column:
    """A path without its steps "." and "..", which end in a slash where they come last; none leads above the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    whole = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(path.rlike("(^|/)[.]{1,2}(/|$)"), F.concat(whole, F.when(last, "/").otherwise(""))).otherwise(path)


def absolute(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: its own scheme, host, path or query where it has one, steps in the path resolved."""
    origin = F.regexp_extract(base, ORIGIN, 0)
    path = F.regexp_extract(F.regexp_replace(F.regexp_replace(base, ORIGIN, ""), "(?s)[?#].*$", ""), "(?s)^(.*/)?", 0)
    folder = F.when(path == "", "/").otherwise(path)
    own, rest = F.regexp_extract(href, "(?s)^[^?#]*", 0), F.regexp_extract(href, "(?s)[?#].*$", 0)
    return (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, ORIGIN, 1), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(bare_link(base), href))
        .otherwise(F.concat(origin, _steps(F.when(F.startswith(href, F.lit("/")), own).otherwise(F.regexp_replace(F.concat(folder, own), "/{2,}", "/"))), rest))
    )


def anchors(pages: DataFrame, html: str = "html", base: str | None = None) -> DataFrame:
    """One row a link with its place ``at``, ``href``, visible ``text``, start ``tag`` and ``inner`` tokens, and with ``base`` (a
    column) the absolute ``link``; the page itself is not carried along.

    All of them are worked out before links become rows, so that no filter on them repeats the work.
    """
    rest = [c for c in pages.columns if c != html]

    def row(a: Column) -> Column:
        own = [F.trim(a["href"]).alias("href"), markup.joined_text(a["inner"]).alias("text"), a["tag"].alias("tag"), a["inner"].alias("inner")]
        return F.struct(*own, *([once(F.trim(a["href"]), lambda h: absolute(F.col(base), h)).alias("link")] if base else []))

    rows = pages.select(*rest, F.posexplode(F.transform(markup.anchors(F.col(html)), row)).alias("at", "_a"))
    return rows.select(*rest, "at", "_a.*")


def link_rows(pages: DataFrame, page: str = "page_id", base: str = "url", domain: str = "", patterns: tuple[str, ...] = (), only_details: bool = True, limit: int | None = None, plain: bool = False) -> DataFrame:
    """Links of postings: page, at, title, link. Of equal bare links of a page the first stays, then ``limit`` a page."""
    rows = anchors(pages, base=base).filter((F.col("href") != "") & (F.length("text") >= 6))
    if domain:
        rows = rows.filter(F.contains("link", F.lit(domain)))
    if only_details:
        rows = rows.filter((plain_detail_link if plain else detail_link)(F.col("link")))
    if patterns:
        rows = rows.filter(F.col("link").rlike("|".join(f"(?:{p})" for p in patterns)))
    first = rows.groupBy(page, bare_link(F.col("link")).alias("bare")).agg(F.min_by(F.struct("at", "text", "link"), "at").alias("row"))
    kept = first.select(page, "row.at", F.col("row.text").alias("title"), F.col("row.link").alias("link"))
    if limit is not None:
        from pyspark.sql import Window

        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("at"))).filter(F.col("_n") <= limit).drop("_n")
    return kept


def _member(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def _said(item: Column, path: str) -> Column:
    """A member that is a text, trimmed; empty for objects, lists and what isn't there."""
    value = F.trim(present(_member(item, path)))
    return F.when(value.rlike("^[\\[{]"), "").otherwise(value)


def _graph(item: Column) -> Column:
    return _member(item, "$['@graph']", "array<variant>")


def _unfolded(value: Column) -> Column:
    """The objects of a parsed script: its own, then those of graphs, level by level."""
    level = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    found = F.filter(level, lambda x: _graph(x).isNull())
    for _ in range(GRAPHS):
        level = F.flatten(F.transform(F.filter(level, lambda x: _graph(x).isNotNull()), _graph))
        found = F.concat(found, F.filter(level, lambda x: _graph(x).isNull()))
    return found


def _is_posting(item: Column) -> Column:
    kinds = F.coalesce(_member(item, "$['@type']", "array<string>"), F.array(_member(item, "$['@type']")))
    return F.coalesce(F.array_contains(kinds, "JobPosting"), F.lit(False))


def json_ld_rows(pages: DataFrame, html: str = "html", only_details: bool = True) -> DataFrame:
    """One row a JSON-LD posting with a title and a link to one posting: the page's columns, at, title, company,
    location, link, date. Scripts that are no JSON are skipped, graphs opened level by level."""
    rest = [c for c in pages.columns if c != html]
    scripts = F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), 1), lambda s: F.try_parse_json(F.trim(s)))
    found = F.flatten(F.transform(F.filter(scripts, lambda v: v.isNotNull()), _unfolded))
    items = pages.filter(F.contains(F.lower(html), F.lit("ld+json"))).select(*rest, F.posexplode(F.filter(found, _is_posting)).alias("at", "item"))
    item = F.col("item")
    place = lambda name: F.coalesce(F.nullif(_said(item, f"$.jobLocation[0].address.{name}"), F.lit("")), F.nullif(_said(item, f"$.jobLocation.address.{name}"), F.lit("")))
    links = F.filter(F.coalesce(_member(item, "$.url", "array<string>"), F.array(_member(item, "$.url"))), lambda u: F.trim(present(u)) != "")
    first = lambda *options: F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))
    rows = items.select(
        *rest,
        "at",
        first(_said(item, "$.title"), _said(item, "$.jobTitle")).alias("title"),
        first(_said(item, "$.hiringOrganization.name"), _said(item, "$.hiringOrganization")).alias("company"),
        F.concat_ws(", ", place("addressLocality"), place("addressRegion"), place("addressCountry")).alias("location"),
        first(F.trim(F.get(links, F.lit(0))), _said(item, "$.hiringOrganization.sameAs")).alias("link"),
        _said(item, "$.datePosted").alias("date"),
    ).filter(F.col("title") != "")
    if only_details:
        rows = rows.filter(detail_link(F.col("link")))
    return rows


# Members of a posting that make its text, and parts of a page that are none of it
LD_TEXTS = ("title", "description", "qualifications", "skills", "experienceRequirements", "responsibilities")
LD_PLACES = ("addressLocality", "addressRegion", "addressCountry")
NOISE = "(?is)<(header|nav|footer|aside|form|noscript|svg)[^>]*>.*?</\\1>"
MAIN = "(?is)<(main|article)[^>]*>(.*?)</\\1>"


def _text_member(item: Column, path: str) -> Column:
    """A member that is a text and not blank, as it stands; null for all else."""
    value = F.when(F.schema_of_variant(_member(item, path, "variant")) == "STRING", _member(item, path))
    return F.when(F.trim(value) != "", value)


def _posting_text(item: Column) -> Column:
    places = [F.coalesce(_text_member(item, f"$.jobLocation[0].address.{p}"), _text_member(item, f"$.jobLocation.address.{p}")) for p in LD_PLACES]
    return F.concat_ws(" ", *(_text_member(item, f"$.{name}") for name in LD_TEXTS), _text_member(item, "$.hiringOrganization.name"), *places)


def detail_text(html: Column, cut: bool = False) -> Column:
    """What a detail page says of its posting: the texts of JSON-LD postings, else of its main parts, else of the page.

    Empty for null and empty pages; scripts that are no JSON count as none. With ``cut``, references that a tag cuts off
    stay as they are.
    """
    page = present(html)
    scripts = F.transform(F.regexp_extract_all(F.when(F.contains(F.lower(page), F.lit("ld+json")), page), F.lit(SCRIPT), 1), lambda s: F.try_parse_json(F.trim(s)))
    postings = F.filter(F.flatten(F.transform(F.filter(scripts, lambda v: v.isNotNull()), _unfolded)), _is_posting)
    structured = F.array_join(F.filter(F.transform(postings, _posting_text), lambda x: x != ""), " ")
    bare = F.regexp_replace(F.regexp_replace(page, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), NOISE, " ")
    bare = cut_kept(bare) if cut else bare
    parts = F.regexp_extract_all(bare, F.lit(MAIN), 2)
    shown = unescaped(F.regexp_replace(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(bare), "(?s)<[^>]+>", " "))
    return F.coalesce(F.when(F.trim(structured) != "", structured), shown)


def paged_rows(rows: DataFrame, pages: DataFrame, limit: int | None = SITE_LINKS) -> DataFrame:
    """Rows (site, page, at, link and others) of fetched ``pages`` (site, page, failed) up to a site's first page without rows.

    A failed page is passed over. Of equal bare links of a site the first stays, then ``limit`` a site; null or no
    positive number is no limit. Null sites are a site of their own, links without a text are kept as the empty link.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(F.col("site").alias("s"), F.col("page").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    read = pages.join(counts, F.col("site").eqNullSafe(F.col("s")) & (F.col("page") == F.col("p")), "left")
    ends = read.filter(F.col("n").isNull() & ~F.col("failed")).groupBy(F.col("site").alias("s")).agg(F.min("page").alias("end"))
    before = rows.join(ends, F.col("site").eqNullSafe(F.col("s")), "left").filter(F.col("end").isNull() | (F.col("page") < F.col("end"))).drop("s", "end")
    first = before.groupBy("site", bare_link(present(F.col("link"))).alias("bare")).agg(F.min_by(F.struct(*(c for c in rows.columns if c != "site")), F.struct("page", "at")).alias("row"))
    kept = first.select("site", "row.*")
    if limit is None or limit <= 0:
        return kept
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page", "at"))).filter(F.col("n") <= limit).drop("n")


def rows_or_links(pages: DataFrame, page: str = "page_id", **options) -> DataFrame:
    """A page's JSON-LD rows if it has any, else its link rows: page, at, title, link."""
    structured = json_ld_rows(pages).select(page, "at", "title", "link")
    links = link_rows(pages, page, **options)
    return structured.unionByName(links.join(structured.select(page).distinct(), page, "left_anti"))
