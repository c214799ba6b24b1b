"""Portals: search URLs, detail-link rules by host, source names and links without tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import contains_any, norm_topic, present

SUPPORT = ("support", "helpdesk", "1st level", "2nd level", "desktop", "workplace")
ADMINS = ("administrator", "system admin", "systemadministrator")
ENGINEERS = ("system engineer", "netzwerk", "network", "infrastruktur")
SECURITY = ("security", "cyber")
# Portals that search by word and place (source, address up to the word, name of the place, own domain, patterns of their links)
PLACED = (
    ("jobscout24", "https://www.jobscout24.ch/de/jobs/?term=", "place", "jobscout24.ch", "(?i)/de/job/[0-9a-f-]+/?$"),
    ("jobwinner", "https://www.jobwinner.ch/jobs/?q=", "l", "jobwinner.ch", "(?i)/(de/)?job/\\d+/?$"),
    ("careerjet", "https://www.careerjet.ch/suchen/stellenangebote?s=", "l", "careerjet.ch", "/jobad/"),
    ("jobrapido", "https://ch.jobrapido.com/?w=", "l", "jobrapido.com", "jobrapido"),
    ("monster", "https://www.monster.ch/jobs/suche/?q=", "where", "monster.ch", "/job/|/stellenangebot/"),
    ("jora", "https://ch.jora.com/j?q=", "l", "jora.com", "/job/|/j\\?"),
    ("jooble", "https://ch.jooble.org/SearchResult?ukw=", "rgns", "jooble.org", "/\\d+|/job/|/SearchResult/"),
)
# Portals that take a topic instead (source, address, words to path in their order, path of all others)
TOPICS = (
    ("ictjobs.ch", "https://ictjobs.ch/stellen/it-jobs/", ((SUPPORT, "it-support/"), (ADMINS, "it-administrator/"), (ENGINEERS, "system-engineer/"), (SECURITY, "it-security/")), ""),
    ("itjobs.ch", "https://www.itjobs.ch/jobs/", ((SUPPORT, "user-help-desk-support-training"), (ADMINS, "system-administration"), (ENGINEERS, "system-engineering"), (SECURITY, "security-audit")), "in-switzerland"),
    (
        "swissdevjobs.ch", "https://swissdevjobs.ch/jobs/",
        ((SUPPORT, "Support/all"), (("system", "administrator", "system admin", "systemadministrator", "netzwerk", "network"), "System/all"), (SECURITY, "Security/all"), (("devops", "cloud", "azure", "m365", "microsoft 365"), "DevOps/all")), "IT/all",
    ),
    ("myitjob.ch", "https://myitjob.ch/", (), ""),
)
# Own domain and pattern of the links of portals that take a topic or a word alone
TOPIC_LINKS = {
    "ictjobs.ch": "ictjobs\\.ch/[^/]+/[^/]+/?$", "itjobs.ch": "itjobs\\.ch/jobs/\\d+-[^/]+/?$", "swissdevjobs.ch": "swissdevjobs\\.ch/jobs/[^/?#]+$",
    "ictcareer.ch": "ictcareer\\.ch/en/job/\\d+", "myitjob.ch": "myitjob\\.ch/job/[^/?#]+/?$",
}
# Portals of which several pages are read, with their addresses
PAGED = (("jobs.ch", "https://www.jobs.ch/de/stellenangebote/"), ("jobup.ch", "https://www.jobup.ch/de/jobs/"))
CAREER = ("ictcareer.ch", "https://ictcareer.ch/en/jobs?q=")
# Names of sources and the one each goes by
ALIASES = {
    "jobs": "jobs.ch", "jobs.ch": "jobs.ch", "jobup": "jobup.ch", "jobup.ch": "jobup.ch", "jobscout24": "jobscout24", "jobscout24.ch": "jobscout24", "jobwinner": "jobwinner", "jobwinner.ch": "jobwinner",
    "monster": "monster", "monster.ch": "monster", "careerjet": "careerjet", "careerjet.ch": "careerjet", "jobrapido": "jobrapido", "jobrapido.com": "jobrapido", "jooble": "jooble", "jooble.org": "jooble",
    "jora": "jora", "jora.com": "jora", "indeed": "indeed", "indeed.ch": "indeed", "indeed.com": "indeed",
}
# Keys of a query that only track, and hosts whose pages are never read
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term", "yclid")
SKIPPED = ("jobrapido.com", "jooble.org", "jora.com", "careerjet.ch", "jobwinner.ch", "monster.ch")
# Hosts with a rule of their own for the path of one posting; those without a pattern go by parts
HOST_PATHS = (
    ("jobscout24.ch", "^/de/job/[0-9a-f-]+/?$"),
    ("jobwinner.ch", "^/(de/)?job/[0-9]+/?$"),
    ("itjobs.ch", "^/jobs/[0-9]+-[^/]+/?$"),
    ("ictjobs.ch", ""),
    ("swissdevjobs.ch", ""),
)
GUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NUMBER = "/[0-9]{6,}(/|$)"


def quoted(text: Column) -> Column:
    """For a URL's query: blanks as plus signs; a tilde stays and an asterisk doesn't."""
    return F.replace(F.replace(F.url_encode(present(text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_tasks(spark: SparkSession, queries: DataFrame, places: DataFrame) -> DataFrame:
    """source, query, place, url of every search: portals with places times queries times places, others times queries.

    ``queries`` (query) and ``places`` (place) are lists of settings; every portal is a column expression, no loop.
    """
    by_place = queries.crossJoin(places)
    found = None
    for source, start, name, *_ in PLACED:
        trimmed = (lambda c: F.trim(c)) if source == "jooble" else (lambda c: c)
        one = by_place.select(F.lit(source).alias("source"), "query", "place", F.concat(F.lit(start), quoted(trimmed(F.col("query"))), F.lit(f"&{name}="), quoted(trimmed(F.col("place")))).alias("url"))
        found = one if found is None else found.unionByName(one)
    for source, url in [(t[0], topic_url(F.col("query"), t[0])) for t in TOPICS] + [(CAREER[0], F.concat(F.lit(CAREER[1]), quoted(F.trim("query"))))]:
        found = found.unionByName(queries.select(F.lit(source).alias("source"), "query", F.lit("").alias("place"), url.alias("url")))
    return found


def topic_url(query: Column, source: str) -> Column:
    """The page of the first topic one of whose words the query has."""
    _, start, topics, other = next(t for t in TOPICS if t[0] == source)
    path = F.lit(other)
    for words, to in reversed(topics):
        path = F.when(contains_any(norm_topic(query), words), to).otherwise(path)
    return F.concat(F.lit(start), path)


def joined_words(words: Column, most: int = 8) -> Column:
    """The first words joined by OR, those of several words quoted."""
    kept = F.filter(F.transform(F.slice(words, 1, most), lambda w: F.trim(w)), lambda w: w != "")
    return F.array_join(F.transform(kept, lambda w: F.when(F.contains(w, F.lit(" ")), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w)), " OR ")


def without_words(words: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), lambda w: F.concat(F.lit("-"), w)), " ")


# Labels of the search pages and their addresses; {w} word, {p} place, {r} radius
PAGES = (
    ("Indeed • Junior/1st Level", "https://ch.indeed.com/jobs?q={w}&l={p}&radius={r}&fromage=7"),
    ("jobs.ch • IT Support", "https://www.jobs.ch/de/stellenangebote/?term={w}&location={p}"),
    ("JobScout24 • IT Support", "https://www.jobscout24.ch/de/jobs/?term={w}&place={p}"),
    ("Talent.com • IT Support", "https://ch.talent.com/de/jobs?k={w}&l={p}"),
    ("jobup.ch • IT Support", "https://www.jobup.ch/de/jobs/?term={w}&location={p}"),
    ("yellowshark • IT Support", "https://yellowshark.com/de/jobs?what={w}&where={p}&distance={r}"),
    ("Adecco • IT Support", "https://www.adecco.ch/de-ch/jobs?k={w}&l={p}&distance={r}"),
    ("JobWinner • Aggregator", "https://www.jobwinner.ch/jobs/?q={w}&l={p}"),
    ("Careerjet • Aggregator", "https://www.careerjet.ch/suchen/stellenangebote?s={w}&l={p}"),
    ("Jobrapido • Aggregator", "https://ch.jobrapido.com/?w={w}&l={p}"),
    ("Monster • Jobs", "https://www.monster.ch/jobs/suche/?q={w}&where={p}"),
    ("Jora • Aggregator", "https://ch.jora.com/j?q={w}&l={p}"),
    ("Jooble • Aggregator", "https://ch.jooble.org/SearchResult?ukw={w}&rgns={p}"),
)
LINKEDIN = ("LinkedIn • Entry-Level IT", "https://www.linkedin.com/jobs/search/?keywords={w}&location={p}&distance={r}&f_E=2")


def search_pages(settings: DataFrame) -> DataFrame:
    """``settings`` (id, words, variants, negative: arrays; place; radius) with one row for each portal: id, label, url."""
    word, place = F.coalesce(F.trim(F.get("words", F.lit(0))), F.lit("IT Support")), F.trim("place")
    whole = F.trim(F.concat_ws(" ", joined_words(F.concat("words", "variants")), without_words(F.col("negative"))))

    def filled(pattern: str, w: Column, p: Column) -> Column:
        for mark, by in (("{w}", quoted(w)), ("{p}", quoted(p)), ("{r}", F.col("radius").cast("string"))):
            url = F.replace(F.lit(pattern) if mark == "{w}" else url, F.lit(mark), by)  # noqa: F821
        return url

    pages = [F.struct(F.lit(label).alias("label"), filled(pattern, word, place).alias("url")) for label, pattern in PAGES]
    first = F.struct(F.lit(LINKEDIN[0]).alias("label"), filled(LINKEDIN[1], whole, F.concat(place, F.lit(", Schweiz"))).alias("url"))
    return settings.select("id", F.explode(F.array(first, *pages)).alias("page")).select("id", "page.label", "page.url")


def _parts(link: Column) -> tuple[Column, Column]:
    """Host and path of a lower-case link; a link without a scheme is a path."""
    low = F.lower(F.trim(present(link)))
    rest = F.regexp_replace(low, "^[a-z][a-z0-9+.-]*:", "")
    host = F.regexp_extract(rest, "^//([^/?#]*)", 1)
    return host, F.regexp_extract(F.regexp_replace(rest, "^//[^/?#]*", ""), "^[^?#]*", 0)


def plain_detail_link(link: Column) -> Column:
    """Whether a link looks like one posting, whatever its host."""
    return F.lower(present(link)).rlike(f"/detail/|/job/|/jobad/|{GUID}|{NUMBER}")


def detail_link(link: Column) -> Column:
    """Whether a link is one posting: by the rule of its host if that has one, else by its path."""
    host, path = _parts(link)
    low = F.lower(present(link))
    found = path.rlike("/detail/|/job/|/jobad/|/stellenangebot|/jobs/[^/]") | low.rlike(f"{GUID}|{NUMBER}")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, two = F.get(parts, F.lit(0)), F.size(parts) == 2
    rules = {
        "ictjobs.ch": two & ~F.coalesce(first.isin("stellen", "arbeitsort", "contact-info"), F.lit(False)),
        "swissdevjobs.ch": two & (first == "jobs") & (F.get(parts, F.lit(1)) != "all"),
    }
    for name, pattern in reversed(HOST_PATHS):
        found = F.when(F.contains(host, F.lit(name)), rules.get(name, path.rlike(pattern))).otherwise(found)
    return F.coalesce(found, F.lit(False))


def skipped_host(link: Column, whole_domain: bool = False) -> Column:
    """Whether a link's host is one whose pages are not read; with ``whole_domain`` equal to it or below it."""
    host = F.regexp_replace(_parts(link)[0], "^[^@]*@|:[0-9]*$", "")
    hit = F.lit(False)
    for name in SKIPPED:
        hit = hit | ((host == name) | F.endswith(host, F.lit(f".{name}")) if whole_domain else F.contains(host, F.lit(name)))
    return hit


def without_tracking(link: Column) -> Column:
    """The link without fragment and tracking keys; what stays of its query is encoded anew."""
    raw = present(link)
    query = F.regexp_extract(F.regexp_replace(raw, "(?s)#.*$", ""), "(?s)\\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "(?s)^([^=]*)", 1).alias("k"), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1).alias("v")))
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    kept = F.filter(F.transform(pairs, lambda p: F.struct(plain(p["k"]).alias("k"), plain(p["v"]).alias("v"))), lambda p: (p["k"] != "") & ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    again = F.array_join(F.transform(kept, lambda p: F.concat(quoted(p["k"]), F.lit("="), quoted(p["v"]))), "&")
    return F.concat(F.regexp_replace(raw, "(?s)[?#].*$", ""), F.when(again != "", F.concat(F.lit("?"), again)).otherwise(""))


def source_name(name: Column) -> Column:
    """The name a source goes by, from a name or a URL."""
    raw = F.lower(F.trim(present(name)))
    raw = F.when(F.contains(raw, F.lit("://")), F.coalesce(F.nullif(_parts(raw)[0], F.lit("")), raw)).otherwise(raw)
    raw = F.btrim(F.trim(F.replace(raw, F.lit("www."), F.lit(""))), F.lit("/"))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, raw), raw)


def allowed_sources(sources: DataFrame, enabled: tuple[str, ...], blocked: tuple[str, ...], aggregators: tuple[str, ...] = (), with_aggregators: bool = False) -> DataFrame:
    """Rows (source) that are enabled and not blocked; aggregators only if asked for."""
    name = F.lower("source")
    kept = name.isin(*enabled) if enabled else F.lit(True)
    if blocked:
        kept = kept & ~name.isin(*blocked)
    return sources.filter(kept if with_aggregators or not aggregators else kept & ~name.isin(*aggregators))
