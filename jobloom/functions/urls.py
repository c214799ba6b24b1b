"""URL canonicalisation, identifiers and classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import norm_state, present

PARTS = "(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*).*$"
# Query parameters that only track
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "ref", "from")
# Hosts and where their links carry an id
SOURCE_IDS = (
    ("jobs\\.ch", "/(\\d{6,})"),
    ("jobup\\.ch", "/(\\d{6,})"),
    ("jobscout24", "[?&]id=([^&]+)"),
    ("monster\\.", "/(\\d{6,})"),
    ("indeed\\.", "[?&]jk=([a-zA-Z0-9]+)"),
    ("itjobs\\.ch", "/(\\d{4,})"),
    ("ictjobs\\.ch", "/(\\d{4,})"),
    ("jobwinner", "/(\\d{4,})"),
    ("swissdevjobs", "/(\\d{4,})"),
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(present(url), PARTS, 2))


def state_canonical(url: Column) -> Column:
    """Lower-case scheme and host, path without one last slash, nothing behind; what is not absolute stays."""
    raw = F.trim(present(url))
    path = F.regexp_extract(raw, PARTS, 3)
    path = F.when(F.endswith(path, F.lit("/")) & (path != "/"), F.left(path, F.length(path) - 1)).otherwise(path)
    return F.when(raw.rlike(PARTS), F.concat(F.lower(F.regexp_extract(raw, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(raw, PARTS, 2)), path)).otherwise(raw)


def dedupe_canonical(url: Column) -> Column:
    """Fragment and tracking parameters dropped with the sign before them, scheme and host lower, query kept."""
    bare = F.regexp_replace(present(url), "(?s)#.*$", "")
    for name in TRACKING:
        bare = F.regexp_replace(bare, f"[?&]{name}=[^&]*", "")
    bare = F.regexp_replace(bare, "[?&]+$", "")
    pattern = "(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(.*)$"
    whole = F.concat(F.lower(F.regexp_extract(bare, pattern, 1)), F.lit("://"), F.lower(F.regexp_extract(bare, pattern, 2)), F.regexp_replace(F.regexp_extract(bare, pattern, 3), "/+$", ""), F.regexp_extract(bare, pattern, 4))
    return F.trim(F.when(bare.rlike(pattern), whole).otherwise(bare))


def bare_link(url: Column) -> Column:
    return F.regexp_replace(present(url), "(?s)[?#].*$", "")


def source_job_id(url: Column) -> Column:
    """The id of the first host whose pattern finds one, else a last path segment that looks like one."""
    raw = present(url)
    ids = [F.when(raw.rlike(f"(?i){at}"), F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))) for at, pattern in SOURCE_IDS]
    last = F.regexp_extract(F.regexp_replace(F.regexp_extract(raw, PARTS, 3), "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(*ids, F.when(last.rlike("^[\\w-]{4,}$"), last), F.lit(""))


def company_from_host(url: Column) -> Column:
    labels = F.split(F.regexp_replace(host(url), "^www\\.", ""), "\\.")
    name = F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0)))
    return F.coalesce(F.nullif(F.initcap(F.replace(name, F.lit("-"), F.lit(" "))), F.lit("")), F.lit("Unbekannt"))


def job_uid(source: Column, link: Column, title: Column, company: Column, location: Column) -> Column:
    """16 hex digits of SHA-256 over the link, or over the normalised fields where there is none."""
    where = F.coalesce(F.nullif(F.trim(present(source)), F.lit("")), F.lit("unknown"))
    url = state_canonical(link)
    other = F.concat_ws("|", F.lit("fallback"), where, norm_state(title), norm_state(company), norm_state(location), norm_state(link))
    return F.left(F.sha2(F.when(url != "", F.concat_ws("|", F.lit("url"), where, url)).otherwise(other), 256), F.lit(16))
