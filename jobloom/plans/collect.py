"""Queries for multi-line titles, the collector's reasons, HTML sources and digest texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import titles
from jobloom.operators import digest, reasons
from jobloom.plans.parity import _FOLD_COLLECTOR, query, table
from jobloom.sources import contacts, html

_WORD = lambda words: f"(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])"
_LINES = "list_filter(list_transform(string_split_regex(coalesce({0}, ''), '\\r\\n|[\\n\\v\\f\\r]'), lambda x: regexp_replace(trim(regexp_replace(regexp_replace(x, '^\\s*\\d+\\.\\s*\\[[^\\]]+\\]\\s*', ''), '^\\s+|\\s+$', '', 'g'), '\"'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_NOISE = f"regexp_matches(x, '(?i)({'|'.join(titles.LABELS)})') OR regexp_matches(x, '(?i)^ref[:\\s]') OR regexp_matches(x, '{_WORD(titles.AGES)}')"


def _parts(source: str, raw: str) -> str:
    """SQL: the rows of ``source`` with t_title, t_company and t_place."""
    return f"""SELECT * REPLACE (CASE WHEN t_place = t_company THEN '' ELSE t_place END AS t_place) FROM (
  SELECT *, coalesce(clean[1], '') AS t_title,
    coalesce(list_filter(clean, lambda x: regexp_matches(x, '{_WORD(titles.LEGAL_FORMS)}'))[-1], CASE WHEN len(clean) >= 2 AND clean[-1] <> clean[1] THEN clean[-1] END, '') AS t_company,
    coalesce(nullif(ls[list_position(list_transform(ls, lambda x: starts_with(lower(x), 'arbeitsort')), true) + 1], ''), list_filter(clean[2:], lambda x: regexp_matches(x, '{_WORD(titles.PLACES)}'))[1], '') AS t_place
  FROM (SELECT *, list_filter(ls, lambda x: NOT ({_NOISE})) AS clean FROM (SELECT *, {_LINES.format(raw)} AS ls FROM {source})))"""


@query(f"SELECT doc_id, t_title, t_company, t_place FROM ({_parts('documents', 'text')})")
def multiline_title(spark, sf_dir):
    return titles.title_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")).drop("text")


RULES = reasons.Rules(
    remote=("remote", "home office"), allow_remote=False, search_places=("the", "die", "que"), strict=True, required=("of", "und", "de", "ment"),
    companies=("src3",), blocked=("the of", "idiot"), listing_sources=("src1",),
)
_POSTINGS = "SELECT page_id AS ord, '' AS title, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'src' || page_id % 5 END AS company, CASE WHEN page_id % 4 = 0 THEN 'Home Office' ELSE 'Ort' END AS location, url AS link, 'src' || page_id % 2 AS source FROM pages"


def _postings(spark, sf_dir):
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        n.alias("ord"), F.lit("").alias("title"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("raw_title"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("src"), n % 5)).alias("company"),
        F.when(n % 4 == 0, "Home Office").otherwise("Ort").alias("location"), F.col("url").alias("link"), F.concat(F.lit("src"), n % 2).alias("source"),
    )


def _blocked(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("page_id % 7 = 0").select(F.col("url").alias("link"))


_BARE = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
_FILLED = f"SELECT ord, raw_title, link, source, CASE WHEN (company = '' OR location = '') AND t_title <> '' THEN t_title ELSE title END AS title, coalesce(nullif(company, ''), t_company) AS company, coalesce(nullif(location, ''), t_place) AS location FROM ({_parts(f'({_POSTINGS})', 'raw_title')})"
_WHOLE = "title || ' ' || raw_title || ' ' || company || ' ' || location || ' ' || link"
_NORMAL = f"SELECT *, {_FOLD_COLLECTOR.format('location')} AS nl, {_FOLD_COLLECTOR.format('title')} AS nt, {_FOLD_COLLECTOR.format('raw_title')} AS nr, {_FOLD_COLLECTOR.format(_WHOLE)} AS na FROM ({_FILLED})"
_ANY = lambda words: " OR ".join(f"contains(nl, '{w}') OR contains(nt, '{w}') OR contains(nr, '{w}')" for w in words)
_EARLY = f"""SELECT *, CASE WHEN {_ANY(RULES.remote)} THEN 'remote_blocked' WHEN NOT ({_ANY(RULES.search_places)}) THEN 'local_mismatch'
  WHEN NOT (contains(na, 'ment') OR contains(na, 'und') OR len(list_intersect(string_split(na, ' '), ['of', 'de'])) > 0) THEN 'include_keywords'
  WHEN lower(company) = 'src3' THEN 'company_blacklist'
  WHEN contains(b, 'the of') OR contains(b, 'idiot') OR regexp_matches(b, '(^| )the (.* )?of( |$)') THEN 'blocked_keywords'
  WHEN source = 'src1' AND NOT regexp_matches(link, '[0-9]') THEN 'category_link' END AS early,
  {_BARE('title')} || '|' || {_BARE('company')} || '|' || regexp_replace(lower(link), '[?#].*$', '') AS k
  FROM (SELECT *, nt || ' ' || nr || ' ' || nl AS b FROM ({_NORMAL}))"""
_REASONS = f"""SELECT ord, coalesce(early, CASE WHEN ord > f THEN 'duplicate' WHEN hit THEN 'detail_blocklist' END) AS reason FROM (
  SELECT *, min(CASE WHEN early IS NULL AND NOT hit THEN ord END) OVER (PARTITION BY k) AS f
  FROM (SELECT *, link IN (SELECT url FROM pages WHERE page_id % 7 = 0) AS hit FROM ({_EARLY})))"""


@query(_REASONS)
def collector_reason_chain(spark, sf_dir):
    return reasons.collector_reasons(_postings(spark, sf_dir), RULES, blocked_pages=_blocked(spark, sf_dir)).select("ord", "reason")


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_REASONS}) GROUP BY ALL")
def collector_reason_counts(spark, sf_dir):
    return collector_reason_chain(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Budgets of distinct links: postings that need a scan use them up in their order.
_BUDGETED = _EARLY.replace("THEN 'include_keywords'", "AND NOT (link <> '' AND rescued AND (last_rescue IS NULL OR ord <= last_rescue)) THEN 'include_keywords'").replace(f"FROM ({_NORMAL})", "FROM n")
_CUT = lambda rows, most: f"(SELECT CASE WHEN count(*) >= {most} THEN max(f) END FROM (SELECT min(ord) AS f FROM ({rows}) GROUP BY link ORDER BY f LIMIT {most}))"
_LACKING = f"SELECT ord, link FROM n0 WHERE NOT ({_ANY(RULES.remote)}) AND ({_ANY(RULES.search_places)}) AND NOT (contains(na, 'ment') OR contains(na, 'und') OR len(list_intersect(string_split(na, ' '), ['of', 'de'])) > 0)"


@query(f"""WITH n0 AS (SELECT *, link IN (SELECT url FROM pages WHERE page_id % 7 = 0) AS hit, link IN (SELECT url FROM pages WHERE page_id % 2 = 0) AS rescued FROM ({_NORMAL})),
  n AS (SELECT *, {_CUT(_LACKING, 9)} AS last_rescue FROM n0), e AS ({_BUDGETED}), s AS (SELECT *, min(CASE WHEN early IS NULL AND NOT hit THEN ord END) OVER (PARTITION BY k) AS free FROM e),
  c AS (SELECT {_CUT('SELECT ord, link FROM s WHERE early IS NULL AND (free IS NULL OR ord <= free)', 40)} AS last_scan),
  h AS (SELECT e.* REPLACE (hit AND (last_scan IS NULL OR ord <= last_scan) AS hit) FROM e, c)
  SELECT ord, coalesce(early, CASE WHEN ord > f THEN 'duplicate' WHEN hit THEN 'detail_blocklist' END) AS reason FROM (SELECT *, min(CASE WHEN early IS NULL AND NOT hit THEN ord END) OVER (PARTITION BY k) AS f FROM h)""")
def collector_reasons_with_budgets(spark, sf_dir):
    rescued = table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(F.col("url").alias("link"))
    return reasons.collector_reasons(_postings(spark, sf_dir), RULES, blocked_pages=_blocked(spark, sf_dir), rescued_pages=rescued, most_blocked=40, most_rescued=9).select("ord", "reason")


_ANCHORS = """SELECT page_id, url, unnest(hs) AS href, trim(regexp_replace(regexp_replace(unnest(ts), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, unnest(range(len(hs))) AS "at"
FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages)"""


@query(f'''SELECT page_id, "at"::INT AS "at", text AS title, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY "at") AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, regexp_replace(link, '[?#].*$', '') ORDER BY "at") AS r FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link FROM ({_ANCHORS}) WHERE starts_with(href, '/') AND length(text) >= 6)) WHERE r = 1) WHERE n <= 3''')
def html_link_rows(spark, sf_dir):
    return html.link_rows(table(spark, sf_dir, "pages").select("page_id", "url", "html"), only_details=False, patterns=("^https?://[^/]+/[^/]",), limit=3)


_MAILS = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}'), lambda x: trim(x, ' \t\r\n,.;:')), lambda x: x <> '' AND split_part(lower(x), '@', -1) NOT IN ('jobs.ch', 'jobup.ch', 'indeed.com'))"


@query(f"SELECT doc_id, coalesce({', '.join(f"list_filter(l, lambda x: contains(lower(x), '{h}'))[1]" for h in contacts.HINTS)}, l[1], '') AS email FROM (SELECT doc_id, {_MAILS} AS l FROM documents)")
def contact_email_by_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", contacts.contact_email(F.col("text")).alias("email"))


@query(f'''SELECT page_id, "at"::INT AS "at", text AS title, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY "at") AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, regexp_replace(link, '[?#].*$', '') ORDER BY "at") AS r FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link FROM ({_ANCHORS}) WHERE starts_with(href, '/') AND length(text) >= 6)) WHERE r = 1) WHERE n <= 25''')
def html_site_link_rows(spark, sf_dir):
    return html.link_rows(table(spark, sf_dir, "pages").select("page_id", "url", "html"), only_details=False, patterns=("^https?://[^/]+/[^/]",), limit=html.SITE_LINKS)


@query()
def html_json_ld_rows(spark, sf_dir):
    return html.json_ld_rows(table(spark, sf_dir, "pages").select("page_id", "html"))


_ROWS = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'reminder' END AS section, page_id AS place, CASE page_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'good' ELSE 'ok' END AS match, regexp_extract(url, '[^/]*$') AS title, 'A & B' AS company, 'Bern' AS location, url AS link FROM pages"


def _rows(spark, sf_dir):
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.when(n % 3 == 0, "new").otherwise("reminder").alias("section"), n.alias("place"), F.when(n % 3 == 0, "exact").when(n % 3 == 1, "good").otherwise("ok").alias("match"),
        F.regexp_extract("url", "[^/]*$", 0).alias("title"), F.lit("A & B").alias("company"), F.lit("Bern").alias("location"), F.col("url").alias("link"),
        F.lit("").alias("uid"), F.lit("").alias("date"), F.lit("").alias("source"), F.lit(7).alias("score"),
    )


@query(f"SELECT string_agg(printf('%02d. [%s] %s - %s - %s', place, CASE match WHEN 'good' THEN 'good ' WHEN 'ok' THEN ' ok  ' ELSE match END, title, company, location) || chr(10) || '    ' || link, chr(10) ORDER BY place) AS body FROM ({_ROWS}) WHERE place <= 20")
def digest_plain_list(spark, sf_dir):
    return digest.plain_list(_rows(spark, sf_dir))


@query(f"SELECT left('Job-Alert: ' || count(*) FILTER (section = 'new') || ' neu, ' || count(*) FILTER (section <> 'new') || ' offen' || coalesce(string_agg(chr(10) || '- ' || title || ' @ ' || company || ' (' || location || ')', '' ORDER BY place) FILTER (section = 'new' AND place <= 3), ''), 4000) AS body FROM ({_ROWS})")
def digest_summary(spark, sf_dir):
    return digest.summary(_rows(spark, sf_dir))


@query(f"SELECT section, place, '<li><strong>' || title || '</strong> bei A &amp; B<br><em>Bern</em><br><small>' || match || ' | Score 7</small><br><a href=\"' || replace(link, '&', '&amp;') || '\">Bewerben</a></li>' AS item FROM (SELECT * REPLACE (row_number() OVER (ORDER BY section <> 'new', place)::INT AS place, replace(title, '&', '&amp;') AS title) FROM ({_ROWS})) WHERE place <= 200")
def digest_html_items(spark, sf_dir):
    return digest.html_items(_rows(spark, sf_dir))


@query()
def digest_html_body(spark, sf_dir):
    return digest.html_body(_rows(spark, sf_dir))


@query("SELECT p_type AS key, count(*) AS n FROM (SELECT DISTINCT p_type, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', '', 'g') || '|' || regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}_]+', '', 'g') || '|' AS k FROM part) GROUP BY 1")
def norm_key_counts(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_type").alias("key"), reasons.norm_key(F.col("p_name"), F.col("p_brand"), F.lit("")).alias("k"))
    return own.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_matches(lower(url), '/detail/|/job/|/jobad/|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|/[0-9]{6,}(/|$)') AS detail, NOT regexp_matches(url, '[0-9]') AS listing FROM pages")
def link_classes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.plain_detail_link(F.col("url")).alias("detail"), reasons.listing_link(F.col("url")).alias("listing"))


