"""Settings as columns: coercions, limits, lists of places, career pages and the terms that a profile rules out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import present
from jobloom.functions.urls import company_from_host

# What counts as yes, and terms ruled out without a degree, by experience and without a licence
TRUE = ("1", "true", "t", "yes", "y", "ja", "j")
NO_DEGREE = ("apprenticeship", "vocational", "highschool", "none")
DEGREE = (
    "bachelor", "master", "phd", "doktor", "doktorat", "studium", "hochschulabschluss", "abgeschlossenes studium", "universitaet",
    "universitaetsabschluss", "fachhochschule", "fh abschluss", "hoehere fachschule", "eth abschluss", "degree required",
    "university degree", "abschluss einer hoeherbildung",
)
MANY_YEARS = (
    "mehrjaehrige erfahrung", "mehrjaehrige berufserfahrung", "mehrjahrige erfahrung", "mehrjahrige berufserfahrung",
    "einschlaegige erfahrung", "einschlaegige berufserfahrung", "fundierte berufserfahrung", "fundierte erfahrung",
    "langjahrige erfahrung", "langjahrige berufserfahrung", "langjahrig", "mehrere jahre erfahrung",
    "mehrere jahre berufserfahrung", "jahre berufserfahrung", "jahren berufserfahrung", "mehrjaehrig", "mehrjahrig",
    "nachgewiesene erfahrung", "erfahrung erforderlich", "proven experience", "demonstrated experience", "extensive experience",
)
THREE_YEARS = (
    "3 jahre erfahrung", "4 jahre erfahrung", "5 jahre erfahrung", "6 jahre erfahrung", "7 jahre erfahrung",
    "3 jahre berufserfahrung", "4 jahre berufserfahrung", "5 jahre berufserfahrung", "mindestens 3 jahre", "mindestens 4 jahre",
    "mindestens 5 jahre", "mind 3 jahre", "mind 4 jahre", "mind 5 jahre", "min 3 jahre", "min 4 jahre", "min 5 jahre", "3+ jahre",
    "4+ jahre", "5+ jahre", "3 years experience", "4 years experience", "5 years experience", "3+ years", "4+ years", "5+ years",
    "at least 3 years", "at least 4 years", "at least 5 years", "erfahrung von mindestens", "3 5 jahre", "2 3 jahre",
)
FIELD = (
    "erfahrung im it-support", "erfahrung im it support", "erfahrung im helpdesk", "erfahrung im help desk",
    "erfahrung im servicedesk", "erfahrung im service desk", "erfahrung im itsm", "erfahrung im enduser",
    "erfahrung im end-user", "berufserfahrung im it-support", "berufserfahrung im it support", "berufserfahrung im helpdesk",
    "berufserfahrung im servicedesk", "erfahrung im 1st level", "erfahrung im first level", "erfahrung im 2nd level",
    "erfahrung im second level", "erfahrung im 1. level", "erfahrung im 2. level", "erfahrung in der it-betreuung",
    "erfahrung in der benutzerbetreuung", "berufserfahrung im it", "experience in it support", "experience in helpdesk",
    "experience in help desk", "experience in service desk", "experience in itsm",
)
TWO_YEARS = (
    "2 jahre erfahrung", "2 jahre berufserfahrung", "mindestens 2 jahre", "min 2 jahre", "2+ jahre", "2 years experience",
    "2+ years", "at least 2 years",
)
DRIVING = (
    "fuehrerschein", "fuhrerschein", "fuehrerausweis", "fuhrerausweis", "kat b", "klasse b", "driving license",
    "license required", "car required",
)
INTEGER = "^[+-]?[0-9]+$"
NUMBER = "(?i)^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def as_bool(text: Column, default: bool = False) -> Column:
    """Whether a setting says yes; the default only where it is not set at all."""
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(F.trim(text)).isin(*TRUE))


def as_int(text: Column, default: int) -> Column:
    """A setting as a whole number; the default where it is none, unset, empty or beyond 64 bits."""
    own = F.trim(text)
    return F.coalesce(F.when(own.rlike(INTEGER), own.try_cast("long")), F.lit(default).cast("long"))


def as_float(text: Column, default: float) -> Column:
    """A setting as a number; the default where it is none, unset or empty."""
    own = F.trim(text)
    return F.coalesce(F.when(own.rlike(NUMBER), own.try_cast("double")), F.lit(default).cast("double"))


def limit_of(value: Column) -> Column:
    """A limit that is one: null, which is no limit, for null and what isn't positive."""
    return F.when(value > 0, value)


def with_places(places: Column, added: Column) -> Column:
    """The places, then each added one, trimmed, that none before equals but for case; null lists are empty ones."""
    none = F.array().cast("array<string>")
    own = F.coalesce(places, none)
    new = F.filter(F.transform(F.coalesce(added, none), lambda x: F.trim(present(x))), lambda x: x != "")
    unseen = lambda kept, x: (x == "") | F.exists(kept, lambda k: F.lower(present(k)) == F.lower(x))
    return F.aggregate(new, own, lambda kept, x: F.when(unseen(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def career_pages(settings: DataFrame, urls: str = "urls", names: str = "names") -> DataFrame:
    """One row a career page of a setting: the other columns, at, url, company; without a name at its place the host's."""
    rest = [c for c in settings.columns if c not in (urls, names)]
    rows = settings.select(*rest, F.col(names).alias("_names"), F.posexplode(urls).alias("at", "url"))
    named = F.nullif(F.get("_names", F.col("at")), F.lit(""))
    return rows.select(*rest, "at", "url", F.coalesce(named, company_from_host(F.col("url"))).alias("company"))


def ruled_out(level: Column, degree: Column, years: Column, licence: Column) -> Column:
    """The sorted terms that a profile rules postings out by; unset members count as empty, none and no."""
    terms = lambda words, wanted=None: F.array(*map(F.lit, words)) if wanted is None else F.when(wanted, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    own = F.coalesce(years, F.lit(0))
    no_degree = F.lower(F.trim(present(level))).isin(*NO_DEGREE) | (F.trim(present(degree)) == "")
    gates = (terms(DEGREE, no_degree), terms(MANY_YEARS), terms(THREE_YEARS, own < 3), terms(TWO_YEARS + FIELD, own < 2), terms(DRIVING, ~F.coalesce(licence, F.lit(False))))
    return F.array_sort(F.array_distinct(F.concat(*gates)))


def parted(rows: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are kept and the rest, where the condition is false or null."""
    holds = F.coalesce(kept, F.lit(False))
    return rows.filter(holds), rows.filter(~holds)


def ruled_out_by(profile: Column) -> Column:
    """``ruled_out`` for the text of a profile's JSON file; no terms where it is null, broken or an empty object."""
    read = F.try_parse_json(profile)
    member = lambda path, kind="string": F.try_variant_get(read, path, kind)
    terms = ruled_out(member("$.education.level"), member("$.education.degree"), member("$.experience_years", "int"), member("$.driving_license", "boolean"))
    said = F.regexp_replace(profile, "\\s", "").isin("{}", "[]", "null", "0", "false", '""')
    return F.when(read.isNotNull() & ~said, terms).otherwise(F.array().cast("array<string>"))


KEY = "^([^=\\s#]+)\\s*="


def env_values(lines: DataFrame) -> DataFrame:
    """key, value of lines (at, line) like ``KEY = value``: the last line of a key counts, quotes and comments go."""
    bare = F.regexp_replace(F.col("line"), "^\\s*(export\\s+)?", "")
    own = F.trim(F.regexp_replace(bare, KEY, ""))
    quoted = F.regexp_extract(own, "^(['\"])(.*?)\\1", 2)
    value = F.when(own.rlike("^(['\"]).*?\\1"), quoted).otherwise(F.trim(F.regexp_replace(own, "(^|\\s+)#.*$", "")))
    rows = lines.filter(bare.rlike(KEY)).select("at", F.regexp_extract(bare, KEY, 1).alias("key"), value.alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def env_updated(lines: DataFrame, updates: DataFrame) -> DataFrame:
    """Lines (at, line) with the updates (ord, key, value) in place, new keys behind them; ``part`` and ``at`` order them.

    Every line of a key gets the value. Of repeated updates the last counts; those without a key or a value are none.
    """
    wanted = updates.filter("key is not null and value is not null").groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").cast("long").alias("ord"))
    keyed = lines.select(F.col("at").cast("long").alias("at"), "line", F.nullif(F.regexp_extract("line", KEY, 1), F.lit("")).alias("key"))
    line = F.coalesce(F.concat(F.regexp_extract("line", KEY, 0), F.col("value")), F.col("line"))
    kept = keyed.join(wanted, "key", "left").select(F.lit(0).alias("part"), "at", line.alias("line"))
    added = wanted.join(keyed.select("key").distinct(), "key", "left_anti")
    return kept.unionByName(added.select(F.lit(1).alias("part"), F.col("ord").alias("at"), F.concat_ws("=", "key", "value").alias("line")))
