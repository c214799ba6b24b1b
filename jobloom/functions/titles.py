"""Titles of several lines, as some portals give them: title, company and place by rules on the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import present

# Words that mark lines
LEGAL_FORMS = ("ag", "gmbh", "sa", "s\\.a\\.", "kg", "sarl", "sàrl", "sarl\\.?", "ltd", "inc", "llc")
LABELS = ("arbeitsort", "pensum", "vertragsart", "einfach bewerben", "neu")
AGES = ("heute", "gestern", "vorgestern", "letzte woche", "letzten monat", "vor \\d+ (stunden?|tagen|wochen|monaten?)")
PLACES = (
    "zürich", "zurich", "zuerich", "bülach", "buelach", "kloten", "winterthur", "baden", "zug",
    "aarau", "basel", "bern", "luzern", "thun", "genève", "geneve", "schweiz",
)
BREAKS = "\\R|[\\x1c-\\x1e]"
EDGES = "(?U)^\\s+|\\s+$"


def _word_of(words) -> str:
    return f"(?iU)\\b({'|'.join(words)})\\b"


def line(text: Column) -> Column:
    """Without a list number, quotes and outer blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, "^\\s*\\d+\\.\\s*\\[[^\\]]+\\]\\s*", ""), EDGES, "")
    return F.regexp_replace(F.btrim(bare, F.lit('"')), EDGES, "")


def noise(text: Column) -> Column:
    return text.rlike(f"(?iU)({'|'.join(LABELS)})") | text.rlike("(?i)^ref[:\\s]") | text.rlike(_word_of(AGES))


def title_parts(frame: DataFrame, raw: Column) -> DataFrame:
    """Adds t_title, t_company and t_place ("" where the lines give none).

    The title is the first line that is no label, reference or age; the company the last such line with a legal form,
    else the last one if it is not the title; the place is what follows a line that begins with the place's label, else
    the first line behind the title with a known place, unless it is the company.
    """
    lines = F.filter(F.transform(F.split(present(raw), BREAKS), line), lambda x: x != "")
    own = frame.withColumn("_lines", lines).withColumn("_clean", F.filter("_lines", lambda x: ~noise(x)))
    last = F.try_element_at("_clean", F.lit(-1))
    first = F.coalesce(F.get("_clean", F.lit(0)), F.lit(""))
    labelled = F.array_position(F.transform("_lines", lambda x: F.startswith(F.lower(x), F.lit("arbeitsort"))), True)
    formed = F.try_element_at(F.filter("_clean", lambda x: x.rlike(_word_of(LEGAL_FORMS))), F.lit(-1))
    behind = F.filter(F.slice("_clean", 2, F.greatest(F.size("_clean"), F.lit(1))), lambda x: x.rlike(_word_of(PLACES)))
    own = own.withColumn("t_title", first).withColumn("t_company", F.coalesce(formed, F.when((F.size("_clean") >= 2) & (last != first), last), F.lit("")))
    given = F.when(labelled > 0, line(F.get("_lines", labelled.cast("int"))))
    own = own.withColumn("t_place", F.coalesce(F.nullif(given, F.lit("")), F.get(behind, F.lit(0)), F.lit("")))
    return own.withColumn("t_place", F.when(F.col("t_place") == F.col("t_company"), "").otherwise(F.col("t_place"))).drop("_lines", "_clean")


def backfilled(frame: DataFrame) -> DataFrame:
    """Fills title, company and location from raw_title where company or location is missing; a found title replaces."""
    parts = title_parts(frame, F.coalesce(F.nullif("raw_title", F.lit("")), F.col("title")))
    lacks = (present(F.col("company")) == "") | (present(F.col("location")) == "")
    return parts.withColumns(
        {
            "title": F.when(lacks & (F.col("t_title") != ""), F.col("t_title")).otherwise(present(F.col("title"))),
            "company": F.coalesce(F.nullif("company", F.lit("")), F.col("t_company")),
            "location": F.coalesce(F.nullif("location", F.lit("")), F.col("t_place")),
        }
    ).drop("t_title", "t_company", "t_place")
