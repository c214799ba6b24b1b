"""Files of postings: CSV and JSON in and out, and the document of an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import present
from jobloom.functions.titles import backfilled
from jobloom.operators.records import tracker_rows

# Columns of the CSV and JSON files in their order, folders and endings of documents
CSV_COLUMNS = ("title", "company", "location", "match", "score", "link", "source")
JSON_COLUMNS = ("title", "raw_title", "company", "location", "link", "source", "match", "score", "date", "fit", "application_email", "contact_name")
FOLDERS = ("out", "04_Versendete_Bewerbungen")
ENDINGS = ("docx", "pdf")
APPLICATIONS = "Datum,Firma,Position,Portal,Link,Status,Notizen"
DETAILS = {"skipped_domain": "detail_skipped_domain", "fetch_failed": "detail_fetch_failed", "cap_reached": "detail_cap_reached", "rejected_phrase_hits": "detail_phrase_hits"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Postings of CSV files with a header, all texts; lines within quotes belong to their field."""
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, enforceSchema=False)


def write_csv(rows: DataFrame, path: str) -> None:
    """The CSV columns with a header, a file a partition; texts are quoted where they need to be."""
    rows.select(*CSV_COLUMNS).write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Postings of JSON files, whole lists (``multi_line``) or an object a line as ``write_json`` makes them."""
    schema = ", ".join(f"`{c}` {'long' if c == 'score' else 'string'}" for c in JSON_COLUMNS)
    return spark.read.json(path, multiLine=multi_line, schema=schema)


def exported(rows: DataFrame) -> DataFrame:
    """Postings as the JSON file has them: title, company and place filled from titles of several lines; absent texts empty."""
    filled = backfilled(rows)
    return filled.select(*((F.col(c) if c in filled.columns else F.lit("").alias(c)) for c in JSON_COLUMNS))


def write_json(rows: DataFrame, path: str) -> None:
    """``exported`` rows, an object a line; nulls are written."""
    exported(rows).write.mode("overwrite").json(path, ignoreNullFields=False)


def converted(rows: DataFrame, today: Column) -> DataFrame:
    """Rows of the CSV as open decisions: null texts empty, a null or empty score 0 (one that is no number is an error)."""
    text = lambda c, name=None: present(F.col(c)).alias(name or c)
    return rows.select(
        *map(text, ("source", "company", "title", "location")), text("link", "url"), text("match"),
        F.coalesce(F.nullif(F.trim("score"), F.lit("")), F.lit("0")).cast("long").alias("score"), today.cast("string").alias("date_found"),
        F.lit(None).cast("long").alias("commute_min"), F.lit("").alias("salary_text"), F.lit("DECISION").alias("fit"), F.lit("").alias("reason"),
    )


def _resolved(path: Column) -> Column:
    """A path from the root folder without steps that stay; null if a step up is left after four are taken back."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), "/(\\./)+|/{2,}", "/"), "^(\\./)+", "")
    for _ in range(4):
        bare = F.regexp_replace(bare, "(^|/)(?!\\.\\.(?:/|$))[^/]+/\\.\\./", "$1")
    return F.when(~bare.rlike("(^|/)\\.\\.(/|$)"), bare)


def with_document(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records (uid, application_doc_archived, application_doc) with ``document``: the archived file, else the working copy.

    Paths count from the root folder; only files of ``files`` (path) in the folders of documents and with their endings
    do. Null where neither does. Repeated files count once; records keep their number, null uids included.
    """
    allowed = f"^(?:{'|'.join(FOLDERS)})/.*[.](?i:{'|'.join(ENDINGS)})$"
    path = lambda name: F.when(_resolved(F.col(name)).rlike(allowed), _resolved(F.col(name)))
    there = files.select(F.col("path").alias("_path")).filter("_path is not null").distinct()
    rows = records.withColumns({"_first": path("application_doc_archived"), "_second": path("application_doc")})
    for name in ("_first", "_second"):
        rows = rows.join(there.withColumnRenamed("_path", f"{name}_there"), F.col(name) == F.col(f"{name}_there"), "left")
    return rows.withColumn("document", F.coalesce("_first_there", "_second_there")).drop("_first", "_second", "_first_there", "_second_there")


def write_tracker(state: DataFrame, manual: DataFrame, path: str, with_closed: bool = False) -> None:
    """The tracker's rows as CSV with a header, latest sight first within each file."""
    rows = tracker_rows(state, manual, with_closed)
    rows.sortWithinPartitions(F.desc("seen"), "uid").drop("seen").write.mode("overwrite").csv(path, header=True, escape='"')


def application_lines(rows: DataFrame, today: Column) -> DataFrame:
    """Lines (at, line) of the list of applications for rows (ord, company, position, portal, link, status).

    Texts stand in quotes as they are, quotes within them included; nulls are empty.
    """
    quoted = [F.concat(F.lit('"'), present(F.col(c)), F.lit('"')) for c in ("company", "position", "portal", "link", "status")]
    return rows.select(F.col("ord").alias("at"), F.concat_ws(",", present(today), *quoted, F.lit('""')).alias("line"))


def with_header(lines: DataFrame) -> DataFrame:
    """Lines (at, line) of the list with its header before them, unless the first that isn't blank begins like one."""
    first = lines.filter(F.trim(present(F.col("line"))) != "").agg(F.min_by("line", "at").alias("first"))
    missing = first.filter(~F.startswith(F.ltrim(present(F.col("first"))), F.lit("Datum,")))
    header = missing.select(F.lit(-1).cast("long").alias("at"), F.lit(APPLICATIONS).alias("line"))
    return lines.select(F.col("at").cast("long").alias("at"), "line").unionByName(header)


def run_summary(stages: DataFrame, details: DataFrame, mail: DataFrame, finished_at: Column) -> DataFrame:
    """One row of a daily run for its summary file, out of rows by stage (stage, rows), the detail filter's counts and
    the mail's (sent, new, reminders); stages that aren't there are null."""
    names = {"normalised": "scraped", "hard": "after_hard_filter", "detail": "after_detail_filter", "review": "after_llm", "unique": "digested"}
    counts = stages.agg(*(F.max(F.when(F.col("stage") == stage, F.col("rows"))).alias(name) for stage, name in names.items()))
    other = details.select(*(F.col(c).alias(name) for c, name in DETAILS.items())).limit(1)
    sent = mail.select(F.col("sent").alias("email_sent"), F.col("new").alias("email_new_jobs"), F.col("reminders").alias("email_reminders")).limit(1)
    # Each side is one row.
    return counts.join(F.broadcast(other)).join(F.broadcast(sent)).withColumn("finished_at", finished_at)


def write_keyed(rows: DataFrame, path: str, key: str) -> None:
    """A snapshot of rows with a key, as JSON lines in the key's order within each file."""
    rows.sortWithinPartitions(key).write.mode("overwrite").json(path)
