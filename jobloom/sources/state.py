"""The stored state and the tracker as files: readers of every form they come in, and snapshots behind a pointer.

A state file is one JSON text: records by uid, or the older list of records with job_uid, of which the last of a uid
counts. A file that is neither, or no JSON, is an empty state, as is a missing one. A tracker is a table with a header
that names job_uid, as CSV or as the first sheet of a workbook; without that name it has no rows, of several rows of a
uid the last counts, blank uids are left out.

Snapshots are written as new tables, and a small file that names the current one is swapped by one rename, so a write
that is cut off leaves the earlier snapshot readable.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.records import RECORD

POINTER = "current.txt"
# Columns of the tracker in their order
TRACKER = ("job_uid", "status", "applied_at", "erledigt", "aktion", "title", "company", "location", "source", "link", "first_seen_at", "last_seen_at", "last_sent_at", "score", "match", "notes")
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def state_file(texts: DataFrame) -> DataFrame:
    """Whole files (value) as rows of ``RECORD``; numbers that are none are null, all other fields text."""
    parsed = texts.select(F.try_parse_json("value").alias("v"))
    by_uid = parsed.select(F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("ord", "e")).select("ord", F.col("e.key").alias("uid"), F.col("e.value").alias("r"))
    listed = parsed.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ord", "r")).select("ord", F.try_variant_get("r", "$.job_uid", "string").alias("uid"), "r")
    rows = by_uid.unionByName(listed).filter("uid != ''")
    kind = lambda c: "int" if c in ("commute_min", "missing_runs") else "string"
    fields = [F.coalesce(F.try_variant_get("r", f"$.{c}", kind(c)), F.lit(None if kind(c) == "int" else "")).alias(c) for c in RECORD if c != "uid"]
    return rows.groupBy("uid").agg(F.max_by("r", "ord").alias("r")).select("uid", *fields)


def read_state_file(spark: SparkSession, path: str) -> DataFrame:
    return state_file(spark.read.option("wholetext", True).text(path))


def _files(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())


def save_snapshot(state: DataFrame, folder: str) -> str:
    """Writes a new snapshot and makes it the current one; returns its name."""
    spark, name = state.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{name}")
    path, draft = spark._jvm.org.apache.hadoop.fs.Path, f"{folder}/_draft-{uuid.uuid4().hex}"
    out = path(draft).getFileSystem(spark._jsc.hadoopConfiguration()).create(path(draft))
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    _files(spark, folder).rename(path(draft), path(f"{folder}/{POINTER}"), overwrite)
    return name


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current snapshot; None before the first one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    name = spark.read.option("wholetext", True).text(f"{folder}/{POINTER}").first()["value"]
    return spark.read.parquet(f"{folder}/{name.strip()}")


def _last_of_each(rows: DataFrame) -> DataFrame:
    """Rows with ord and job_uid as TRACKER columns, the last of each uid; missing columns are empty."""
    have = [c for c in TRACKER if c in rows.columns]
    own = rows.withColumn("job_uid", F.trim(F.coalesce("job_uid", F.lit("")))).filter("job_uid != ''")
    last = own.groupBy("job_uid").agg(F.max_by(F.struct(*(c for c in have if c != "job_uid"), F.lit(0).alias("_")), "ord").alias("r"))
    return last.select(*(F.col("job_uid") if c == "job_uid" else (F.coalesce(F.col(f"r.{c}"), F.lit("")) if c in have else F.lit("")).alias(c) for c in TRACKER))


def tracker_csv(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "job_uid" not in read.columns:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in TRACKER))
    return _last_of_each(read.withColumn("ord", F.monotonically_increasing_id()))


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """The first sheet of a workbook: a row a dict by the header's names; none without a header."""
    with zipfile.ZipFile(io.BytesIO(raw)) as parts:
        names = parts.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        sheet = ElementTree.fromstring(parts.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))

    def said(cell) -> str:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
        value = cell.findtext(f"{SHEET}v") or ""
        return shared[int(value)] if cell.get("t") == "s" and value else value

    def column(cell) -> int:
        at = 0
        for letter in filter(str.isalpha, cell.get("r")):
            at = at * 26 + ord(letter) - 64
        return at

    rows = [{column(c): said(c).strip() for c in row.iter(f"{SHEET}c")} for row in sheet.iter(f"{SHEET}row")]
    header = {at: name for at, name in (rows[0] if rows else {}).items() if name}
    return [{name: row.get(at, "") for at, name in header.items()} for row in rows[1:]]


def tracker_workbook(spark: SparkSession, path: str) -> DataFrame:
    """A tracker from workbooks, each read by one task; broken ones have no rows."""
    schema = "ord long, " + ", ".join(f"{c} string" for c in TRACKER)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                try:
                    rows = sheet_rows(raw)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    rows = []
                yield pd.DataFrame([{"ord": i, **{c: row.get(c, "") for c in TRACKER}} for i, row in enumerate(rows)], columns=["ord", *TRACKER])

    return _last_of_each(spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, schema))
