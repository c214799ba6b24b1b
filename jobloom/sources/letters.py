"""Letters on disk and the newest one of each application.

A letter is of an application if its file name holds the company and behind it the title, or, where no file does, the
company alone; names are those that ``stages.file_name`` makes, and capitals count. Companies meet file names by an
equal join on their first letters. An application whose company is empty goes by its title alone, one without both has
no letter. Null names count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import present
from jobloom.operators.meeting import contained
from jobloom.operators.stages import file_name

ENDING = ".docx"


def saved_letters(spark: SparkSession, folder: str) -> DataFrame:
    """path and modified of the letters in a folder; only what the store says of them is read, not the files."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder)
    return read.select("path", F.col("modificationTime").alias("modified"))


def newest_letters(applications: DataFrame, letters: DataFrame) -> DataFrame:
    """ord and path of the newest letter of each application (ord, company, title) that has one; of letters of one time
    the last by path. ``letters``: path, modified."""
    own = applications.select("ord", file_name(present(F.col("company"))).alias("_company"), file_name(present(F.col("title"))).alias("_title"))
    own = own.withColumn("name", F.coalesce(F.nullif("_company", F.lit("")), F.col("_title"))).filter("name != ''")
    files = letters.select("path", "modified", F.regexp_extract("path", "([^/]*)$", 1).alias("_file")).filter(F.endswith("_file", F.lit(ENDING)))
    files = files.withColumn("text", F.substring("_file", F.lit(1), F.length("_file") - len(ENDING)))
    met = contained(files.select(F.col("path").alias("id"), "text"), own.select("name")).withColumnRenamed("id", "path").join(files.select("path", "modified", "text"), "path").join(own, "name")
    # What follows the first place of the company; an empty title stands anywhere.
    rest = F.substring("text", F.instr(F.col("text"), F.col("name")) + F.length("name"), F.length("text"))
    both = (F.col("_company") == "") | F.contains(rest, F.col("_title"))
    return met.groupBy("ord").agg(F.max_by("path", F.struct(both, F.col("modified"), F.col("path"))).alias("path"))
