"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept.

Edge cases: a null text goes at the first stage; a null id, language or source is a value like any other, but rows
without an id are never dropped as near copies, which are named by id. Of rows repeated in full one stays from the
second stage on, until mixing repeats rows. Ties are broken as each operator states. Columns beyond those of documents
are passed on up to packing, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from jobloom.llm.common import dropped, shared_path
from jobloom.llm.queries import BYTE_VOCABULARY, vocabulary_path

#: Encoded words that a worker of the last stage keeps: its executors still hold what the stages before it took.
WORDS_KEPT = 60_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; lang becomes the network's language of each other text, whatever label it
    came with, and decides which sequences a text may be packed in."""
    return language_id.with_language(docs, renewed=True)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks one stays."""
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 0.8 similar five-word shingle sets stays."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken several times comes several times."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets; a sequence holds texts of one language."""
    return packing.pack(docs, vocabulary_path(BYTE_VOCABULARY), most_kept=WORDS_KEPT, group_col="lang")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Packing cuts tokens of a trained vocabulary, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again; a stage's input goes once it is used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_path(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            dropped(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
