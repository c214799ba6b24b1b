"""Cutting lineage of posting tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="jobloom-"))
    return context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """The rows of ``frame`` as files in the shared folder, so that plans that use them often work them out once and a lost
    executor loses none."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def tabled(frame: DataFrame) -> DataFrame:
    """The same as a table, for loops: a checkpoint hands on all that the planner has inferred of its rows, which grows
    with each round, a table nothing."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
