"""The lifecycle as a stream: every micro-batch is one run over the keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators.lifecycle import merge

STATE = "uid string, status string, first_seen timestamp, last_seen timestamp, last_sent timestamp, missing_runs int"


def follow(observations: DataFrame, folder: str, **guards) -> StreamingQuery:
    """Merges a stream of (uid, ts) into snapshots ``folder``/run=N, one a micro-batch; ends when the source is read.

    A run repeated after a failure reads the same earlier snapshot and overwrites its own, so each counts once. An
    empty run leaves the state as it was.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(STATE).parquet(f"{folder}/run={number - 1}") if number else spark.createDataFrame([], STATE)
        batch.persist()
        try:
            stamp = batch.agg(F.max("ts")).first()[0]
            after = state if stamp is None else merge(state, batch.select("uid").distinct(), F.lit(stamp).cast("timestamp"), **guards)
            after.write.mode("overwrite").parquet(f"{folder}/run={number}")
        finally:
            batch.unpersist()

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
