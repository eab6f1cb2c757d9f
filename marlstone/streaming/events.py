"""Events folded into runs: the same transitions for a finished table and for a stream."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.session import shared_folder

FOLD = "user_id long, n_events long, n_errors long, total double, last_event string"


def fold(events: DataFrame) -> DataFrame:
    """user_id as the run: counts, sum of values, and the latest event type (the greater id among equal times)."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"),
        F.round(F.sum("value"), 4).alias("total"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"),
    )


def fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a streaming DataFrame (update mode) with state for each run."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")

    def step(key, batches, state: GroupState):
        n, errors, total, at, at_id, last = state.get if state.exists else (0, 0, 0.0, None, -1, "")
        for b in batches:
            n, errors, total = n + len(b), errors + int((b["event_type"] == "error").sum()), total + float(b["value"].sum())
            row = b.sort_values(["ts", "event_id"]).iloc[-1]
            when = row["ts"].to_pydatetime()
            if at is None or (when, int(row["event_id"])) > (at, at_id):
                at, at_id, last = when, int(row["event_id"]), row["event_type"]
        state.update((n, errors, total, at, at_id, last))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "n_errors": [errors], "total": [round(total, 4)], "last_event": [last]})

    return source.groupBy("user_id").applyInPandasWithState(
        step, FOLD, "n long, errors long, total double, at timestamp_ntz, at_id long, last string", "update", GroupStateTimeout.NoTimeout
    )


def finished_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streamed fold of all events so far: updates are written as Parquet for each batch, and the latest of each run is read back."""
    base = f"{shared_folder(spark).rstrip('/')}/fold-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/updates/batch={number}")

    run = fold_stream(spark, sf_dir).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{FOLD}, batch long").parquet(f"{base}/updates")
    fields = ("n_events", "n_errors", "total", "last_event")
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("user_id", "r.*")
