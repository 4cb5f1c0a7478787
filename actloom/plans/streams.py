"""Streaming queries over the events: micro-batches are run to their end and their effects read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.lineage import Workspace
from actloom.operators.keyed import pick
from actloom.streaming import events


def source(spark: SparkSession, folder: str) -> DataFrame:
    return events.read_events(spark, f"{folder}/event[s].parquet")


def collected(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream wrote, with the number of its micro-batch; a batch replayed after a failure overwrites its own part."""
    spark = stream.sparkSession
    work = Workspace(spark, name)

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{work.root}/out/part={number}")

    events.run_to_end(stream, f"{work.root}/checkpoint", mode, each)
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{work.root}/out").select(*schema.names)


def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    """The latest status of each user and the events counted for it, by a stateful stream."""
    rows = collected(events.latest_status(source(spark, folder)), "update", "status")
    return pick(rows, ["user_id"], [F.col("batch")], last=True).select("user_id", "status", "events")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour, by a windowed stream (an extension)."""
    rows = collected(events.windowed(source(spark, folder), delay="400 days"), "complete", "windows")
    return pick(rows, ["window_start", "event_type"], [F.col("batch")], last=True).drop("batch")


QUERIES = {"stream_status": stream_status, "stream_windows": stream_windows}
SQL = {
    "stream_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1",
    "stream_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
