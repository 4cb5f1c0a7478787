"""Streams: exactly-once effects over repeated delivery, latest state per key, and run completion.

Event-time windows are an extension; the pipeline itself has no event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first delivery of each event; keys are kept as long as the watermark says they may come again."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window of event time; rows later than the watermark are left out."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def latest_status(events: DataFrame) -> DataFrame:
    """(user_id, status, events): the latest event of each key by time and id, updated as events come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, number, status, n = state.get if state.exists else (pd.Timestamp.min.value, -1, None, 0)
        for pdf in batches:
            n += len(pdf)
            last = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if (last["ts"].value, last["event_id"]) > (at, number):
                at, number, status = int(last["ts"].value), int(last["event_id"]), last["event_type"]
        state.update((at, number, status, n))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "events": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, events long", "at long, number long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there in micro-batches and stop; a restart goes on where the checkpoint ends."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
