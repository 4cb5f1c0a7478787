"""Life of targets and events: allowed changes of state, claims, retries, and the dispatch of the outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from actloom.operators.keyed import pick

# The states from which the claim of a stage takes a target, and the ends of each stage.
CLAIMS = {
    "fetching": ("queued", "failed_transient", "fetching"),
    "filtering": ("fetched", "filtering"),
    "parsing": ("fetched", "parsing", "filtered"),
    "chunking": ("parsed", "chunking"),
    "scheduling": ("chunked", "scheduling"),
}
ENDS = {
    "discovered": ("queued", "skipped"),
    "fetching": ("fetched", "skipped_unsupported"),
    "filtering": ("filtered", "skipped"),
    "parsing": ("parsed", "skipped_unsupported"),
    "chunking": ("chunked",),
    "scheduling": ("embedding", "processed"),
    "embedding": ("processed",),
}
FAILURES = ("failed_transient", "failed_permanent")
FINAL = ("processed", "skipped", "skipped_unsupported", "failed_permanent", "failed")
MAX_RETRIES = 3


def transitions() -> list[tuple[str, str]]:
    """All changes of state that a stage may make; every state that is not final may fail."""
    pairs = {(a, b) for b, froms in CLAIMS.items() for a in froms} | {(a, b) for a, ends in ENDS.items() for b in ends}
    open_states = {a for a, _ in pairs}
    return sorted(pairs | {(a, b) for a in open_states for b in FAILURES if a != b})


def may_change(old: Column, new: Column) -> Column:
    """Whether a change of state is allowed; a state may always be written again."""
    pair = F.concat_ws(">", old, new)
    return (old == new) | pair.isin(*[f"{a}>{b}" for a, b in transitions()])


def state_changes(targets: DataFrame) -> DataFrame:
    """(target_id, step, old_status, new_status, allowed) of each change recorded for a target, in order of its times.

    Equal rows count once; a target's states are few, so its window is small.
    """
    own = targets.where("target_id is not null").select("target_id", "status", "updated_at", "created_at").distinct()
    order = W.partitionBy("target_id").orderBy("updated_at", "created_at", "status")
    steps = own.withColumn("old_status", F.lag("status").over(order)).withColumn("step", F.row_number().over(order).cast("long"))
    return steps.where("step > 1").select("target_id", "step", "old_status", F.col("status").alias("new_status"), may_change(F.col("old_status"), F.col("status")).alias("allowed"))


def claimed(targets: DataFrame, stage: str) -> DataFrame:
    """(target_id, won, status) of each target a stage claims at once: those in a state it takes are its own, the others stay as they are."""
    won = F.coalesce(F.col("status").isin(*CLAIMS[stage]), F.lit(False))
    return targets.select("target_id", won.alias("won"), F.when(won, stage).otherwise(F.col("status")).alias("status"))


def stamped(rows: DataFrame, new_status: Column, now: Column) -> DataFrame:
    """The rows under a new status; processed ones get the time."""
    return rows.withColumn("status", new_status).withColumn("processed_at", F.when(new_status == "processed", F.coalesce("processed_at", now)).otherwise(F.col("processed_at")))


def after_failure(failure: Column, attempts: Column) -> Column:
    """What follows a failed attempt: `retry` while it is transient and retries are left, else `failed_transient` or `failed_permanent`."""
    return F.when(failure == "permanent", "failed_permanent").when((failure == "transient") & (attempts <= MAX_RETRIES), "retry").when(failure == "transient", "failed_transient")


def dispatched(events: DataFrame, publish: Callable[[str, str], None], limit: int = 100, order: tuple[str, ...] = ("created_at", "event_id")) -> DataFrame:
    """The oldest pending events (`event_id, status, attempts, payload`), published in their order: sent, or with one more attempt where publishing failed.

    The batch is the operator's limit; it is one task, as its order is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            status, attempts = [], []
            for event, payload, n in zip(pdf["event_id"], pdf["payload"], pdf["attempts"]):
                try:
                    publish(str(event), payload)
                    status.append("sent")
                    attempts.append(n)
                except Exception:  # noqa: BLE001 - an event that can't be published waits for the next batch
                    status.append("pending")
                    attempts.append(n + 1)
            yield pd.DataFrame({"event_id": pdf["event_id"], "status": status, "attempts": attempts})

    kind = dict(events.dtypes)["event_id"]
    oldest = events.where("status = 'pending'").orderBy(*order).limit(limit)
    return oldest.select("event_id", "payload", F.col("attempts").cast("int").alias("attempts")).coalesce(1).mapInPandas(run, f"event_id {kind}, status string, attempts int")


def with_dispatch(events: DataFrame, done: DataFrame) -> DataFrame:
    """The outbox after a dispatch: statuses and attempts of the batch over those before."""
    new = done.select("event_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    joined = events.join(new, "event_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("attempts", F.coalesce("_attempts", "attempts")).drop("_status", "_attempts")


def counted(counters: DataFrame, events: DataFrame, seen: DataFrame, key: str = "pipeline_id", name: str = "n") -> DataFrame:
    """Counters (`key, n`) raised by the events (`key, dedup_key, n`) that were not seen before; a repeated event counts once."""
    fresh = pick(events, ["dedup_key"], [F.col(key)]).join(seen.select("dedup_key").distinct(), "dedup_key", "left_anti")
    more = fresh.groupBy(key).agg(F.sum("n").alias("_more"))
    both = counters.join(more, key, "full_outer")
    return both.select(key, (F.coalesce(name, F.lit(0)) + F.coalesce("_more", F.lit(0))).alias(name))
