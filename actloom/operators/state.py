"""Status of targets, chunks and runs, derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.operators.keyed import pick
from actloom.operators.running import running_total

# Statuses from which a target can make no more work.
FINISHED = ("processed", "skipped", "skipped_unsupported", "failed_transient", "failed_permanent", "failed")
REQUEUEABLE = ("failed_transient", "failed")


def current(targets: DataFrame) -> DataFrame:
    """The latest state of each target: by updated_at, then created_at."""
    return pick(targets.where("target_id is not null"), ["target_id"], [F.col("updated_at"), F.col("created_at")], last=True)


def unique_chunks(chunks: DataFrame) -> DataFrame:
    return pick(chunks.where("chunk_id is not null"), ["chunk_id"], [F.col("created_at")], last=True)


def status_counts(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pipeline_id, status, n_chunks): chunks of each run by their status."""
    own = current(targets.select("target_id", "pipeline_id", "document_id", "updated_at", "created_at")).select("pipeline_id", "document_id").where("document_id is not null")
    return unique_chunks(chunks.select("chunk_id", "document_id", "status", "created_at")).join(own, "document_id").groupBy("pipeline_id", "status").agg(F.count("*").alias("n_chunks"))


def embedding_rollup(counts: DataFrame) -> DataFrame:
    """(pipeline_id, embedded, pending): everything that is not embedded is pending."""
    done = F.col("status") == "embedded"
    return counts.groupBy("pipeline_id").agg(F.sum(F.when(done, F.col("n_chunks")).otherwise(0)).alias("embedded"), F.sum(F.when(done, 0).otherwise(F.col("n_chunks"))).alias("pending"))


def targets_with_chunks(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each target with its number of chunks, also without any."""
    n = unique_chunks(chunks.select("chunk_id", "document_id", "created_at")).where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("n"))
    own = current(targets).withColumn("at", F.coalesce("document_id", F.concat(F.lit("\0"), "target_id")))
    return own.join(n.withColumnRenamed("document_id", "at"), "at", "left").drop("at").withColumn("chunk_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in order of created_at and id; the limit is held to 1..200, the offset to 0 and more."""
    return rows.orderBy(F.asc_nulls_last("created_at"), "target_id").offset(max(0, offset)).limit(min(200, max(1, limit)))


def page_with_total(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all rows, which is counted while the page is planned."""
    return page(rows, limit, offset).withColumn("total", F.lit(rows.count()).cast("long"))


def in_order(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, place): the chunks of each document by their index, from 1, over buckets of the index."""
    own = chunks.withColumn("one", F.lit(1).cast("long"))
    counted = running_total(own, ["document_id"], F.shiftright(F.coalesce("chunk_index", F.lit(-1)), 12), ["chunk_index", "chunk_id"], "one", "before")
    return counted.select("document_id", "chunk_id", (F.col("before") + 1).alias("place"))


def active_counts(targets: DataFrame) -> DataFrame:
    """(pipeline_id, n_targets, n_active): targets of each run, and those that may still make work."""
    own = current(targets.select("target_id", "pipeline_id", "status", "updated_at", "created_at"))
    return own.groupBy("pipeline_id").agg(F.count("*").alias("n_targets"), F.sum(F.when(~F.col("status").isin(*FINISHED), 1).otherwise(0)).alias("n_active"))


def finalized(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(target_id, new_status): targets in embedding are processed once no chunk of their document is pending."""
    pending = unique_chunks(chunks.select("chunk_id", "document_id", "status", "created_at")).where(F.coalesce(F.col("status") != "embedded", F.lit(True))).select("document_id").distinct()
    own = current(targets.select("target_id", "document_id", "status", "updated_at", "created_at")).where("status in ('embedding', 'embedded')")
    with_pending = own.join(pending.withColumn("waits", F.lit(True)), "document_id", "left")
    return with_pending.select("target_id", F.when(F.col("waits"), F.col("status")).otherwise("processed").alias("new_status"))


def fully_embedded(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, all_embedded): whether no chunk of a document is pending; true without chunks."""
    state = unique_chunks(chunks.select("chunk_id", "document_id", "status", "created_at")).groupBy("document_id").agg(F.min(F.coalesce(F.col("status") == "embedded", F.lit(False))).alias("every"))
    return documents.select("document_id").where("document_id is not null").distinct().join(state, "document_id", "left").select("document_id", F.coalesce("every", F.lit(True)).alias("all_embedded"))


def marked_embedded(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks, those of the given ids (`chunk_id`) with the status embedded; ids that are NULL or unknown mark none."""
    hit = ids.select("chunk_id").where("chunk_id is not null").distinct().withColumn("_hit", F.lit(True))
    joined = chunks.join(hit, "chunk_id", "left")
    return joined.withColumn("status", F.when(F.col("_hit"), "embedded").otherwise(F.col("status"))).drop("_hit")


def completed(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """(pipeline_id, n_active, complete): a run is complete without active targets and with all scheduled embeddings done."""
    active = active_counts(targets).select("pipeline_id", "n_active")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return runs.join(active, "pipeline_id", "left").select("pipeline_id", n.alias("n_active"), ((n == 0) & (F.coalesce("embeddings_completed", F.lit(0)) >= F.coalesce("embeddings_scheduled", F.lit(0)))).alias("complete"))


def processing_seconds(created: Column, processed: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(processed) - micros(created)) / 1e6
