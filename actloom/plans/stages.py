"""Queries of whole stages, of the life of targets and events, and of the control plane, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions import urls as U
from actloom.io import table
from actloom.lineage import Workspace
from actloom.operators import bm25, chunkers, history, keyed, lifecycle, links, providers, runs, search, stages, state, tables, vectors
from actloom.operators.acts import Config
from actloom.plans import pipeline, retrieval
from actloom.plans.pipeline import CHUNKS, CURRENT, DOCS, EXTRACT, INCLUDE, KW, MEDIA, PARTS, SENTENCE_SQL, SLUG, act_xml, url_sql
from actloom.plans.retrieval import HYBRID, LAB, TOP_K, UNIQUE, UNIT, embed_sql, questions
from actloom.sources import parsers

RELAXED = ["seadusabi.example", "courtnotes.example", "registerwatch.invalid"]
MOST_BYTES = 24


def latest_fetches(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "fetches").select("target_id", "source_url", "final_url", "http_status", "content_type", "content", "raw_content_path", "fetched_at").where("target_id is not null")
    return keyed.pick(own, ["target_id"], [F.col("fetched_at")], last=True)


def current_targets(spark: SparkSession, folder: str) -> DataFrame:
    return state.current(table(spark, folder, "targets"))


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, pipeline_id): the run of each document, by its target."""
    own = current_targets(spark, folder).where("document_id is not null").select("document_id", "pipeline_id")
    return keyed.pick(own, ["document_id"], [F.col("pipeline_id")])


# --- stages --------------------------------------------------------------------
def fetch_stage(spark, folder):
    """The latest fetch of each target with its status, reason, extension, kind of source and hash."""
    found = stages.fetched(latest_fetches(spark, folder).withColumnRenamed("source_url", "url"))
    return found.select("target_id", "status", "reason", "extension", "source_type", "content_hash")


def artifact_files(spark, folder):
    """Raw contents written under their run, read back after the files of one run (that of the smallest id) were deleted; a falsy path reads as empty."""
    rows = latest_fetches(spark, folder).where("content is not null").join(current_targets(spark, folder).select("target_id", "pipeline_id"), "target_id")
    named = rows.join(table(spark, folder, "runs").select("pipeline_id", U.run_folder(F.col("pipeline_id"), F.col("name")).alias("run_folder")), "pipeline_id", "left")
    path = stages.artifact_path(F.col("run_folder"), F.col("target_id"), F.lit("raw"), U.extension(F.col("content_type")))
    work = Workspace(spark, "artifacts")
    part = lambda run: F.coalesce(F.md5(run), F.lit("no_run"))  # noqa: E731 - ids may be empty or have signs that folders escape
    files = named.select("target_id", "pipeline_id", F.lit("raw").alias("kind"), path.alias("path"), "content", part(F.col("pipeline_id")).alias("run"))
    work.write(files, "files", partition_by="run")
    gone = table(spark, folder, "runs").agg(part(F.min("pipeline_id"))).first()[0]
    work.drop(f"files/run={gone}")
    kept = work.read("files", files)  # only now, as files are listed when a table is opened
    return kept.select("target_id", "pipeline_id", "kind", "path", T.content_hash(F.col("content")).alias("content_hash"))


def upsert_documents(spark, folder):
    """Documents by target over those of before: what the latest fetches say wins, the text and id of before stay."""
    old = keyed.pick(table(spark, folder, "documents").select("target_id", "document_id", "http_status", "content_type", "final_url", "text_hash").where("target_id is not null"), ["target_id"], [F.col("document_id")])
    new = latest_fetches(spark, folder).select("target_id", F.concat(F.lit("new-"), "target_id").alias("document_id"), "http_status", "content_type", "final_url", F.lit(None).cast("string").alias("text_hash"))
    return keyed.upsert(old, new, ["target_id"], keep=["document_id", "text_hash"])


def upsert_links(spark, folder):
    """Links by chunk and URL over those of before: the first of a chunk wins, and on conflict only the raw URL changes."""
    kept = table(spark, folder, "links").select("source_chunk_id", "normalized_url", "raw_url", "status", "created_at", "link_id").where("source_chunk_id is not null and normalized_url is not null")
    old = keyed.pick(kept, ["source_chunk_id", "normalized_url"], [F.col("created_at"), F.col("link_id")]).drop("created_at", "link_id")
    new = links.chunk_links(pipeline.link_extract(spark, folder), "source_chunk_id").select("source_chunk_id", "normalized_url", F.col("url").alias("raw_url"), F.lit("pending").alias("status"))
    return keyed.upsert(old, new, ["source_chunk_id", "normalized_url"], keep=["status"])


def validate_local(spark, folder):
    """The paths of stored contents as local sources, against a listing of those that have a content: without one they can't be read, failed ones are not there."""
    own = table(spark, folder, "fetches").where("raw_content_path is not null").select(F.concat(F.lit("file:///"), "raw_content_path").alias("path")).distinct()
    listing = table(spark, folder, "fetches").where("http_status = 200").select(F.concat(F.lit("/"), "raw_content_path").alias("path"), F.col("content").isNotNull().alias("readable"))
    return stages.validated_local(own, listing)


def validate_stage(spark, folder):
    """Every URL linked to from the documents of a run: queued, or skipped as already queued or of another origin."""
    targets = current_targets(spark, folder)
    active = targets.where(~F.col("status").isin(*state.REQUEUEABLE)).select("pipeline_id", "normalized_url")
    found = table(spark, folder, "links").select(F.col("source_document_id").alias("document_id"), F.col("raw_url").alias("url")).where("document_id is not null").distinct().join(owners(spark, folder), "document_id")
    documents = keyed.pick(table(spark, folder, "documents").select("document_id", "source_url").where("document_id is not null"), ["document_id"], [F.col("source_url")])
    return stages.validated(found.select("pipeline_id", "url", F.col("document_id").alias("parent_document_id")), active, documents)


def filter_acts(spark, folder):
    """Acts in XML by the include gate: the title of the XML decides where there is one."""
    kept = stages.filtered(act_xml(spark, folder).where("text <> 'act' and trim(text) <> ''"), True, INCLUDE, [], content="raw", xml=F.lit(True))
    return kept.select("act_id", "status", "skip_reason")


def parse_stage(spark, folder):
    """Stored contents parsed, as documents: parser, status, language and versions, and of plain text its hash."""
    found = parsers.parse(latest_fetches(spark, folder).where("content is not null"), "target_id")
    plain = F.when(F.col("parser") == "plain", F.col("text_hash"))
    return stages.parsed_documents(found).select("target_id", "parser", "status", "language", "parser_version", "chunker_version", "error", plain.alias("plain_hash"))


def json_guard(spark, folder):
    """Whether the metadata of each chunk are within a limit of bytes as compact JSON."""
    own = state.unique_chunks(table(spark, folder, "chunks").select("chunk_id", "chunk_metadata", "created_at"))
    return own.select("chunk_id", T.json_within(F.col("chunk_metadata"), MOST_BYTES).alias("fits"))


def stage_input(spark, folder) -> DataFrame:
    """Documents with the settings of their run, joined once by document: the input of the chunk stage."""
    rows = table(spark, folder, "documents").select("document_id", "text", "source_url", "lang", "parser_metadata").where("document_id is not null")
    one = keyed.pick(rows, ["document_id"], [F.length("text"), F.col("source_url")])
    configs = owners(spark, folder).join(table(spark, folder, "runs").select("pipeline_id", "actor_configs"), "pipeline_id", "left")
    placed = one.join(configs.select("document_id", "actor_configs"), "document_id", "left")
    return placed.withColumn("raw", F.lit(None).cast("string")).withColumn("parser_format", F.lit("plain"))


def chunk_stage(spark, folder):
    """All documents by the chunkers of their runs, with metadata merged and the links of each chunk counted."""
    found = stages.chunked(stage_input(spark, folder))
    n_links = F.size(F.regexp_extract_all(F.col("text"), F.lit(links.MARKDOWN_LINK), 0))
    return found.select("document_id", "chunker", "error", "chunk_index", "text", "start_offset", "end_offset", "chunk_type", "metadata", n_links.alias("n_links"))


def chunk_stage_sentences(spark, folder):
    """The chunks of the documents whose runs pack sentences, under the sizes of their runs."""
    return chunk_stage(spark, folder).where("chunker = 'text_sentence'").select("document_id", "chunk_index", "text")


def chunk_stage_documents(spark, folder):
    """Each document with its chunker, and whether it came out with chunks, whose offsets give their texts."""
    own = stage_input(spark, folder).select("document_id", F.col("text").alias("whole"))
    right = F.col("start_offset").isNull() | (F.substring("whole", F.col("start_offset").cast("int") + 1, (F.col("end_offset") - F.col("start_offset")).cast("int")) == F.col("text"))
    placed = stages.chunked(stage_input(spark, folder)).join(own, "document_id")
    # A window's text has its words joined anew, so its offsets give another white space.
    return placed.groupBy("document_id", "chunker").agg(F.min(F.col("error").isNull()).alias("whole"), F.min(right | (F.col("chunker") == "text_sliding_window")).alias("placed"))


def inspection(spark, folder):
    """The chunks of all acts, a line for people each."""
    return stages.inspection(pipeline.chunk_legal_xml(spark, folder)).select("act_id", "chunk_index", "inspection")


def act_report(spark, folder):
    """The chunks of all acts by type, with those that are too short, span chapters or start with publication data."""
    return stages.act_report(pipeline.chunk_legal_xml(spark, folder))


def act_chunk_types(spark, folder):
    """Acts with their chunks of a title, and whether any body, metadata and amendments came out where the record has some."""
    found = pipeline.chunk_legal_xml(spark, folder).groupBy("act_id").agg(F.sum(F.when(F.col("chunk_type") == "act_title", 1).otherwise(0)).cast("long").alias("n_titles"), F.max(F.col("chunk_type") == "legal_body").alias("has_body"), F.max(F.col("chunk_type") == "amendment_history").alias("has_amendments"))
    return found.select("act_id", "n_titles", "has_body", "has_amendments")


def stage_vectors(spark, folder) -> DataFrame:
    chunks = state.unique_chunks(table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "chunk_type", "text", F.col("chunk_metadata").alias("metadata"), "created_at")).where("text is not null")
    placed = chunks.join(owners(spark, folder).withColumnRenamed("pipeline_id", "pipeline_run_id"), "document_id", "left")
    return stages.embedded(placed)


def embed_stage(spark, folder):
    """The vectors of all chunks with their payload: a row per component that is not 0."""
    each = stage_vectors(spark, folder).select("chunk_id", "document_id", "chunk_index", "chunk_type", "pipeline_run_id", F.posexplode("vector").alias("component", "value"))
    return each.where("value <> 0").withColumn("value", F.round("value", 6))


def embed_client(spark, folder):
    """The search inputs embedded through a client whose responses come in another order: all components."""
    target = providers.target_of({"provider_type": "openai", "config": {"base_url": "injected", "model": "hash"}})

    def send(path: str, body: dict) -> dict:
        made = vectors.embed(body["input"], normalize=False).tolist()
        return {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(made)))]}

    own = questions(spark, folder).select(F.col("query_id").cast("string").alias("chunk_id"), "text", *[F.lit(None).cast(t).alias(c) for c, t in (("document_id", "string"), ("chunk_index", "int"), ("chunk_type", "string"), ("pipeline_run_id", "string"), ("metadata", "string"))])
    found = stages.embedded(own, encode=providers.Embedder(target, send).encode)
    return found.select(F.col("chunk_id").cast("long").alias("query_id"), F.posexplode("vector").alias("component", "value")).withColumn("value", F.round("value", 6))


def stored_search(spark, folder):
    """The nearest stored vectors of each search input, in a collection made, filled and read as a store does."""
    store = tables.Collections(spark, Workspace(spark, "collections").root)
    store.create("own", 64)
    store.upsert("own", stage_vectors(spark, folder))
    queries = questions(spark, folder).select(F.col("query_id").alias("id"), vectors.hash_embedding(F.col("text")).alias("vector"))
    return store.search("own", queries, TOP_K)


def hybrid_stored(spark, folder):
    """The hybrid search over a collection's stored vectors and analyzed chunks."""
    work = Workspace(spark, "stored")
    chunks = table(spark, folder, "chunks")
    stored = work.write(stage_vectors(spark, folder).select("chunk_id", "vector"), "vectors"), work.write(bm25.analyzed(chunks), "terms")
    found = search.search(questions(spark, folder), chunks, table(spark, folder, "documents"), "hybrid", TOP_K, stored=stored)
    return found.select("source_id", "chunk_id", "document_id", "chunk_index", "source_url", "score", "rank")


def tls_policy(spark, folder):
    """Hosts of links with whether their TLS is relaxed."""
    own = table(spark, folder, "links").where("raw_url is not null").select("raw_url").distinct()
    return own.select("raw_url", U.tls_relaxed(F.col("raw_url"), RELAXED).alias("relaxed"))


def collection_names(spark, folder):
    """The collection of each run's dataset."""
    own = table(spark, folder, "runs")
    return own.select("pipeline_id", F.concat(F.lit("kb_"), "dataset.name", F.lit("_qwen_embed_8b")).alias("collection"))


# --- life ------------------------------------------------------------------------
def state_changes(spark, folder):
    """Every change of state in the targets' history, with whether a stage may make it."""
    return lifecycle.state_changes(table(spark, folder, "targets"))


def claim_targets(spark, folder):
    """All targets after the fetch stage claimed those it takes."""
    return lifecycle.claimed(current_targets(spark, folder), "fetching")


def retry_failures(spark, folder):
    """What follows the failures of documents' fetches after one to five attempts."""
    own = table(spark, folder, "fetches").select("http_status").distinct().select("http_status", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempts"))
    return own.select("http_status", "attempts", lifecycle.after_failure(U.failure_class(F.col("http_status")), F.col("attempts")).alias("next"))


def stamp_processed(spark, folder):
    """Targets after all that are parsed became processed, at a given time."""
    own = current_targets(spark, folder)
    new = F.when(F.col("status") == "parsed", "processed").otherwise(F.col("status"))
    return lifecycle.stamped(own, new, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").cast(dict(own.dtypes)["processed_at"])).select("target_id", "status", "processed_at")


def outbox(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "purchase", "sent").otherwise("pending").alias("status"), F.lit(0).alias("attempts"), "event_type", F.to_json(F.struct("user_id", "event_type")).alias("payload"), F.col("ts").alias("created_at"))


def dispatch_outbox(spark, folder):
    """The outbox after one dispatch of its oldest hundred pending events, of which errors can't be published."""
    events = outbox(spark, folder)

    def publish(event: str, payload: str) -> None:
        if json.loads(payload)["event_type"] == "error":
            raise OSError("no such queue")

    return lifecycle.with_dispatch(events, lifecycle.dispatched(events, publish)).select("event_id", "status", "attempts")


def count_new_events(spark, folder):
    """Counters of users raised by their events of even number, after those of numbers divisible by three were seen; each counts once."""
    own = table(spark, folder, "events").select("user_id", F.col("event_id").cast("string").alias("dedup_key"), F.lit(1).cast("long").alias("n"), "event_id")
    before = own.where("event_id % 3 = 0").groupBy("user_id").agg(F.sum("n").alias("n"))
    new = own.where("event_id % 2 = 0").drop("event_id")
    return lifecycle.counted(before, new.unionByName(new), own.where("event_id % 3 = 0").select("dedup_key"), "user_id")


# --- reading -----------------------------------------------------------------------
def document_chunks(spark, folder):
    """The chunks of each document in their order: the place of each."""
    own = state.unique_chunks(table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "created_at")).where("document_id is not null")
    return state.in_order(own)


def discovered_targets(spark, folder):
    """The oldest hundred discovered targets."""
    own = current_targets(spark, folder).where("status = 'discovered'")
    return own.orderBy(F.asc_nulls_last("created_at"), "target_id").limit(100).select("target_id", "normalized_url")


def target_lookup(spark, folder):
    """Every linked URL that is a target of the run of its document, with that target and its status."""
    targets = current_targets(spark, folder).where("normalized_url is not null").select("pipeline_id", "normalized_url", "target_id", "status", "created_at")
    one = keyed.pick(targets, ["pipeline_id", "normalized_url"], [F.col("created_at"), F.col("target_id")])
    found = table(spark, folder, "links").where("normalized_url is not null").select(F.col("source_document_id").alias("document_id"), "normalized_url").distinct().join(owners(spark, folder), "document_id")
    return found.select("pipeline_id", "normalized_url").distinct().join(one, ["pipeline_id", "normalized_url"]).select("pipeline_id", "normalized_url", "target_id", "status")


def targets_page_full(spark, folder):
    """The first page of two hundred targets with all columns of a page and the total."""
    rows = state.targets_with_chunks(table(spark, folder, "targets"), table(spark, folder, "chunks"))
    found = state.page_with_total(rows, 500, -3)
    return found.select("target_id", "original_url", "normalized_url", "status", "skip_reason", "error", "chunk_count", "document_id", "created_at", "updated_at", "processed_at", "total")


def valid_ids(spark, folder):
    """Ids of links with what is no UUID as NULL."""
    own = table(spark, folder, "links").select("source_chunk_id", "raw_url").distinct()
    return own.select("source_chunk_id", "raw_url", providers.as_uuid(F.col("source_chunk_id")).alias("chunk_uuid"), providers.as_uuid(F.col("raw_url")).alias("url_uuid"))


def run_chunkers(spark, folder):
    """The chunker of each run and its sizes, from its snapshot."""
    rows = [(r["pipeline_id"], *stages.chunker_of(r["actor_configs"])) for r in table(spark, folder, "runs").select("pipeline_id", "actor_configs").toLocalIterator()]
    made = [(k, name, int(float(s.get("chunk_size", 1200))), int(float(s.get("chunk_overlap", 150)))) for k, name, s in rows]
    return spark.createDataFrame(made, "pipeline_id string, chunker string, chunk_size int, chunk_overlap int")


def persisted_searches(spark, folder):
    """Hybrid searches kept in the history: per search the number of results, and the chunk of its best."""
    found = search.search(questions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), "hybrid", TOP_K)
    kept = history.persist(found, F.lit("run"), "hybrid", TOP_K, F.lit("2024-01-01").cast("timestamp"))
    return kept.select("source_id", "query_text", "search_config", F.size("results").alias("n_results"), F.col("results")[0]["chunk_id"].alias("best_chunk"))


def search_detail(spark, folder):
    """The results of the kept searches in their order."""
    kept = retrieval.kept_searches(spark, folder).select(F.concat_ws("/", "search_id", F.col("query_id").cast("string")).alias("search_id"), F.col("query_id").cast("string").alias("query_text"), "results")
    return history.detail(kept).select("search_id", "query_text", "rank", "chunk_id", F.round("score", 6).alias("score"))


def compatible_searches(spark, folder):
    """The kept searches that may stand beside the first one: of its dataset and its query."""
    kept = retrieval.kept_searches(spark, folder).select(F.concat_ws("/", "search_id", F.col("query_id").cast("string")).alias("search_id"), F.concat(F.lit("d"), (F.col("query_id") % 3).cast("string")).alias("dataset_name"), F.col("query_id").cast("string").alias("query_text"))
    first = kept.agg(F.min("search_id")).first()[0]
    strict, relaxed = history.compatible(kept, first), history.compatible(kept, first, any_query=True)
    return strict.select("search_id", F.lit(False).alias("any_query")).unionByName(relaxed.select("search_id", F.lit(True).alias("any_query")))


def compare_labelled(spark, folder):
    """The comparison under its model's label, best hundred by Manhattan distance, then in the order of any column."""
    a, b = retrieval.requests(spark, folder)
    found = vectors.compare(a, b, ["dot", "manhattan"]).select(F.lit("hash").alias("model"), "source_id", "candidate_id", F.round("dot", 6).alias("dot"), F.round("manhattan", 6).alias("manhattan"))
    return history.sorted_by(found, "manhattan").limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        fetch_stage, artifact_files, upsert_documents, upsert_links, validate_local, validate_stage, filter_acts, parse_stage, json_guard, chunk_stage, chunk_stage_sentences, chunk_stage_documents,
        inspection, act_report, act_chunk_types, embed_stage, embed_client, stored_search, hybrid_stored, tls_policy, collection_names, state_changes, claim_targets, retry_failures, stamp_processed, dispatch_outbox, count_new_events,
        document_chunks, discovered_targets, target_lookup, targets_page_full, valid_ids, run_chunkers, persisted_searches, search_detail, compatible_searches, compare_labelled,
    )
}

FETCHES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM fetches WHERE target_id IS NOT NULL) WHERE rn = 1)"
SUPPORTED = f"coalesce({MEDIA} IN ('text/html', 'application/xhtml+xml', 'text/plain', 'text/xml', 'application/xml'), false)"
EXTENSION = f"CASE WHEN contains(coalesce({MEDIA}, ''), 'xml') THEN 'xml' WHEN contains(coalesce({MEDIA}, ''), 'html') THEN 'html' ELSE 'txt' END"
OWNER = f"(SELECT document_id, min(pipeline_id) AS pipeline_id FROM {CURRENT} WHERE document_id IS NOT NULL GROUP BY 1)"
ORIGIN = lambda u: f"lower(regexp_extract({u}, '{PARTS}', 1)) || '://' || lower(regexp_extract({u}, '{PARTS}', 2))"
PAGES = "(SELECT document_id, arg_max(text, (length(text), source_url)) AS text, any_value(parser_metadata) AS parser_metadata FROM documents WHERE document_id IS NOT NULL GROUP BY 1)"
BLOCK = "json_extract(actor_configs, '$.chunk_document')"
NAME = f"coalesce(json_extract_string({BLOCK}, '$.chunker'), CASE json_extract_string({BLOCK}, '$.strategy') WHEN 'fixed' THEN 'text_fixed' WHEN 'recursive' THEN 'text_recursive' WHEN 'markdown' THEN 'text_markdown' WHEN 'sentence' THEN 'text_sentence' WHEN 'section' THEN 'text_section' WHEN 'sliding_window' THEN 'text_sliding_window' ELSE json_extract_string({BLOCK}, '$.strategy') END, 'text_markdown')"
SETTING = lambda name, default: f"CAST(coalesce(try_cast(json_extract_string({BLOCK}, '$.settings.{name}') AS DOUBLE), try_cast(json_extract_string({BLOCK}, '$.{name}') AS DOUBLE), {default}) AS INT)"
RUN_CHUNKERS = f"SELECT pipeline_id, {NAME} AS chunker, {SETTING('chunk_size', 1200)} AS chunk_size, {SETTING('chunk_overlap', 150)} AS chunk_overlap FROM runs"
DOCUMENT_CHUNKERS = f"(SELECT p.document_id, p.text, coalesce(r.chunker, 'text_markdown') AS chunker, r.chunk_size, r.chunk_overlap FROM {PAGES} p LEFT JOIN {OWNER} o USING (document_id) LEFT JOIN ({RUN_CHUNKERS}) r ON r.pipeline_id = o.pipeline_id)"
STAGE_SENTENCES = (
    SENTENCE_SQL.replace("doc_id, list_filter", "document_id AS doc_id, chunk_size, chunk_overlap, list_filter").replace("FROM documents WHERE text IS NOT NULL", f"FROM {DOCUMENT_CHUNKERS} WHERE text IS NOT NULL AND chunker = 'text_sentence'")
    .replace("walk(doc_id, p, i, s, n, chunk)", "walk(doc_id, chunk_size, chunk_overlap, p, i, s, n, chunk)").replace("SELECT doc_id, p, CAST(1", "SELECT doc_id, chunk_size, chunk_overlap, p, CAST(1").replace("SELECT doc_id, p, i + 1", "SELECT doc_id, chunk_size, chunk_overlap, p, i + 1")
    .replace("<= 150", "<= chunk_overlap").replace("> 1200", "> chunk_size").replace("SELECT doc_id, row_number()", "SELECT doc_id AS document_id, row_number()")
)
PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in lifecycle.transitions())
VECTORS = f"(SELECT id AS chunk_id, {UNIT} AS v FROM ({embed_sql(f'(SELECT chunk_id AS id, text FROM {CHUNKS} WHERE text IS NOT NULL)')}))"
OUTBOX = "(SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'sent' ELSE 'pending' END AS status, event_type, ts FROM events)"
TRIMMED = r"regexp_replace(coalesce(@, ''), '^[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')"
UUID = lambda c: f"CASE WHEN regexp_matches(lower(trim({c})), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN lower(trim({c})) END"

SQL = {
    "fetch_stage": f"""SELECT target_id, CASE WHEN http_status = 429 OR http_status BETWEEN 500 AND 599 THEN 'failed_transient' WHEN http_status >= 400 THEN 'failed_permanent' WHEN NOT {SUPPORTED} THEN 'skipped_unsupported' ELSE 'fetched' END AS status,
CASE WHEN http_status >= 400 THEN 'http_' || http_status WHEN NOT {SUPPORTED} THEN 'unsupported_content_type' END AS reason, {EXTENSION} AS extension, CASE WHEN source_url IS NULL THEN NULL WHEN starts_with(source_url, 'file://') OR starts_with(source_url, '/') THEN 'local' ELSE 'web' END AS source_type, sha256(coalesce(content, '')) AS content_hash FROM {FETCHES}""",
    "artifact_files": rf"""SELECT f.target_id, t.pipeline_id, 'raw' AS kind, coalesce(r.folder, '_no_run') || '/sources/' || f.target_id || '/raw/content.' || {EXTENSION} AS path, sha256(f.content) AS content_hash FROM {FETCHES} f JOIN {CURRENT} t USING (target_id)
LEFT JOIN (SELECT pipeline_id, CASE WHEN s = '' THEN pipeline_id ELSE pipeline_id || '__' || s END AS folder FROM (SELECT pipeline_id, substr({SLUG.replace('@', 'coalesce(name, chr(32))')}, 1, 40) AS s FROM runs)) r ON r.pipeline_id = t.pipeline_id
WHERE f.content IS NOT NULL AND t.pipeline_id IS DISTINCT FROM (SELECT min(pipeline_id) FROM runs)""",
    "upsert_documents": f"""SELECT target_id, CASE WHEN o.known THEN o.document_id ELSE 'new-' || target_id END AS document_id, CASE WHEN f.fresh THEN f.http_status ELSE o.http_status END AS http_status, CASE WHEN f.fresh THEN f.content_type ELSE o.content_type END AS content_type,
CASE WHEN f.fresh THEN f.final_url ELSE o.final_url END AS final_url, o.text_hash FROM (SELECT *, true AS known FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY document_id NULLS FIRST, http_status NULLS FIRST, content_type NULLS FIRST, final_url NULLS FIRST, text_hash NULLS FIRST) AS rn FROM documents WHERE target_id IS NOT NULL) WHERE rn = 1) o
FULL JOIN (SELECT *, true AS fresh FROM {FETCHES}) f USING (target_id)""",
    "upsert_links": f"""WITH new AS (SELECT source_chunk_id, norm AS normalized_url, arg_min(u, (pos, label, u)) AS raw_url FROM {url_sql(f'(SELECT source_chunk_id, pos, label, url AS u FROM ({EXTRACT}))')} GROUP BY 1, 2),
old AS (SELECT source_chunk_id, normalized_url, arg_min(raw_url, (created_at, link_id, raw_url)) AS raw_url, arg_min(status, (created_at, link_id, raw_url)) AS status FROM links WHERE source_chunk_id IS NOT NULL AND normalized_url IS NOT NULL GROUP BY 1, 2)
SELECT source_chunk_id, normalized_url, coalesce(new.raw_url, old.raw_url) AS raw_url, coalesce(old.status, 'pending') AS status FROM old FULL JOIN new USING (source_chunk_id, normalized_url)""",
    "validate_local": """WITH l AS (SELECT '/' || raw_content_path AS path, bool_or(content IS NOT NULL) AS readable FROM fetches WHERE http_status = 200 AND raw_content_path IS NOT NULL GROUP BY 1)
SELECT DISTINCT 'file:///' || raw_content_path AS path, 'file:///' || raw_content_path AS normalized_url, CASE WHEN l.path IS NULL THEN 'file_not_found' WHEN NOT l.readable THEN 'file_not_readable' END AS reason FROM fetches f LEFT JOIN l ON l.path = '/' || f.raw_content_path WHERE raw_content_path IS NOT NULL""",
    "validate_stage": f"""WITH c AS (SELECT o.pipeline_id, x.norm AS normalized_url, x.d AS parent, x.norm AS u FROM {url_sql('(SELECT DISTINCT source_document_id AS d, raw_url AS u FROM links WHERE source_document_id IS NOT NULL AND raw_url IS NOT NULL)')} x JOIN {OWNER} o ON o.document_id = x.d),
g AS (SELECT c.pipeline_id, c.normalized_url, bool_or(coalesce({ORIGIN('d.source_url')} = {ORIGIN('c.u')}, false)) AS ok FROM c LEFT JOIN {DOCS} d ON d.document_id = c.parent GROUP BY 1, 2)
SELECT pipeline_id, normalized_url, CASE WHEN known OR NOT ok THEN 'skipped' ELSE 'queued' END AS decision, CASE WHEN known THEN 'url_already_queued' WHEN NOT ok THEN 'cross_origin' END AS reason
FROM (SELECT g.*, EXISTS (SELECT 1 FROM {CURRENT} t WHERE t.pipeline_id = g.pipeline_id AND t.normalized_url = g.normalized_url AND t.status NOT IN ('failed_transient', 'failed')) AS known FROM g)""",
    "filter_acts": rf"""SELECT act_id, CASE WHEN ok THEN 'filtered' ELSE 'skipped' END AS status, CASE WHEN NOT ok THEN 'not_relevant' END AS skip_reason FROM (SELECT act_id, regexp_matches(title, '{KW(INCLUDE)}', 'i') AS ok
FROM (SELECT act_id, arg_max(title, received_at) AS title FROM legal_acts WHERE act_id IS NOT NULL GROUP BY 1) WHERE trim(title) <> '')""",
    "parse_stage": f"""SELECT target_id, parser, CASE WHEN parser IS NULL THEN 'skipped_unsupported' ELSE 'parsed' END AS status, 'unknown' AS language, '1' AS parser_version, '3' AS chunker_version, CAST(NULL AS VARCHAR) AS error, CASE WHEN parser = 'plain' THEN sha256({TRIMMED.replace('@', 'content')}) END AS plain_hash
FROM (SELECT *, CASE WHEN {MEDIA} IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN {MEDIA} IN ('text/xml', 'application/xml') THEN 'xml' WHEN {MEDIA} = 'text/plain' THEN 'plain' END AS parser FROM {FETCHES} WHERE content IS NOT NULL)""",
    "json_guard": f"SELECT chunk_id, CASE WHEN chunk_metadata IS NULL THEN true ELSE coalesce(strlen(CAST(json(CASE WHEN json_valid(chunk_metadata) THEN chunk_metadata END) AS VARCHAR)) <= {MOST_BYTES}, false) END AS fits FROM {CHUNKS}",
    "chunk_stage_sentences": STAGE_SENTENCES,
    "chunk_stage_documents": f"SELECT document_id, chunker, true AS whole, true AS placed FROM {DOCUMENT_CHUNKERS} WHERE {TRIMMED.replace('@', 'text')} <> ''",
    "embed_stage": f"SELECT chunk_id, c.document_id, c.chunk_index, c.chunk_type, o.pipeline_id AS pipeline_run_id, CAST(i - 1 AS INT) AS component, round(v[i], 6) AS value FROM {VECTORS} JOIN {CHUNKS} c USING (chunk_id) LEFT JOIN {OWNER} o ON o.document_id = c.document_id, LATERAL unnest(range(1, 65)) AS u(i) WHERE v[i] <> 0",
    "embed_client": f"SELECT id AS query_id, CAST(i - 1 AS INT) AS component, round(v[i], 6) AS value FROM (SELECT id, {UNIT} AS v FROM ({embed_sql('(SELECT item_id AS id, text FROM eval_items)')})), LATERAL unnest(range(1, 65)) AS u(i)",
    "stored_search": f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.id AS query_id, c.chunk_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score
FROM (SELECT id, {UNIT} AS v FROM ({embed_sql('(SELECT item_id AS id, text FROM eval_items)')})) q, {VECTORS} c WHERE list_dot_product(c.v, c.v) > 0)) WHERE rank <= {TOP_K}""",
    "hybrid_stored": retrieval.hydrated(HYBRID),
    "tls_policy": rf"SELECT DISTINCT raw_url, regexp_replace(regexp_replace(lower(regexp_extract(raw_url, '{PARTS}', 2)), '^.*@', ''), ':\d*$', '') IN ({', '.join(repr(x) for x in RELAXED)}) AS relaxed FROM links WHERE raw_url IS NOT NULL",
    "collection_names": "SELECT pipeline_id, 'kb_' || dataset.name || '_qwen_embed_8b' AS collection FROM runs",
    "state_changes": f"""WITH s AS (SELECT target_id, status, lag(status) OVER w AS old_status, row_number() OVER w AS step FROM (SELECT DISTINCT target_id, status, updated_at, created_at FROM targets WHERE target_id IS NOT NULL) WINDOW w AS (PARTITION BY target_id ORDER BY updated_at NULLS FIRST, created_at NULLS FIRST, status NULLS FIRST))
SELECT target_id, step, old_status, status AS new_status, old_status = status OR (old_status, status) IN ({PAIRS_SQL}) AS allowed FROM s WHERE step > 1""",
    "claim_targets": f"SELECT target_id, coalesce(status IN ('queued', 'failed_transient', 'fetching'), false) AS won, CASE WHEN status IN ('queued', 'failed_transient', 'fetching') THEN 'fetching' ELSE status END AS status FROM {CURRENT}",
    "retry_failures": "SELECT http_status, CAST(n AS INT) AS attempts, CASE WHEN http_status = 429 OR http_status BETWEEN 500 AND 599 THEN CASE WHEN n <= 3 THEN 'retry' ELSE 'failed_transient' END WHEN http_status >= 400 THEN 'failed_permanent' END AS next FROM (SELECT DISTINCT http_status FROM fetches), LATERAL unnest(range(1, 6)) AS u(n)",
    "stamp_processed": f"SELECT target_id, CASE WHEN status = 'parsed' THEN 'processed' ELSE status END AS status, CASE WHEN status IN ('parsed', 'processed') THEN coalesce(processed_at, TIMESTAMP '2030-01-01 00:00:00') ELSE processed_at END AS processed_at FROM {CURRENT}",
    "dispatch_outbox": f"SELECT event_id, CASE WHEN due AND event_type <> 'error' THEN 'sent' ELSE status END AS status, CASE WHEN due AND event_type = 'error' THEN 1 ELSE 0 END AS attempts FROM (SELECT *, event_id IN (SELECT event_id FROM {OUTBOX} WHERE status = 'pending' ORDER BY ts, event_id LIMIT 100) AS due FROM {OUTBOX})",
    "count_new_events": "SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0 GROUP BY 1",
    "document_chunks": f"SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS place FROM {CHUNKS} WHERE document_id IS NOT NULL",
    "discovered_targets": f"SELECT target_id, normalized_url FROM {CURRENT} WHERE status = 'discovered' ORDER BY created_at NULLS LAST, target_id LIMIT 100",
    "target_lookup": f"""WITH t AS (SELECT pipeline_id, normalized_url, arg_min(target_id, (created_at, target_id)) AS target_id, arg_min(status, (created_at, target_id)) AS status FROM {CURRENT} WHERE normalized_url IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT t.pipeline_id, t.normalized_url, t.target_id, t.status FROM links l JOIN {OWNER} o ON o.document_id = l.source_document_id JOIN t ON t.pipeline_id = o.pipeline_id AND t.normalized_url = l.normalized_url""",
    "targets_page_full": f"SELECT target_id, original_url, normalized_url, status, skip_reason, error, (SELECT count(*) FROM {CHUNKS} c WHERE c.document_id = t.document_id) AS chunk_count, document_id, created_at, updated_at, processed_at, (SELECT count(*) FROM {CURRENT}) AS total FROM {CURRENT} t ORDER BY created_at NULLS LAST, target_id LIMIT 200",
    "valid_ids": f"SELECT DISTINCT source_chunk_id, raw_url, {UUID('source_chunk_id')} AS chunk_uuid, {UUID('raw_url')} AS url_uuid FROM links",
    "run_chunkers": RUN_CHUNKERS,
    "persisted_searches": f"SELECT CAST(query_id AS VARCHAR) AS source_id, e.text AS query_text, '{{\"method\":\"hybrid\",\"top_k\":{TOP_K}}}' AS search_config, CAST(count(*) AS INT) AS n_results, arg_min(h.id, rank) AS best_chunk FROM ({HYBRID}) h JOIN eval_items e ON e.item_id = h.query_id GROUP BY 1, 2",
    "search_detail": f"SELECT search_id || '/' || query_id AS search_id, CAST(query_id AS VARCHAR) AS query_text, rank, 'c' || id AS chunk_id, score FROM {LAB}",
    "compatible_searches": f"""WITH k AS (SELECT DISTINCT search_id || '/' || query_id AS search_id, 'd' || (query_id % 3) AS d, CAST(query_id AS VARCHAR) AS t FROM {LAB}), f AS (SELECT * FROM k ORDER BY search_id LIMIT 1)
SELECT k.search_id, false AS any_query FROM k, f WHERE k.d = f.d AND k.t = f.t UNION ALL SELECT k.search_id, true FROM k, f WHERE k.d = f.d""",
    "compare_labelled": f"SELECT 'hash' AS model, source_id, candidate_id, dot, manhattan FROM ({retrieval.PAIRS}) ORDER BY manhattan NULLS LAST, source_id, candidate_id LIMIT 100",
}
