"""Queries of the ingestion side: URLs, gates, parsing, chunking, links, state. Each with its SQL where there is one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions import urls as U
from actloom.io import table
from actloom.operators import act_xml as act_writer
from actloom.operators import chunkers, keyed, links, runs, state
from actloom.operators.acts import Config
from actloom.sources import parsers

SIZE, OVERLAP = 1200, 150
INCLUDE, EXCLUDE = ["permit", "register", "vessel"], ["timber", "appeal"]


def q(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


# --- URLs and decisions --------------------------------------------------------
def url_normalize(spark, folder):
    """Every spelling of a link with its normalised URL and origin."""
    return q(spark, folder, "links").where("raw_url is not null").select("raw_url", U.normalize_url(F.col("raw_url")).alias("url"), U.origin(F.col("raw_url")).alias("origin")).distinct()


PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
URL_SQL = r"""(SELECT *, CASE WHEN h <> '' OR s IN ('http', 'https', 'file', 'ftp', '') THEN s || '://' || h || CASE WHEN p2 = '' OR p2[1] = '/' THEN p2 ELSE '/' || p2 END ELSE s || ':' || p2 END AS norm FROM (
  SELECT *, CASE WHEN p1 = '/' THEN p1 ELSE regexp_replace(p1, '/+$', '') END AS p2,
    CASE s WHEN 'http' THEN regexp_replace(n, ':80$', '') WHEN 'https' THEN regexp_replace(n, ':443$', '') ELSE n END AS h FROM (
    SELECT *, CASE WHEN s0 = '' THEN 'https' ELSE s0 END AS s, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS p1 FROM (
      SELECT *, lower(regexp_extract(u, '@P', 1)) AS s0, lower(regexp_extract(u, '@P', 2)) AS n, regexp_replace(regexp_extract(u, '@P', 3), ';[^/]*$', '') AS p0 FROM @T))))""".replace("@P", PARTS)


def url_sql(source: str) -> str:
    return URL_SQL.replace("@T", source)


def url_origin_gate(spark, folder):
    """Each link with whether it may be crawled: without a document always, else from the origin of its document, so not from a missing one."""
    documents = keyed.pick(q(spark, folder, "documents").select("document_id", "source_url").where("document_id is not null"), ["document_id"], [F.col("source_url")])
    own = keyed.pick(q(spark, folder, "links").select("link_id", "source_document_id", "normalized_url").where("link_id is not null"), ["link_id"], [F.col("normalized_url")])
    joined = own.withColumn("document_id", F.coalesce("source_document_id", F.concat(F.lit("\0"), "link_id"))).join(documents, "document_id", "left")
    return joined.select("link_id", links.same_origin(F.col("source_document_id"), F.col("source_url"), F.col("normalized_url")).alias("allowed"))


def seed_scheme(spark, folder):
    """The seeds of each run."""
    return runs.web_seeds(q(spark, folder, "runs"))


def dedup_targets(spark, folder):
    """Links that would be new targets: their URL is no active target of the run of their document; one row a run and URL."""
    targets = state.current(q(spark, folder, "targets").select("target_id", "pipeline_id", "normalized_url", "status", "document_id", "updated_at", "created_at"))
    active = targets.where(~F.col("status").isin(*state.REQUEUEABLE)).select("pipeline_id", "normalized_url")
    owner = keyed.pick(targets.select("document_id", "pipeline_id").where("document_id is not null"), ["document_id"], [F.col("pipeline_id")])
    found = q(spark, folder, "links").where("normalized_url is not null").select(F.col("source_document_id").alias("document_id"), "normalized_url").distinct().join(owner, "document_id")
    return keyed.new_only(found.select("pipeline_id", "normalized_url").distinct(), active, ["pipeline_id", "normalized_url"])


def mime_classify(spark, folder):
    """Media type, support, extension and parser of every spelling of a content type."""
    c = F.col("content_type")
    return q(spark, folder, "fetches").select("content_type", U.media_type(c).alias("media_type"), F.coalesce(U.media_type(c).isin(*U.SUPPORTED_TYPES), F.lit(False)).alias("supported"), U.extension(c).alias("extension"), parsers.parser_name(c).alias("parser")).groupBy("content_type", "media_type", "supported", "extension", "parser").agg(F.count("*").alias("n"))


def http_failure_class(spark, folder):
    """Documents by status and class of failure."""
    return q(spark, folder, "documents").groupBy("http_status", U.failure_class(F.col("http_status")).alias("failure")).agg(F.count("*").alias("n"))


def content_hash(spark, folder):
    return q(spark, folder, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.token_estimate(F.col("text")).alias("token_estimate"))


def log_slug(spark, folder):
    """The log folder of each target under that of the target its parent document came from."""
    rows = state.current(q(spark, folder, "targets").select("target_id", "original_url", "normalized_url", "parent_document_id", "log_dir", "updated_at", "created_at"))
    owners = keyed.pick(q(spark, folder, "documents").select("document_id", F.col("target_id").alias("parent_target")).where("document_id is not null"), ["document_id"], [F.col("parent_target")])
    parents = rows.select(F.col("target_id").alias("parent_target"), F.col("log_dir").alias("parent_dir"))
    keyed_rows = rows.withColumn("document_id", F.coalesce("parent_document_id", F.concat(F.lit("\0"), "target_id"))).join(owners, "document_id", "left")
    keyed_rows = keyed_rows.withColumn("parent_target", F.coalesce("parent_target", F.concat(F.lit("\0"), "target_id"))).join(parents, "parent_target", "left")
    return keyed_rows.select("target_id", U.log_dir(F.col("original_url"), F.col("normalized_url"), F.col("parent_dir")).alias("log_dir"))


def run_folders(spark, folder):
    return q(spark, folder, "runs").select("pipeline_id", U.run_folder(F.col("pipeline_id"), F.col("name")).alias("folder"))


def keyword_filter(spark, folder):
    """Whether each document passes the include and exclude gates over its title and text."""
    title = F.get_json_object("parser_metadata", "$.title")
    return q(spark, folder, "documents").select("doc_id", T.relevant(title, F.col("text"), True, INCLUDE, EXCLUDE).alias("relevant"), T.included(title, F.col("text"), INCLUDE).alias("included"), T.excluded(title, F.col("text"), EXCLUDE).alias("excluded"))


KW = lambda words: r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)"


# --- chunks --------------------------------------------------------------------
def texts(spark, folder):
    return q(spark, folder, "documents").select("doc_id", "text").where("doc_id is not null")


def chunk_sliding_window(spark, folder):
    return chunkers.sliding_window(texts(spark, folder), "doc_id")


def chunk_fixed(spark, folder):
    return chunkers.fixed(texts(spark, folder), "doc_id", size=SIZE, overlap=OVERLAP)


def chunk_sentence(spark, folder):
    return chunkers.sentences(texts(spark, folder), "doc_id", size=SIZE, overlap=OVERLAP)


def chunk_by(name):
    def query(spark, folder):
        return chunkers.chunk_with(texts(spark, folder), "doc_id", chunkers.STRATEGIES[name]())

    query.__doc__ = f"All documents by the chunker {name}."
    return query


def checked(name, size, overlap):
    """Each document by a splitter: whether its chunks fit the size where they have inner blanks, are the texts at their offsets in rising order, and leave out nothing but white space."""

    def query(spark, folder):
        own = texts(spark, folder)
        found = chunkers.chunk_with(own, "doc_id", chunkers.STRATEGIES[name](size, overlap)).where("start_offset is not null").join(own.select("doc_id", F.col("text").alias("whole")), "doc_id")
        cut = F.substring("whole", (F.col("start_offset") + 1).cast("int"), (F.col("end_offset") - F.col("start_offset")).cast("int"))
        placed = found.select("doc_id", "whole", "start_offset", "end_offset", (cut == F.col("text")).alias("placed"), ((F.length("text") <= size) | ~F.col("text").contains(" ")).alias("fits"))
        spans = F.array_sort(F.collect_list(F.struct("start_offset", "end_offset")))
        # What is left between a chunk and the next, and after the last one.
        step = lambda acc, x: F.struct(F.concat(acc["gaps"], F.when(x["start_offset"] > acc["at"], F.substring("whole", (acc["at"] + 1).cast("int"), (x["start_offset"] - acc["at"]).cast("int"))).otherwise("")).alias("gaps"), F.greatest(acc["at"], x["end_offset"]).alias("at"))
        zero = F.struct(F.lit("").alias("gaps"), F.lit(0).cast("long").alias("at"))
        one = placed.groupBy("doc_id", "whole").agg(F.min("placed").alias("placed"), F.min("fits").alias("fits"), spans.alias("spans"))
        left = one.withColumn("x", F.aggregate("spans", zero, step))
        rest = F.concat("x.gaps", F.expr("substring(whole, cast(x.at + 1 as int))"))
        return left.select("doc_id", "placed", "fits", (F.regexp_replace(rest, r"(?U)[\s\x1c-\x1f]+", "") == "").alias("covered"))

    query.__doc__ = checked.__doc__
    return query


def act_xml(spark, folder) -> DataFrame:
    """Legal acts written out as act XML, whole, from their latest records: the input of the act chunker."""
    fields = ["title", "sections", "amendments", "metadata"]
    acts = keyed.pick(q(spark, folder, "legal_acts").select("act_id", *fields, "document_id", "source_url", "lang", "received_at").where("act_id is not null"), ["act_id"], [F.col("received_at"), *map(F.col, fields)], last=True)

    @F.pandas_udf("string")
    def xml(title: pd.Series, sections: pd.Series, amendments: pd.Series, metadata: pd.Series) -> pd.Series:
        return pd.Series([act_writer.write(*x) for x in zip(title, sections, amendments, metadata)], dtype=object)

    return acts.select("act_id", "document_id", F.coalesce("title", F.lit("act")).alias("text"), xml(*fields).alias("raw"), "source_url", F.coalesce("lang", F.lit("en")).alias("lang"))


def chunk_legal_xml(spark, folder):
    return chunkers.chunk_with(act_xml(spark, folder), "act_id", chunkers.act_splitter(Config()), raw="raw", source_url="source_url", language="lang")


def chunk_stats_report(spark, folder):
    """Chunks by type: number, least, mean and most estimated tokens, those under 100."""
    tokens = T.token_estimate(F.col("text"))
    own = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "chunk_type", "text", "created_at")).select("chunk_type", tokens.alias("t"))
    return own.groupBy("chunk_type").agg(F.count("*").alias("n"), F.min("t").alias("least"), F.round(F.avg("t"), 1).alias("mean"), F.max("t").alias("most"), F.sum(F.when(F.col("t") < 100, 1).otherwise(0)).alias("under_100"))


def chunk_largest(spark, folder):
    """The ten largest chunks."""
    own = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "text", "created_at"))
    return own.select("chunk_id", T.token_estimate(F.col("text")).alias("tokens")).orderBy(F.desc("tokens"), "chunk_id").limit(10)


def metadata_merge(spark, folder):
    """Chunk metadata over the parser metadata of the document, as a map."""
    own = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    documents = keyed.pick(q(spark, folder, "documents").select("document_id", "parser_metadata").where("document_id is not null"), ["document_id"], [F.col("parser_metadata")])
    joined = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_metadata", "created_at")).join(documents, "document_id")
    a, b = own(F.col("parser_metadata")), own(F.col("chunk_metadata"))
    merged = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return joined.select("chunk_id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";").alias("metadata"))


# --- links ---------------------------------------------------------------------
def markdown_of_links(spark, folder) -> DataFrame:
    """The links of each chunk written as markdown, in order of their ids: the input of link extraction."""
    own = q(spark, folder, "links").where("source_chunk_id is not null and raw_url is not null and coalesce(anchor_text, '') <> ''").select("link_id", "source_chunk_id", F.concat(F.lit("see ["), "anchor_text", F.lit("]("), "raw_url", F.lit("), ")).alias("m"))
    return own.distinct().groupBy("source_chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "m"))), lambda x: x["m"]), "").alias("text"))


def link_extract(spark, folder):
    return links.extract_links(markdown_of_links(spark, folder), "source_chunk_id")


def link_dedup(spark, folder):
    return links.chunk_links(link_extract(spark, folder), "source_chunk_id").select("source_chunk_id", "pos", "normalized_url")


def crawl_frontier_bfs(spark, folder):
    """Documents' URLs reached over the links from the roots of the crawl, at their least depth."""
    pages = q(spark, folder, "documents").where("document_id is not null").groupBy("document_id").agg(F.min("normalized_url").alias("source"))
    edges = q(spark, folder, "links").select(F.col("source_document_id").alias("document_id"), F.col("normalized_url").alias("target")).distinct().join(pages, "document_id").select("source", "target")
    seeds = q(spark, folder, "targets").where("parent_document_id is null and parent_chunk_id is null and depth = 0 and document_id is not null").select(F.col("normalized_url").alias("url"))
    return links.frontier(edges, seeds)


def pending_links(spark, folder):
    """Links that wait, by document."""
    own = keyed.pick(q(spark, folder, "links").select("link_id", "source_document_id", "status", "created_at").where("link_id is not null"), ["link_id"], [F.col("created_at")])
    return own.where("status in ('pending', 'discovered')").groupBy("source_document_id").agg(F.count("*").alias("n_pending"))


def schedule_links(spark, folder):
    """One frontier event for each pending link of a run that follows links, and the status the link gets."""
    own = keyed.pick(q(spark, folder, "links").select("link_id", "source_document_id", "normalized_url", "status", "created_at").where("link_id is not null"), ["link_id"], [F.col("created_at")])
    targets = state.current(q(spark, folder, "targets").select("target_id", "pipeline_id", "document_id", "updated_at", "created_at"))
    owner = keyed.pick(targets.select(F.col("document_id").alias("source_document_id"), "pipeline_id").where("document_id is not null"), ["source_document_id"], [F.col("pipeline_id")])
    follows = q(spark, folder, "runs").select("pipeline_id", (runs.setting("schedule_discovered_links.settings.follow_child_links", "true") == "true").alias("follows"))
    waiting = own.where("status = 'pending'").join(owner, "source_document_id").join(follows, "pipeline_id").where("follows")
    return waiting.select(F.concat(F.lit("frontier:"), "link_id").alias("dedup_key"), "pipeline_id", "normalized_url", F.lit("scheduled").alias("status"))


# --- state ---------------------------------------------------------------------
def run_counters(spark, folder):
    """Embeddings scheduled and completed by run, derived from what is there: chunks, and those embedded."""
    counts = status_counts(spark, folder)
    done = F.when(F.col("status") == "embedded", F.col("n_chunks")).otherwise(0)
    return counts.groupBy("pipeline_id").agg(F.sum("n_chunks").alias("scheduled"), F.sum(done).alias("completed"))


def mark_embedded(spark, folder):
    """Chunk statuses after the chunks of all targets in embedding were embedded."""
    own = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "document_id", "status", "created_at"))
    targets = state.current(q(spark, folder, "targets").select("target_id", "document_id", "status", "updated_at", "created_at")).where("status = 'embedding'")
    return state.marked_embedded(own, own.join(targets.select("document_id"), "document_id", "left_semi").select("chunk_id")).select("chunk_id", "status")


def filter_stage(spark, folder):
    """The filter stage over raw pages: the include and exclude gates over content before it is parsed, and the status each gets."""
    own = keyed.pick(q(spark, folder, "fetches").select("target_id", "content", "fetched_at").where("target_id is not null and content is not null"), ["target_id"], [F.col("fetched_at")], last=True)
    passed = T.relevant(F.lit(""), F.col("content"), True, INCLUDE, EXCLUDE)
    return own.select("target_id", F.when(passed, "fetched").otherwise("skipped").alias("status"), F.when(~passed, "not_relevant").alias("skip_reason"))


def vector_upsert(spark, folder):
    """A collection after new vectors replaced those of the same id, every tenth one negated: all components of all vectors."""
    old = q(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    new = old.where("vec_id % 10 = 0").select("vec_id", "label", F.transform("vector", lambda x: -x).alias("vector"))
    done = keyed.upsert(old, new, ["vec_id"])
    return done.select("vec_id", "label", F.posexplode("vector").alias("component", "value")).select("vec_id", "label", "component", F.round("value", 6).alias("value"))


def status_counts(spark, folder):
    return state.status_counts(q(spark, folder, "targets"), q(spark, folder, "chunks"))


def embedding_rollup(spark, folder):
    return state.embedding_rollup(status_counts(spark, folder))


def targets_page(spark, folder):
    """The second page of fifty targets in order of creation, with their chunks."""
    rows = state.targets_with_chunks(q(spark, folder, "targets"), q(spark, folder, "chunks"))
    return state.page(rows, 50, 50).select("target_id", "original_url", "status", "document_id", "chunk_count")


def target_chunks(spark, folder):
    """Every target with its number of chunks and processing time."""
    rows = state.targets_with_chunks(q(spark, folder, "targets"), q(spark, folder, "chunks"))
    return rows.select("target_id", "chunk_count", F.round(state.processing_seconds(F.col("created_at"), F.col("processed_at")), 3).alias("seconds"))


def active_targets(spark, folder):
    return state.active_counts(q(spark, folder, "targets"))


def finalize_targets(spark, folder):
    return state.finalized(q(spark, folder, "targets"), q(spark, folder, "chunks"))


def documents_embedded(spark, folder):
    return state.fully_embedded(q(spark, folder, "documents"), q(spark, folder, "chunks"))


def run_completion(spark, folder):
    return state.completed(q(spark, folder, "runs"), q(spark, folder, "targets"))


def outbox_dedup(spark, folder):
    """Events once per dedup key (user, type, hour): the earliest; and how many deliveries it had."""
    own = q(spark, folder, "events").withColumn("dedup_key", F.concat_ws(":", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH")))
    return own.groupBy("dedup_key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("deliveries"))


def outbox_pending(spark, folder):
    """The oldest hundred events that are no error."""
    return q(spark, folder, "events").where("event_type <> 'error'").orderBy("ts", "event_id").limit(100).select("event_id", "event_type")


def latest_status(spark, folder):
    return q(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def upsert_chunks(spark, folder):
    """Chunks over those of before: all documents chunked anew at fixed size; texts of new ones win, the status stays, higher indexes of before stay."""
    own = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", F.sha2("text", 256).alias("text_hash"), "status", "created_at")).where("document_id is not null").drop("created_at", "chunk_id")
    documents = keyed.pick(q(spark, folder, "documents").select("document_id", "text").where("document_id is not null"), ["document_id"], [F.col("text")])
    new = chunkers.fixed(documents, "document_id", size=SIZE, overlap=OVERLAP).select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.sha2("text", 256).alias("text_hash"), F.lit("chunked").alias("status"))
    return keyed.upsert(own, new, ["document_id", "chunk_index"], keep=["status"])


def upsert_fetches(spark, folder):
    """The latest fetch of each target."""
    own = q(spark, folder, "fetches").select("target_id", "content_hash", "http_status", "fetched_at").where("target_id is not null")
    return keyed.pick(own, ["target_id"], [F.col("fetched_at")], last=True)


def embed_batches(spark, folder):
    """Batches of 32 chunks of each document, with the key of their event."""
    own = state.unique_chunks(q(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "created_at")).where("document_id is not null and chunk_index is not null")
    start = (F.floor(F.col("chunk_index") / 32) * 32).cast("long")
    return own.groupBy("document_id", start.alias("start")).agg(F.count("*").alias("n_chunks")).select(F.concat_ws(":", F.lit("embed"), "document_id", F.col("start").cast("string")).alias("event_key"), "n_chunks")


# --- parsing -------------------------------------------------------------------
def html_to_text(spark, folder):
    """Stored pages parsed by their content type."""
    own = keyed.pick(q(spark, folder, "fetches").select("target_id", "content", "content_type", "fetched_at").where("target_id is not null and content is not null"), ["target_id"], [F.col("fetched_at")], last=True)
    return parsers.parse(own, "target_id")


def xml_parse(spark, folder):
    """Acts in XML parsed to title and text."""
    return parsers.parse(act_xml(spark, folder).withColumn("content_type", F.lit("application/xml")), "act_id", "raw")


def xml_titles(spark, folder):
    """Acts with their title from the XML, with sections counted in the text."""
    return xml_parse(spark, folder).select("act_id", "title")


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_origin_gate, seed_scheme, dedup_targets, mime_classify, http_failure_class, content_hash, log_slug, run_folders, keyword_filter,
        chunk_sliding_window, chunk_fixed, chunk_sentence, chunk_stats_report, chunk_largest, metadata_merge, link_extract, link_dedup, crawl_frontier_bfs, pending_links,
        status_counts, embedding_rollup, targets_page, target_chunks, active_targets, finalize_targets, documents_embedded, run_completion, outbox_dedup, outbox_pending,
        latest_status, upsert_chunks, schedule_links, run_counters, mark_embedded, filter_stage, vector_upsert, upsert_fetches, embed_batches, html_to_text, xml_parse, xml_titles, chunk_legal_xml,
    )
} | {f"chunk_{n}": chunk_by(f"text_{n}") for n in ("recursive", "markdown", "section")} | {f"chunk_{n}_checked": checked(f"text_{n}", SIZE, OVERLAP) for n in ("recursive", "markdown")}

CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS rn FROM targets WHERE target_id IS NOT NULL) WHERE rn = 1)"
CHUNKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"
DOCS = "(SELECT document_id, min(source_url) AS source_url, min(target_id) AS target_id, min(parser_metadata) AS parser_metadata, min(normalized_url) AS normalized_url FROM documents WHERE document_id IS NOT NULL GROUP BY 1)"
TOKENS = "CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(round_even(length(text) / 4, 0), 1) END AS BIGINT)"
FINISHED = "('processed', 'skipped', 'skipped_unsupported', 'failed_transient', 'failed_permanent', 'failed')"
SLUG = r"regexp_replace(regexp_replace(lower(@), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"
MEDIA = "lower(trim(split_part(content_type, ';', 1)))"
STATUS_SQL = f"SELECT t.pipeline_id, c.status, count(*) AS n_chunks FROM {CHUNKS} c JOIN {CURRENT} t ON c.document_id = t.document_id GROUP BY 1, 2"
LINK_MD = "(SELECT source_chunk_id, string_agg(m, '' ORDER BY link_id) AS text FROM (SELECT DISTINCT link_id, source_chunk_id, 'see [' || anchor_text || '](' || raw_url || '), ' AS m FROM links WHERE source_chunk_id IS NOT NULL AND raw_url IS NOT NULL AND coalesce(anchor_text, '') <> '') GROUP BY 1)"
EXTRACT = rf"SELECT source_chunk_id, i - 1 AS pos, regexp_extract(m[i], '\[([^\]]+)\]\(([^)]+)\)', 1) AS label, regexp_extract(m[i], '\[([^\]]+)\]\(([^)]+)\)', 2) AS url FROM (SELECT source_chunk_id, regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)') AS m FROM {LINK_MD}), LATERAL unnest(range(1, len(m) + 1)) AS u(i)"

FIXED_SQL = r"""WITH raw AS (SELECT doc_id, k, substr(text, CAST(k * 1050 + 1 AS BIGINT), 1200) AS r FROM documents, LATERAL unnest(range(0, CAST(greatest(ceil((length(text) - 1200) / 1050.0), 0) AS BIGINT) + 1)) AS u(k) WHERE length(text) > 0),
cut AS (SELECT doc_id, k, regexp_replace(r, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS text, k * 1050 + length(r) - length(regexp_replace(r, '^[\s\x{85}\p{Z}]+', '')) AS start_offset FROM raw)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, text, start_offset, start_offset + length(text) AS end_offset FROM cut WHERE text <> ''"""
# Sentence ends are marked by a private character: control characters stand in some texts. The walk keeps the next sentence i, the first one s of the chunk being packed, and its length n.
SENTENCE_SQL = rf"""
WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', '\1' || chr(57344), 'g'), chr(57344)), lambda x: regexp_replace(x, '^[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
walk(doc_id, p, i, s, n, chunk) AS (
  SELECT doc_id, p, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM parts WHERE len(p) > 0
  UNION ALL
  SELECT doc_id, p, i + 1, s2, n2 + length(p[i]) + CASE WHEN n2 > 0 THEN 1 ELSE 0 END, CASE WHEN flush THEN array_to_string(p[s:i - 1], ' ') END
  FROM (SELECT *, CASE WHEN NOT flush THEN n WHEN s2 = i THEN 0 ELSE length(array_to_string(p[s2:i - 1], ' ')) END AS n2
    FROM (SELECT *, CASE WHEN NOT flush THEN s ELSE coalesce(list_min(list_filter(range(s, i), lambda j: length(array_to_string(p[j:i - 1], ' ')) <= {OVERLAP})), i) END AS s2
      FROM (SELECT *, i > s AND n + length(p[i]) + 1 > {SIZE} AS flush FROM walk WHERE i <= len(p))))),
cut AS (SELECT doc_id, i, 0 AS last, chunk FROM walk WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, i, 1, array_to_string(p[s:len(p)], ' ') FROM walk WHERE i = len(p) + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS chunk_index, chunk AS text FROM cut
"""

SQL = {
    "url_normalize": f"SELECT DISTINCT u AS raw_url, norm AS url, s0 || '://' || n AS origin FROM {url_sql('(SELECT raw_url AS u FROM links WHERE raw_url IS NOT NULL)')}",
    "url_origin_gate": rf"""SELECT link_id, l.source_document_id IS NULL OR coalesce(lower(regexp_extract(d.source_url, '{PARTS}', 1)) || '://' || lower(regexp_extract(d.source_url, '{PARTS}', 2)) = lower(regexp_extract(l.u, '{PARTS}', 1)) || '://' || lower(regexp_extract(l.u, '{PARTS}', 2)), false) AS allowed
FROM (SELECT link_id, min(source_document_id) AS source_document_id, min(normalized_url) AS u FROM links WHERE link_id IS NOT NULL GROUP BY 1) l LEFT JOIN {DOCS} d ON d.document_id = l.source_document_id""",
    "seed_scheme": "SELECT pipeline_id, 'web' AS source_type, CASE WHEN regexp_matches(dataset.url, '^https?://') THEN dataset.url ELSE 'https://' || dataset.url END AS seed FROM runs WHERE dataset.source_type = 'web' UNION ALL SELECT pipeline_id, 'local', unnest(dataset.paths) FROM runs WHERE dataset.source_type = 'local'",
    "dedup_targets": f"""SELECT DISTINCT o.pipeline_id, l.normalized_url FROM links l JOIN (SELECT document_id, min(pipeline_id) AS pipeline_id FROM {CURRENT} WHERE document_id IS NOT NULL GROUP BY 1) o ON o.document_id = l.source_document_id
WHERE l.normalized_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {CURRENT} t WHERE t.pipeline_id = o.pipeline_id AND t.normalized_url = l.normalized_url AND t.status NOT IN ('failed_transient', 'failed'))""",
    "mime_classify": f"""SELECT content_type, {MEDIA} AS media_type, coalesce({MEDIA} IN ('text/html', 'application/xhtml+xml', 'text/plain', 'text/xml', 'application/xml'), false) AS supported,
CASE WHEN contains(coalesce({MEDIA}, ''), 'xml') THEN 'xml' WHEN contains(coalesce({MEDIA}, ''), 'html') THEN 'html' ELSE 'txt' END AS extension,
CASE WHEN {MEDIA} IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN {MEDIA} IN ('text/xml', 'application/xml') THEN 'xml' WHEN {MEDIA} = 'text/plain' THEN 'plain' END AS parser, count(*) AS n FROM fetches GROUP BY 1, 2, 3, 4, 5""",
    "http_failure_class": "SELECT http_status, CASE WHEN http_status = 429 OR http_status BETWEEN 500 AND 599 THEN 'transient' WHEN http_status >= 400 THEN 'permanent' END AS failure, count(*) AS n FROM documents GROUP BY 1, 2",
    "content_hash": f"SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, {TOKENS} AS token_estimate FROM documents",
    "log_slug": rf"""SELECT target_id, array_to_string(parts[greatest(1, len(parts) - 11):], '/') AS log_dir FROM (
SELECT t.target_id, CASE WHEN coalesce(p.log_dir, '') = '' THEN [] ELSE string_split(p.log_dir, '/') END || [substr(CASE WHEN {SLUG.replace('@', 'raw')} = '' THEN 'root' ELSE {SLUG.replace('@', 'raw')} END, 1, 60) || '-' || substr(sha256(t.normalized_url), 1, 8)] AS parts
FROM (SELECT *, lower(regexp_extract(original_url, '{PARTS}', 2)) || regexp_replace(regexp_extract(original_url, '{PARTS}', 3), ';[^/]*$', '') AS raw FROM {CURRENT}) t
LEFT JOIN {DOCS} d ON d.document_id = t.parent_document_id LEFT JOIN {CURRENT} p ON p.target_id = d.target_id)""",
    "run_folders": rf"SELECT pipeline_id, CASE WHEN s = '' THEN pipeline_id ELSE pipeline_id || '__' || s END AS folder FROM (SELECT pipeline_id, substr({SLUG.replace('@', 'coalesce(name, chr(32))')}, 1, 40) AS s FROM runs)",
    "keyword_filter": rf"""SELECT doc_id, inc AND NOT exc AS relevant, inc AS included, exc AS excluded FROM (SELECT doc_id,
CASE WHEN coalesce(title, '') <> '' THEN regexp_matches(title, '{KW(INCLUDE)}', 'i') ELSE regexp_matches(coalesce(text, ''), '{KW(INCLUDE)}', 'i') END AS inc,
regexp_matches(concat_ws(chr(10), title, text), '{KW(EXCLUDE)}', 'i') AS exc FROM (SELECT doc_id, text, json_extract_string(parser_metadata, '$.title') AS title FROM documents))""",
    "chunk_sliding_window": r"""SELECT doc_id, k AS chunk_index, array_to_string(w[k * 100 + 1:k * 100 + 200], ' ') AS text FROM (SELECT doc_id, regexp_extract_all(text, '[^\s\x{85}\x{a0}\p{Z}]+') AS w FROM documents WHERE text IS NOT NULL),
LATERAL unnest(range(0, CAST(greatest(ceil((len(w) - 200) / 100.0), 0) AS BIGINT) + 1)) AS u(k) WHERE len(w) > 0""",
    "chunk_fixed": FIXED_SQL,
    "chunk_sentence": SENTENCE_SQL,
    **{f"chunk_{n}_checked": r"SELECT doc_id, true AS placed, true AS fits, true AS covered FROM documents WHERE doc_id IS NOT NULL AND regexp_replace(text, '[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]+', '', 'g') <> ''" for n in ("recursive", "markdown")},
    "chunk_stats_report": f"SELECT chunk_type, count(*) AS n, min(t) AS least, round(avg(t), 1) AS mean, max(t) AS most, count(*) FILTER (t < 100) AS under_100 FROM (SELECT chunk_type, {TOKENS} AS t FROM {CHUNKS}) GROUP BY 1",
    "chunk_largest": f"SELECT chunk_id, {TOKENS} AS tokens FROM {CHUNKS} ORDER BY tokens DESC, chunk_id LIMIT 10",
    "metadata_merge": f"""WITH j AS (SELECT c.chunk_id, coalesce(d.parser_metadata, '{{}}') AS a, coalesce(c.chunk_metadata, '{{}}') AS b FROM {CHUNKS} c JOIN {DOCS} d USING (document_id)),
e AS (SELECT chunk_id, k, json_extract_string(a, '$."' || k || '"') AS v FROM j, LATERAL unnest(json_keys(a)) AS u(k) WHERE NOT list_contains(json_keys(b), k) UNION ALL SELECT chunk_id, k, json_extract_string(b, '$."' || k || '"') FROM j, LATERAL unnest(json_keys(b)) AS u(k))
SELECT j.chunk_id, coalesce(m, '') AS metadata FROM j LEFT JOIN (SELECT chunk_id, string_agg(x, ';' ORDER BY x) AS m FROM (SELECT chunk_id, k || '=' || coalesce(v, 'null') AS x FROM e) GROUP BY 1) s USING (chunk_id)""",
    "link_extract": EXTRACT,
    "link_dedup": f"SELECT source_chunk_id, min(pos) AS pos, norm AS normalized_url FROM {url_sql(f'(SELECT source_chunk_id, pos, url AS u FROM ({EXTRACT}))')} GROUP BY 1, 3",
    "crawl_frontier_bfs": f"""WITH RECURSIVE e AS (SELECT DISTINCT d.normalized_url AS source, l.normalized_url AS target FROM links l JOIN {DOCS} d ON d.document_id = l.source_document_id WHERE l.normalized_url IS NOT NULL AND d.normalized_url IS NOT NULL AND d.normalized_url <> l.normalized_url),
walk(url, depth) AS (SELECT DISTINCT normalized_url, 0 FROM targets WHERE parent_document_id IS NULL AND parent_chunk_id IS NULL AND depth = 0 AND document_id IS NOT NULL AND normalized_url IS NOT NULL UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.url WHERE w.depth < 30)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1""",
    "pending_links": "SELECT source_document_id, count(*) AS n_pending FROM (SELECT link_id, arg_min(source_document_id, created_at) AS source_document_id, arg_min(status, created_at) AS status FROM links WHERE link_id IS NOT NULL GROUP BY 1) WHERE status IN ('pending', 'discovered') GROUP BY 1",
    "status_counts": STATUS_SQL,
    "embedding_rollup": f"SELECT pipeline_id, CAST(coalesce(sum(n_chunks) FILTER (status = 'embedded'), 0) AS BIGINT) AS embedded, CAST(coalesce(sum(n_chunks) FILTER (status IS DISTINCT FROM 'embedded'), 0) AS BIGINT) AS pending FROM ({STATUS_SQL}) GROUP BY 1",
    "targets_page": f"SELECT target_id, original_url, status, document_id, chunk_count FROM (SELECT t.*, (SELECT count(*) FROM {CHUNKS} c WHERE c.document_id = t.document_id) AS chunk_count FROM {CURRENT} t) ORDER BY created_at NULLS LAST, target_id LIMIT 50 OFFSET 50",
    "target_chunks": f"SELECT target_id, coalesce(n, 0) AS chunk_count, round((epoch_us(processed_at) - epoch_us(t.created_at)) / 1e6, 3) AS seconds FROM {CURRENT} t LEFT JOIN (SELECT document_id, count(*) AS n FROM {CHUNKS} GROUP BY 1) c USING (document_id)",
    "active_targets": f"SELECT pipeline_id, count(*) AS n_targets, count(*) FILTER (status NOT IN {FINISHED}) AS n_active FROM {CURRENT} GROUP BY 1",
    "finalize_targets": f"SELECT target_id, CASE WHEN EXISTS (SELECT 1 FROM {CHUNKS} c WHERE c.document_id = t.document_id AND c.status IS DISTINCT FROM 'embedded') THEN status ELSE 'processed' END AS new_status FROM {CURRENT} t WHERE status IN ('embedding', 'embedded')",
    "documents_embedded": f"SELECT DISTINCT document_id, NOT EXISTS (SELECT 1 FROM {CHUNKS} c WHERE c.document_id = d.document_id AND c.status IS DISTINCT FROM 'embedded') AS all_embedded FROM documents d WHERE document_id IS NOT NULL",
    "run_completion": f"SELECT r.pipeline_id, coalesce(a.n, 0) AS n_active, coalesce(a.n, 0) = 0 AND coalesce(embeddings_completed, 0) >= coalesce(embeddings_scheduled, 0) AS complete FROM runs r LEFT JOIN (SELECT pipeline_id, count(*) FILTER (status NOT IN {FINISHED}) AS n FROM {CURRENT} GROUP BY 1) a USING (pipeline_id)",
    "outbox_dedup": "SELECT user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d %H') AS dedup_key, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS deliveries FROM events GROUP BY 1",
    "outbox_pending": "SELECT event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 100",
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1",
    "upsert_chunks": f"SELECT document_id, chunk_index, coalesce(n.text_hash, o.text_hash) AS text_hash, coalesce(o.status, n.status) AS status FROM (SELECT document_id, chunk_index, sha256(text) AS text_hash, status FROM {CHUNKS} WHERE document_id IS NOT NULL) o FULL JOIN (SELECT document_id, CAST(chunk_index AS INT) AS chunk_index, sha256(text) AS text_hash, 'chunked' AS status FROM ({FIXED_SQL.replace('doc_id', 'document_id').replace('FROM documents,', 'FROM (SELECT document_id, min(text) AS text FROM documents WHERE document_id IS NOT NULL GROUP BY 1),')})) n USING (document_id, chunk_index)",
    "upsert_fetches": "SELECT target_id, content_hash, http_status, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM fetches WHERE target_id IS NOT NULL) WHERE rn = 1",
    "embed_batches": f"SELECT 'embed:' || document_id || ':' || CAST(CAST(floor(chunk_index / 32) * 32 AS BIGINT) AS VARCHAR) AS event_key, count(*) AS n_chunks FROM {CHUNKS} WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1",
    "schedule_links": f"""SELECT 'frontier:' || l.link_id AS dedup_key, o.pipeline_id, l.normalized_url, 'scheduled' AS status FROM (SELECT link_id, arg_min(source_document_id, created_at) AS source_document_id, arg_min(normalized_url, created_at) AS normalized_url, arg_min(status, created_at) AS status FROM links WHERE link_id IS NOT NULL GROUP BY 1) l
JOIN (SELECT document_id, min(pipeline_id) AS pipeline_id FROM {CURRENT} WHERE document_id IS NOT NULL GROUP BY 1) o ON o.document_id = l.source_document_id JOIN runs r ON r.pipeline_id = o.pipeline_id
WHERE l.status = 'pending' AND coalesce(json_extract_string(r.actor_configs, '$.schedule_discovered_links.settings.follow_child_links'), 'true') = 'true'""",
    "run_counters": f"SELECT pipeline_id, CAST(sum(n_chunks) AS BIGINT) AS scheduled, CAST(coalesce(sum(n_chunks) FILTER (status = 'embedded'), 0) AS BIGINT) AS completed FROM ({STATUS_SQL}) GROUP BY 1",
    "mark_embedded": f"SELECT chunk_id, CASE WHEN document_id IN (SELECT document_id FROM {CURRENT} WHERE status = 'embedding' AND document_id IS NOT NULL) THEN 'embedded' ELSE status END AS status FROM {CHUNKS}",
    "filter_stage": rf"""SELECT target_id, CASE WHEN ok THEN 'fetched' ELSE 'skipped' END AS status, CASE WHEN NOT ok THEN 'not_relevant' END AS skip_reason FROM (SELECT target_id, regexp_matches(content, '{KW(INCLUDE)}', 'i') AND NOT regexp_matches(content, '{KW(EXCLUDE)}', 'i') AS ok
FROM (SELECT target_id, arg_max(content, fetched_at) AS content FROM fetches WHERE target_id IS NOT NULL AND content IS NOT NULL GROUP BY 1))""",
    "vector_upsert": "SELECT vec_id, label, CAST(i - 1 AS INT) AS component, round(CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END * CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, LATERAL unnest(range(1, len(embedding) + 1)) AS u(i)",
    "xml_titles": r"SELECT act_id, regexp_replace(coalesce(title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title FROM (SELECT act_id, arg_max(title, received_at) AS title FROM legal_acts WHERE act_id IS NOT NULL GROUP BY 1)",
}


