"""Whole stages of ingestion: validate, fetch, filter, parse, chunk and embed, each a DataFrame in and one out.

A stage gives, for each row, its decision and the reason, so that a stage's
output says what became of every input.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from actloom.functions.text import content_hash, json_within, relevant
from actloom.functions.urls import SUPPORTED_TYPES, extension, failure_class, media_type, normalize_url, type_allowed
from actloom.operators import acts
from actloom.operators.chunkers import CHUNK, check_format, with_known
from actloom.operators.links import same_origin
from actloom.operators.registry import InvalidSetting, chunkers
from actloom.operators.runs import merge_metadata
from actloom.operators.vectors import embed

MOST_JSON_BYTES = 262_144
DEFAULT_CHUNKER = "text_markdown"
#: Names of chunkers in older runs.
LEGACY_CHUNKERS = {"fixed": "text_fixed", "recursive": "text_recursive", "markdown": "text_markdown", "sentence": "text_sentence", "section": "text_section", "sliding_window": "text_sliding_window"}


def source_type(url: Column) -> Column:
    """local for file:// and absolute paths, else web; NULL for NULL."""
    return F.when(url.isNull(), None).when(url.startswith("file://") | url.startswith("/"), "local").otherwise("web")


# --- validate ------------------------------------------------------------------
def validated_local(paths: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Paths (with or without file://) with their URL and the reason they are refused, NULL for none.

    `listing` has `path, readable` of the files there are: a path that is not
    listed is `file_not_found`, one that is no NULL-free true `file_not_readable`.
    """
    clean = F.regexp_replace(F.col(path), "^file://", "")
    files = listing.groupBy("path").agg(F.max(F.coalesce("readable", F.lit(False))).alias("_readable")).select(F.col("path").alias("_file"), "_readable")
    joined = paths.withColumn("_file", clean).join(files, "_file", "left")
    reason = F.when(F.col("_readable").isNull(), "file_not_found").when(~F.col("_readable"), "file_not_readable")
    return joined.select(*[F.col(f"`{c}`") for c in paths.columns], F.concat(F.lit("file://"), "_file").alias("normalized_url"), reason.alias("reason"))


def validated(candidates: DataFrame, active: DataFrame, documents: DataFrame, dedup: bool = True) -> DataFrame:
    """One row per run and normalised URL of the candidates, with the decision: queued, or skipped with its reason.

    `candidates` has `pipeline_id, url, parent_document_id`; `active` the
    `pipeline_id, normalized_url` of targets that may not be queued again;
    `documents` one row per `document_id` with its `source_url`. A URL is
    skipped as already queued before its origin is looked at; of several
    candidates with one URL, one that may be crawled decides.
    """
    own = candidates.select("pipeline_id", normalize_url(F.col("url")).alias("normalized_url"), "parent_document_id").where("normalized_url is not null").distinct()
    pages = documents.select(F.col("document_id").alias("_document"), F.col("source_url").alias("_source"))
    placed = own.withColumn("_document", F.coalesce("parent_document_id", F.concat(F.lit("\0"), "normalized_url"))).join(pages, "_document", "left")
    gate = same_origin(F.col("parent_document_id"), F.col("_source"), F.col("normalized_url"))
    one = placed.groupBy("pipeline_id", "normalized_url").agg(F.max(gate).alias("_allowed"))
    known = active.select(F.col("pipeline_id").alias("_run"), F.col("normalized_url").alias("_url")).distinct().withColumn("_known", F.lit(True))
    same = F.col("pipeline_id").eqNullSafe(F.col("_run")) & (F.col("normalized_url") == F.col("_url"))
    joined = one.join(known, same, "left") if dedup else one.withColumn("_known", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_known"), "url_already_queued").when(~F.col("_allowed"), "cross_origin")
    return joined.select("pipeline_id", "normalized_url", F.when(reason.isNull(), "queued").otherwise("skipped").alias("decision"), reason.alias("reason"))


# --- fetch and filter ------------------------------------------------------------
def fetched(pages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Fetched pages (`target_id, url, http_status, content_type, content`) with their status, reason, extension, kind of source and hash."""
    failed = failure_class(F.col("http_status"))
    usable = F.coalesce(media_type(F.col("content_type")).isin(*SUPPORTED_TYPES), F.lit(False))
    reason = F.when(failed.isNotNull(), F.concat(F.lit("http_"), F.col("http_status").cast("string"))).when(~usable, "unsupported_content_type").when(~type_allowed(F.col("content_type"), allowed or []), "content_type_not_allowed")
    status = F.when(failed.isNotNull(), F.concat(F.lit("failed_"), failed)).when(reason.isNotNull(), "skipped_unsupported").otherwise("fetched")
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns], status.alias("status"), reason.alias("reason"), extension(F.col("content_type")).alias("extension"), source_type(F.col("url")).alias("source_type"), content_hash(F.col("content")).alias("content_hash"))


def artifact_path(run_folder: Column, source_id: Column, kind: Column, ext: Column) -> Column:
    """Where a source's content is kept: `{run}/sources/{id}/{kind}/content.{ext}`; `_no_run` without a run."""
    return F.concat(F.coalesce(run_folder, F.lit("_no_run")), F.lit("/sources/"), source_id, F.lit("/"), kind, F.lit("/content."), ext)


@F.pandas_udf(StringType())
def act_title(content: pd.Series) -> pd.Series:
    """The title of an act's XML; empty for anything else."""
    return pd.Series([acts.title_of(x) if x and "<" in x else "" for x in content], dtype=object)


def filtered(pages: DataFrame, enabled: bool, include: list[str], exclude: list[str], content: str = "content", xml: Column | None = None) -> DataFrame:
    """The rows with `status` and `skip_reason` by the keyword gates over the content as it was fetched.

    The title is that of the XML where `xml` is true (nowhere without it), else empty.
    """
    title = F.lit("") if xml is None else F.when(xml, act_title(F.col(content))).otherwise("")
    named = pages.withColumn("_title", title)
    passed = relevant(F.col("_title"), F.coalesce(F.col(content), F.lit("")), enabled, include, exclude)
    return named.withColumn("status", F.when(passed, "filtered").otherwise("skipped")).withColumn("skip_reason", F.when(~passed, "not_relevant")).drop("_title")


# --- parse -------------------------------------------------------------------------
def parsed_documents(parsed: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Rows of the parser with what a stored document adds: versions, language, and an error where the metadata is too large."""
    own = metadata if metadata is not None else F.lit("{}")
    fits = json_within(own, MOST_JSON_BYTES)
    status = F.when((F.col("status") == "parsed") & ~fits, "failed_permanent").otherwise(F.col("status"))
    done = parsed.withColumn("error", F.when(~fits, "metadata_too_large")).withColumn("status", status)
    return done.withColumn("language", F.lit("unknown")).withColumn("parser_version", F.lit("1")).withColumn("chunker_version", F.lit("3"))


# --- chunk -------------------------------------------------------------------------
def chunker_of(config: str | None) -> tuple[str, dict]:
    """The chunker's name and settings in a run's snapshot (a JSON text); the default chunker without settings where there is none.

    Settings stand in a block of their own or, in older runs, beside the name.
    """
    try:
        block = (json.loads(config) if config else {}).get("chunk_document") or {}
        name = block.get("chunker") or LEGACY_CHUNKERS.get(block.get("strategy"), block.get("strategy")) or DEFAULT_CHUNKER
        settings = block.get("settings") or {k: v for k, v in block.items() if k not in ("chunker", "strategy", "settings")}
        return (name, settings) if isinstance(settings, dict) else (DEFAULT_CHUNKER, {})
    except (ValueError, AttributeError):
        return DEFAULT_CHUNKER, {}


def splitter_of(config: str | None) -> tuple[str, Callable]:
    """The chunker of a run as a function; settings it can't take, or an unknown name, give the default chunker."""
    name, settings = chunker_of(config)
    known = chunkers()
    try:
        return name, known.build(name, settings)
    except (InvalidSetting, ValueError):
        return DEFAULT_CHUNKER, known.build(DEFAULT_CHUNKER)


def chunked(documents: DataFrame, key: str = "document_id", most_bytes: int = MOST_JSON_BYTES) -> DataFrame:
    """The chunks of documents, each by the chunker of its run: (key, chunker, error, chunk_index, text, offsets, type, metadata).

    `documents` has the key and `text, raw, source_url, lang, parser_format,
    parser_metadata, actor_configs`; a NULL language is en. Metadata of the
    parser stand under those of the chunk. A document whose format its chunker
    does not take, or whose metadata set a reserved key or are too large, gives
    one row with the error and no chunk; a text that is NULL or blank gives none.
    """
    kind = dict(documents.dtypes)[key]
    columns = ["text", "raw", "source_url", "lang", "parser_format", "parser_metadata", "actor_configs"]
    accepted: dict[str, tuple[str, ...]] = {"legal_xml": ("xml", "plain", "html", "")}
    names = ["key", "chunker", "error", "chunk_index", "text", "start_offset", "end_offset", "chunk_type", "metadata"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str | None, tuple[str, Callable]] = {}
        for pdf in batches:
            rows: list[tuple] = []
            for k, text, raw, url, lang, form, metadata, config in pdf.itertuples(index=False):
                if text is None or not text.strip():
                    continue
                if config not in made:
                    made[config] = splitter_of(config)
                name, split = made[config]
                try:
                    check_format(name, accepted.get(name, ()), form or "")
                    above = json.loads(metadata) if metadata else {}
                    known = {n: v for n, v in (("sourceUrl", url), ("language", lang or "en")) if v}
                    for i, x in enumerate(split(text, raw)):
                        merged = merge_metadata(above, json.loads(with_known(x[4], known)), most_bytes)
                        rows.append((k, name, None, i, *x[:4], json.dumps(merged, ensure_ascii=False, sort_keys=True, separators=(",", ":"))))
                except ValueError as e:
                    rows = [r for r in rows if r[0] != k or r[2] is not None]
                    rows.append((k, name, str(e), *[None] * 6))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"chunk_index": "Int64", "start_offset": "Int64", "end_offset": "Int64"})

    source = documents.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(c) for c in columns])
    return source.mapInPandas(run, f"key {kind}, chunker string, error string, {CHUNK}").withColumnRenamed("key", key)


def inspection(chunks: DataFrame, preview: int = 300) -> DataFrame:
    """A line for people per chunk: its index, type, tokens and path, and the start of its text with white space collapsed."""
    path = F.coalesce(F.get_json_object("metadata", "$.legalPath"), F.lit(""))
    tokens = F.coalesce(F.get_json_object("metadata", "$.tokenCount"), F.lit("0"))
    snippet = F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, preview)
    line = F.concat(F.lit("["), F.col("chunk_index").cast("string"), F.lit("] type="), "chunk_type", F.lit(" tokens="), tokens, F.lit(" path="), path, F.lit("\n    "), snippet)
    return chunks.withColumn("inspection", line)


# What a body that starts with publication data begins with.
LEAK = r"(?iu)^\s*(?:RT\s+[IVX]|avaldatud|Riigi\s+Teataja)"


def leaks_metadata(text: Column) -> Column:
    """Whether the first line of a body, after its heading block, is publication data."""
    body = F.when(text.contains("\n\n"), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise(text)
    return F.regexp_replace(body, r"(?U)^\s+", "").rlike(LEAK)


def act_report(chunks: DataFrame, least: int = 100) -> DataFrame:
    """One row per chunk type: number, least, mean and most tokens; of bodies those under the minimum, over several chapters, and starting with publication data."""
    body = F.col("chunk_type") == "legal_body"
    tokens = F.get_json_object("metadata", "$.tokenCount").cast("long")
    count = lambda c: F.sum(F.when(body & c, 1).otherwise(0)).cast("long")
    return chunks.groupBy("chunk_type").agg(
        F.count("*").alias("n"), F.min(tokens).alias("least"), F.round(F.avg(tokens), 1).alias("mean"), F.max(tokens).alias("most"), count(tokens < least).alias("below_least"),
        count(F.coalesce(F.get_json_object("metadata", "$.chapterNumber").contains(","), F.lit(False))).alias("multi_chapter"), count(leaks_metadata(F.col("text"))).alias("metadata_leak"),
    )


# --- embed -------------------------------------------------------------------------
def embedded(chunks: DataFrame, dim: int = 64, encode: Callable[[list[str]], list] | None = None) -> DataFrame:
    """The stored vectors of chunks: (chunk_id, vector, document_id, chunk_index, chunk_type, pipeline_run_id, metadata).

    `encode` takes texts and gives as many vectors, normalised here; without
    it the hash embedder is used. Blank texts are embedded as one blank.
    """

    def run(texts: pd.Series) -> pd.Series:
        clean = [t if t and t.strip() else " " for t in texts]
        if encode is None:
            return pd.Series(list(embed(clean, dim)))
        out = []
        for v in encode(clean):
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length for x in v] if length else list(v))
        return pd.Series(out)

    vector = F.pandas_udf(run, "array<double>")(F.col("text"))
    return chunks.select("chunk_id", vector.alias("vector"), "document_id", "chunk_index", "chunk_type", "pipeline_run_id", "metadata")
