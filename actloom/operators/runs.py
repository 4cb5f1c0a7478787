"""Runs: settings blocks, immutable snapshots, seeds and the guards of a launch."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions.urls import ensure_scheme
from actloom.operators.registry import Field, InvalidSetting, checked
from actloom.operators.vectors import metric_name

BLOCKS: dict[str, tuple[Field, ...]] = {
    "validate_source": (Field("follow_cross_domain", "checkbox", False), Field("max_depth", "number", None, least=0)),
    "fetch_source": (Field("allowed_content_types", "text", ""),),
    "filter_documents": (Field("enabled", "checkbox", False), Field("include_keywords", "text", ""), Field("exclude_keywords", "text", "")),
    "parse_source": (Field("parser", "select", "auto", choices=("auto", "plain", "html", "xml")),),
    "chunk_document": (Field("chunker", "text", "text_markdown"), Field("chunk_size", "number", 1200, least=1), Field("chunk_overlap", "number", 150, least=0)),
    "schedule_embeddings": (Field("batch_size", "number", 32),),
    "schedule_discovered_links": (Field("follow_child_links", "checkbox", True),),
}


def snapshot(config: dict | None) -> str:
    """The settings of a run as canonical JSON: a malformed block has all its defaults, an unknown metric is cosine."""
    config = config or {}
    out = {}
    for name, fields in BLOCKS.items():
        try:
            block = config.get(name) or {}
            out[name] = checked(fields, {snake(k): v for k, v in block.items()})
        except (InvalidSetting, AttributeError):
            out[name] = checked(fields, {})
    out["similarity"] = metric_name(config.get("similarity"))
    return json.dumps(out, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def collection_name(base: str, dataset: str) -> str:
    return f"{base}_{dataset}_qwen_embed_8b"


def launched(run: dict, now: datetime | None = None) -> dict:
    """A run as it is after a launch; ValueError where it is running. A finish of before is forgotten."""
    if run.get("status") == "running":
        raise ValueError("the run is already running")
    return run | {"status": "running", "started_at": now or datetime.now(timezone.utc), "finished_at": None}


def with_status(run: dict, status: str, now: datetime | None = None) -> dict:
    """A run under another status; an ending one stamps the finish."""
    done = status in ("completed", "failed", "cancelled")
    return run | {"status": status} | ({"finished_at": now or datetime.now(timezone.utc)} if done else {})


def web_seeds(runs: DataFrame) -> DataFrame:
    """(pipeline_id, source_type, seed) of each run: its one URL with a scheme, or each of its paths.

    A run of another source type, or a web run without a URL, is an error of the query that reads its seeds.
    """
    kind, url = F.col("dataset.source_type"), F.col("dataset.url")
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} in run "), F.coalesce("pipeline_id", F.lit("NULL")))).cast("array<string>")
    web = F.when(F.coalesce(url, F.lit("")) == "", wrong("no seed URL")).otherwise(F.array(ensure_scheme(url)))
    seeds = F.when(kind == "web", web).when(kind == "local", F.col("dataset.paths")).otherwise(wrong("unknown source type"))
    return runs.select("pipeline_id", kind.alias("source_type"), F.explode(seeds).alias("seed"))


def setting(path: str, default: str) -> Column:
    """A setting of the snapshot column `actor_configs`, else the default."""
    return F.coalesce(F.get_json_object("actor_configs", f"$.{path}"), F.lit(default))


# Keys that a chunk's own metadata may not set.
RESERVED = ("chunk_id", "document_id", "chunk_index", "chunk_type", "pipeline_run_id")


def merge_metadata(parser: dict | None, chunk: dict | None, most_bytes: int = 262144) -> dict:
    """Parser metadata under chunk metadata; ValueError for a reserved key or more than the limit of compact UTF-8 JSON."""
    out = {**(parser or {}), **(chunk or {})}
    if bad := sorted(set(out) & set(RESERVED)):
        raise ValueError(f"reserved keys: {', '.join(bad)}")
    if len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) > most_bytes:
        raise ValueError("metadata is too large")
    return out
