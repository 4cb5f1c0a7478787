"""Links in markdown text, and the crawl frontier."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.functions.urls import normalize_url, origin
from actloom.lineage import Workspace
from actloom.operators.keyed import pick

MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def extract_links(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, label, url) of each markdown link of a text, in order; images count too."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(MARKDOWN_LINK), 1).alias("label"), F.regexp_extract_all(F.col(text), F.lit(MARKDOWN_LINK), 2).alias("url"))
    return texts.select(F.col(key), F.posexplode(found).alias("pos", "x")).select(key, F.col("pos").cast("long").alias("pos"), "x.label", "x.url")


def chunk_links(links: DataFrame, key: str) -> DataFrame:
    """The first link of each chunk to each normalised URL."""
    return pick(links.withColumn("normalized_url", normalize_url(F.col("url"))), [key, "normalized_url"], [F.col("pos")])


def same_origin(parent_id, parent_url, child_url):
    """Whether a child may be crawled: always without a parent; else from an equal origin, so not from a parent that is missing."""
    return parent_id.isNull() | F.coalesce(origin(parent_url) == origin(child_url), F.lit(False))


def frontier(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(url, depth): all URLs reached from the seeds over edges (source, target), each at its least depth.

    Rounds go on until none finds a new URL; only a caller's `most_depth` ends them before. A round joins the newly reached URLs with the edges and drops those known;
    only the new ones are written. Edges are reduced first, so a target of a
    third of all links is one row per source. NULL ends are left out.
    """
    work = Workspace(edges.sparkSession, "frontier")
    links = work.write(edges.select("source", "target").where("source is not null and target is not null and source <> target").distinct(), "links")
    new = work.write(seeds.select(F.col("url")).where("url is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "reached0")
    reached = new
    for k in count(1) if most_depth is None else range(1, most_depth + 1):
        step = links.join(new.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        new = work.write(step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(k).cast("long")), f"reached{k}")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
    return reached
