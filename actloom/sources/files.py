"""Local sources: seeds, listings and reading of files under a root."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inside_root(root: str, path: str) -> Path:
    """The resolved path, which must lie in the root; ValueError else."""
    top = Path(root).resolve()
    found = (top / path.lstrip("/")).resolve() if not Path(path).is_absolute() or not str(path).startswith(str(top)) else Path(path).resolve()
    if found != top and top not in found.parents:
        raise ValueError(f"{path} is not under the source root")
    return found


def listing(root: str, path: str = "") -> list[dict]:
    """Folders and .xml files of a folder, folders first, each by name without case."""
    folder = inside_root(root, path)
    entries = [x for x in folder.iterdir() if x.is_dir() or x.suffix.lower() == ".xml"]
    ordered = sorted(entries, key=lambda x: (not x.is_dir(), x.name.lower()))
    return [{"name": x.name, "type": "directory" if x.is_dir() else "file", "path": str(x.relative_to(Path(root).resolve()))} for x in ordered]


def seeds(root: str, paths: list[str]) -> list[str]:
    """A file for itself, a folder for the .xml files under it in order; what is neither is left out."""
    out: list[str] = []
    for p in paths:
        found = inside_root(root, p)
        if found.is_dir():
            out += sorted(str(x) for x in found.rglob("*.xml"))
        elif found.suffix:
            out.append(str(found))
    return out


def read_acts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_url, content, content_type, http_status, extension): XML files under a folder, read in parallel."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder)
    return raw.select(
        F.col("path").alias("source_url"),
        F.col("content").cast("string").alias("content"),
        F.lit("application/xml").alias("content_type"),
        F.lit(0).alias("http_status"),
        F.lit("xml").alias("extension"),
    )
