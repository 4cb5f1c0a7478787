"""Tables of versions on any file system, and the collections of vectors kept in them.

A write makes a new version beside the old ones and then a pointer of the next
number, which only one writer can make: a reader sees a whole table, a write
that fails leaves the one before, and of two writers at once the later one
gets a Conflict. All paths go through the session's file system, so the
folder may lie wherever all executors reach.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.operators.keyed import upsert
from actloom.operators.vectors import METRICS, dense_top_k, metric_name


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Files:
    """A folder on a file system of the session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def create(self, name: str, text: str) -> None:
        """A new small file; Conflict where there is one."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # noqa: BLE001 - the file system says in its own way that a file exists
            if self._fs.exists(self._path(name)):
                raise Conflict(name) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, name: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(name)), "UTF-8")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class VersionedTable:
    """One table of versions."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.files = Files(spark, folder)

    def version(self) -> int:
        """The number of the current version; 0 for none."""
        return max((int(x.partition(".")[0]) for x in self.files.names("pointers") if not x.startswith((".", "_"))), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        number = self.version() if version is None else version
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self.files.text(f'pointers/{number:09d}.txt')}")

    def write(self, rows: DataFrame, based_on: int) -> int:
        """The next version after `based_on`, which must still be the current one."""
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        try:
            if self.version() != based_on:
                raise Conflict(f"version {based_on} is no longer the last one")
            self.files.create(f"pointers/{based_on + 1:09d}.txt", name)
        except Conflict:
            self.files.delete(name)
            raise
        return based_on + 1


class Collections:
    """Named collections of vectors with their payload."""

    SCHEMA = "chunk_id string, vector array<double>, document_id string, chunk_index int, chunk_type string, pipeline_run_id string, metadata string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, folder)

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{name}", self.SCHEMA)

    def create(self, name: str, dim: int, metric: str = "cosine") -> None:
        """A new collection; nothing where there is one of the name, even with another dimension or metric."""
        if "settings.json" not in self.files.names(name):
            self.files.create(f"{name}/settings.json", json.dumps({"dim": dim, "metric": metric_name(metric)}))

    def settings(self, name: str) -> dict:
        return json.loads(self.files.text(f"{name}/settings.json"))

    def upsert(self, name: str, vectors: DataFrame) -> None:
        """Vectors over those of the same chunk; ones without an id get a random one."""
        table = self._table(name)
        number = table.version()
        own = vectors.withColumn("chunk_id", F.coalesce("chunk_id", F.uuid())).select(*table.read(0).columns)
        table.write(upsert(table.read(number), own, ["chunk_id"], order=[F.col("document_id")]) if number else own, number)

    def read(self, name: str) -> DataFrame:
        return self._table(name).read()

    def search(self, name: str, queries: DataFrame, k: int, run: str | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k nearest stored vectors of each query, of one run where asked for; ties by chunk.

        Chunks are numbered by their order for the search, in one pass over their ids.
        """
        own = self.read(name)
        if run is not None:
            own = own.where(F.col("pipeline_run_id") == run)
        metric = self.settings(name)["metric"]
        return dense_top_k(queries, own.select(F.col("chunk_id").alias("id"), "vector"), k, metric if metric in METRICS else "cosine").withColumnRenamed("id", "chunk_id")

    def drop(self, name: str) -> None:
        self.files.delete(name)
