"""A catalogue of small control tables (datasets, providers, runs, searches) of versions.

It is the control plane: its tables are of the size of a user's work. A writer
that another one came before reads again and repeats its change, so none is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.operators.tables import Conflict, VersionedTable

SCHEMA = "id string, name string, body string, created_at timestamp, updated_at timestamp"
TABLES = ("datasets", "providers", "runs", "searches", "inputs")
#: Parameter: how often a change is repeated after others came before it.
REPEATS = 10


class NotFound(KeyError):
    pass


class Store:
    """Create, read, update, delete and list, newest first; ids that are malformed or unknown raise NotFound."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> VersionedTable:
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        return VersionedTable(self.spark, f"{self.folder}/{name}", SCHEMA)

    def table(self, name: str) -> DataFrame:
        return self._versions(name).read()

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        table = self._versions(name)
        for left in range(REPEATS, -1, -1):
            number = table.version()
            try:
                table.write(change(table.read(number)).coalesce(1), number)
                return
            except Conflict:
                if not left:
                    raise

    def _one(self, name: str, body: dict, key: str, created: datetime) -> DataFrame:
        text = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return self.spark.createDataFrame([(key, str(body.get("name", "")), text, created, datetime.now(timezone.utc))], SCHEMA)

    def create(self, name: str, body: dict) -> str:
        key = str(uuid.uuid4())
        new = self._one(name, body, key, datetime.now(timezone.utc))
        self._change(name, lambda rows: rows.unionByName(new))
        return key

    def get(self, name: str, key: str) -> dict:
        try:
            uuid.UUID(key)
        except (ValueError, AttributeError, TypeError):
            raise NotFound(key) from None
        row = self.table(name).where(F.col("id") == key).first()
        if row is None:
            raise NotFound(key)
        return json.loads(row["body"])

    def update(self, name: str, key: str, changes: dict) -> dict:
        body = self.get(name, key) | changes
        created = self.table(name).where(F.col("id") == key).first()["created_at"]
        new = self._one(name, body, key, created)
        self._change(name, lambda rows: rows.where(F.col("id") != key).unionByName(new))
        return body

    def delete(self, name: str, key: str) -> None:
        """Deleting a run deletes its searches too; vectors are kept."""
        self.get(name, key)
        self._change(name, lambda rows: rows.where(F.col("id") != key))
        if name == "runs":
            self._change("searches", lambda rows: rows.where(F.coalesce(F.get_json_object("body", "$.pipeline_id") != key, F.lit(True))))

    def listed(self, name: str, limit: int = 100) -> DataFrame:
        return self.table(name).orderBy(F.desc("created_at"), "id").limit(limit)
