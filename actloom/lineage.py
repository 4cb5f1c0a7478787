"""Cutting lineage in the folder all executors share.

Iterative operators write what a round leaves as a table in the folder that
the session names in ``spark.checkpoint.dir``; the table survives the loss of
any executor, and a later round reads it without the plans before it. Only a
local session, whose one machine holds all executors, may go without the
setting; on a cluster its absence is an error, as executors that write to
their own disks would lose rows silently.

A result may be read as long as its program runs, so the tables it reads are
kept until :func:`clean`, which also runs when the program ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # application id -> the folder of a local session without the setting
_open: list["Workspace"] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; ValueError on a cluster that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="actloom-")
    return _own[context.applicationId]


class Workspace:
    """Tables of one run of an operator, under one folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """The same rows, read back from a table of the workspace."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def _place(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        """Whether a table, or a part of one, was written; a part without rows is not."""
        files, path = self._place(name)
        return files.exists(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        files, path = self._place(name)
        files.delete(path, True)


def clean() -> None:
    """Delete all workspaces of this program; results that read them must have been written or collected before."""
    while _open:
        work = _open.pop()
        try:
            work.drop("")
        except Exception:  # noqa: BLE001 - a session that has ended can delete nothing
            continue


atexit.register(clean)
