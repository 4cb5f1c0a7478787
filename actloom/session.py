"""A session with the settings this library is tested under."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; its checkpoint folder is one of this machine too."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("actloom")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="actloom-"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
