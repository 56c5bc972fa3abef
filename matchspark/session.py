"""Session help: a builder for local work, and the package on Python workers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (a checkout at the same path on each host)."""
    here = str(Path(__file__).resolve().parents[1])
    had = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in had.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, had) if x)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, which is the cluster's setting; only in local mode
    (tests) one is made where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what led to it does not run again."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: DataFrame, each: int) -> int:
    """Into how many parts a shuffle deals these rows so that a part has about `each` of them at most: the session's
    number or more, so that what one task holds does not grow with the rows. It counts them (a table by its footers)."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / each))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by keys in so many parts; without a number as Spark likes."""
    return df.repartition(parts, *keys) if parts else df
