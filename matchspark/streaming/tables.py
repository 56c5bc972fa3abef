"""Tables that a stream keeps: each batch writes under its own number and reads only what smaller numbers left, so a
batch that runs again after a failure gives what it gave before and replaces its own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.session import shared_folder


class Kept:
    """A table in the shared folder, one part for each batch. Its state is in the files alone."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, shared_folder(spark, name)

    def before(self, number: int | None = None) -> DataFrame | None:
        """What batches with smaller numbers wrote (all of them without a number), with `batch`; None if that is nothing."""
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows if number is None else rows.where(F.col("batch") < number)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def latest(self, number: int | None = None) -> DataFrame | None:
        """The part with the largest number (below `number`, if given), for tables that each batch writes anew."""
        rows = self.before(number)
        top = rows.agg(F.max("batch")).first()[0] if rows is not None else None
        return None if top is None else rows.where(F.col("batch") == top).drop("batch")


def run(stream: DataFrame, name: str, step: Callable[[DataFrame, Kept, int], DataFrame | None], kept: Kept | None = None) -> Kept:
    """Drain the stream. step gives the rows of a batch's part, from the batch and what is kept so far; None: no part."""
    kept = kept or Kept(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        part = step(batch, kept, number)
        if part is not None:
            kept.write(part, number)

    query = stream.writeStream.option("checkpointLocation", f"{kept.path}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return kept
