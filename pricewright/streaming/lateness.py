"""A stream that keeps late rows: each row goes to the accepted or to the late part of a table, none is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewright.operators.bitemporal import time_cuts
from pricewright.operators.lateness import new_marks, with_late


class LateRows:
    """Folders ``rows`` (split by ``late``) and ``marks`` below ``path``, with a part for each batch.

    Batches count in the order in which they come, rows of a batch in order of ingest.  A batch that runs again
    replaces its own parts.
    """

    def __init__(self, spark: SparkSession, path: str, delay: int, id_col: str = "id", rows_per_range: int = 1_000_000) -> None:
        self.spark, self.path, self.delay, self.id_col, self.rows_per_range = spark, path, delay, id_col, rows_per_range

    def follow(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def take(self, batch: DataFrame, number: int) -> None:
        marks = self.marks(number - 1)
        judged = with_late(batch, marks, self.delay, self.id_col, time_cuts(batch, "ingested_at", self.rows_per_range))
        judged.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/version={number}")
        new_marks(batch, marks).write.mode("overwrite").parquet(f"{self.path}/marks/version={number}")

    def marks(self, version: int) -> DataFrame:
        """feed, mark after a batch; none before the first one."""
        if version < 0:
            return self.spark.createDataFrame([], "feed string, mark timestamp")
        return self.spark.read.schema("feed string, mark timestamp").parquet(f"{self.path}/marks/version={version}")

    def accepted(self) -> DataFrame:
        return self._rows().where(~F.col("late")).drop("late")

    def late(self) -> DataFrame:
        return self._rows().where("late").drop("late")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").withColumn("late", F.col("late").cast("boolean")).drop("version")
