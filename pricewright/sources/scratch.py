"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; only a local session without the setting gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back, which cuts the lineage and fixes nondeterministic columns."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of_application(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pricewright-tables-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, below one folder per application."""
    return f"{_of_application(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this application has written here; results are lazy, so call it once they are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_of_application(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrivals(df: DataFrame, name: str, batches: int, *order: Column, files: int | None = None) -> str:
    """Writes rows as a folder of files, a file for each of ``batches`` arrivals; rows are dealt by a hash of ``order``.

    A stream that takes a file at a time thus sees them in an order that has nothing to do with time.  With ``files``,
    an arrival is so many files, written side by side from one pass over ``df``; the stream takes as many at a time.
    """
    path = folder(df.sparkSession, name)
    if files is not None:
        df.repartition(batches * files, *order).write.parquet(path)
        return path
    arrival = F.pmod(F.xxhash64(*order), F.lit(batches))
    for n in range(batches):
        df.where(arrival == n).coalesce(1).write.mode("append").parquet(path)
    return path
