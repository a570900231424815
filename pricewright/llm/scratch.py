"""Intermediate tables in the folder that the driver and all executors share.

Writing a table cuts the lineage: if an executor is lost, a later job rereads files instead
of recomputing what came before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ARROW_BATCH_BYTES = 16 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would not be seen by
    the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pricewright-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, below one folder per application."""
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this application has staged.

    Results are lazy and read what was staged for them, so call this once they are written; default stores
    of ``shard_documents`` and archives of ``archive_pages`` go with it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_arrow_batches(spark: SparkSession, most: int = _ARROW_BATCH_BYTES) -> None:
    """Limit the bytes of a batch sent to Python workers, so that long texts fit in memory.

    Results are lazy, so the setting has to outlast the call; a smaller one of the session is kept.
    """
    given = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if given and given.isdigit() and 0 < int(given) < most:
        return
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
