"""Tamper evidence by digests per bucket of keys: two states of a table are compared top-down.

A snapshot deals rows to buckets by a hash of the key and keeps, for each bucket, the number of rows and two
digests that do not depend on their order.  Groups of buckets have digests of their own.  A comparison starts
there, goes on in the groups that differ, and reads rows only of the buckets that differ, as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators.guards import mutated_rows

#: Buckets of a snapshot (documented bound of what a comparison lists), and buckets of a group.
BUCKETS, GROUP = 64, 8


def write_snapshot(df: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes rows by bucket below ``path``/rows and the digests of the buckets to ``path``/digests.

    Column order does not matter; rows with one key and equal rows all count.
    """
    columns = sorted(df.columns)
    row = F.struct(*(F.col(c) for c in columns))
    rows = df.select(*columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    # The two hashes are independent; the first is summed as decimal, so equal rows don't cancel out.
    first, second = F.xxhash64(row).cast("decimal(20,0)"), F.xxhash64(F.lit("second"), row).cast("decimal(20,0)")
    digests = kept.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("first"), F.sum(second).alias("second"))
    digests.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def differing_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets whose digests differ, group by group; at most as many as a snapshot has."""
    sides = [spark.read.parquet(f"{p}/digests").withColumn("_group", F.floor(F.col("_bucket") / GROUP)) for p in (before, after)]
    tops = [s.groupBy("_group").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second")) for s in sides]
    groups = _unequal(*tops, "_group").select(F.col("_group").alias("_differs"))
    below = [s.join(F.broadcast(groups), F.col("_group") == F.col("_differs"), "left_semi") for s in sides]
    return sorted(r["_bucket"] for r in _unequal(*below, "_bucket").collect())


def _unequal(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    digest = F.struct("n", "first", "second")
    joined = one.select(key, digest.alias("was")).join(other.select(key, digest.alias("is")), key, "full")
    return joined.where(~F.col("was").eqNullSafe(F.col("is"))).select(key)


def audit(spark: SparkSession, before: str, after: str, key: str) -> DataFrame:
    """Keys of an append-only table whose row has gone or changed since the snapshot ``before``; added rows are no fault."""
    buckets = differing_buckets(spark, before, after)
    was, now = (spark.read.parquet(f"{p}/rows").where(F.col("_bucket").isin(*buckets) if buckets else F.lit(False)).drop("_bucket") for p in (before, after))
    return mutated_rows(was, now, key)
