"""Late rows and sessions of feeds with three clocks: the source's, the observer's and the ingest's.

Rows are judged in the order in which they were ingested.  A row is late if its feed had shown a time of
observation more than ``delay`` seconds after it before; what a feed has shown is carried over ranges of ingest time as one
row per feed and range, so a feed with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.operators.bitemporal import range_of

CLOCKS = ("source_updated_at", "observed_at", "ingested_at")


def with_late(rows: DataFrame, marks: DataFrame, delay: int, id_col: str = "id", cuts: Sequence[int] = ()) -> DataFrame:
    """Adds ``late`` to rows (feed, observed_at, ingested_at).

    ``marks`` (feed, mark): the latest observation before these rows.  Rows of one ingest time are taken in order
    of ``id_col``, those without one first; a row without a time of observation is never late and shows nothing.
    """
    ranged = rows.withColumn("_range", range_of(F.col("ingested_at"), cuts))
    before = Window.partitionBy("feed", "_range").orderBy("ingested_at", id_col).rowsBetween(Window.unboundedPreceding, -1)
    shown = ranged.withColumn("_shown", F.max("observed_at").over(before))
    earlier = Window.partitionBy("_feed").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    latest = ranged.groupBy(F.col("feed").alias("_feed"), F.col("_range").alias("_of")).agg(F.max("observed_at").alias("_most"))
    latest = latest.join(marks.select(F.col("feed").alias("_marked"), "mark"), F.col("_feed").eqNullSafe(F.col("_marked")), "left")
    carried = latest.select("_feed", "_of", F.greatest("mark", F.max("_most").over(earlier)).alias("_carried"))
    joined = shown.join(carried, F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("_range") == F.col("_of")), "left")
    bound = F.greatest("_shown", "_carried") - F.make_dt_interval(secs=F.lit(delay))
    return joined.select(*rows.columns, F.coalesce(F.col("observed_at") < bound, F.lit(False)).alias("late"))


def new_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The latest observation of each feed, ``rows`` included."""
    shown = rows.select("feed", F.col("observed_at").alias("mark")).unionByName(marks.select("feed", "mark"))
    return shown.groupBy("feed").agg(F.max("mark").alias("mark"))


def clock_report(rows: DataFrame) -> DataFrame:
    """Per feed: rows, late ones, rows whose clocks run backwards, and the greatest lags in seconds.

    Clocks are in order if source <= observation <= ingest; a missing time is no fault.
    """
    source, observed, ingested = (F.unix_micros(c) for c in CLOCKS)
    fault = F.coalesce(source > observed, F.lit(False)) | F.coalesce(observed > ingested, F.lit(False)) | F.coalesce(source > ingested, F.lit(False))
    return rows.groupBy("feed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.count_if(fault).alias("n_clock_faults"),
        (F.max(observed - source) / 1_000_000).alias("source_lag"), (F.max(ingested - observed) / 1_000_000).alias("ingest_lag"),
    )


def sessions(rows: DataFrame, gap: int, key: str = "feed", at: str = "observed_at") -> DataFrame:
    """Sessions of each key: start, end, n; a pause of more than ``gap`` seconds ends one.

    Times in one bucket of ``gap`` seconds belong to one session, so rows are first added up per bucket, which
    leaves at most one row per key and bucket, however many rows a key has.  Rows without a time are left out.
    """
    micros, width = F.unix_micros(at), gap * 1_000_000
    buckets = rows.where(F.col(at).isNotNull()).groupBy(key, F.floor(micros / width).alias("bucket")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("bucket")
    opens = F.coalesce(F.unix_micros("first") - F.lag(F.unix_micros("last")).over(order) > width, F.lit(True))
    numbered = buckets.withColumn("opens", opens).withColumn("session", F.sum(F.col("opens").cast("long")).over(order))
    return numbered.groupBy(key, "session").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.sum("n").alias("n")).drop("session")
