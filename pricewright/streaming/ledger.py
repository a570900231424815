"""Streaming twins of the append-only tables.

The batch operators define the results; these keep them up to date as rows are appended.
Event time is ``observed_at``, late rows beyond the watermark are dropped from windows only
(``streaming.lateness`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_activity(quotes: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Quotes per market and window of event time, with the last line seen."""
    return (
        quotes.withWatermark("observed_at", watermark)
        .groupBy(F.window("observed_at", window), "market")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("line", F.struct("observed_at", "seq")).alias("last_line"))
        .select(F.col("window.start").alias("start"), "market", "n", "last_line")
    )


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote per game and market; state is one row per key (update or complete mode)."""
    row = F.struct("line", "home_american", "seq")
    return quotes.groupBy("game_id", "market").agg(F.max_by(row, F.struct("observed_at", "seq")).alias("q")).select("game_id", "market", "q.*")


def deduplicated(events: DataFrame, id_col: str = "seq", at: str = "observed_at", watermark: str = "1 day") -> DataFrame:
    """Each record once, if repeats arrive within the watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([id_col])


def balances(deltas: DataFrame) -> DataFrame:
    """Running balance change per user as settlements arrive."""
    return deltas.groupBy("user_id").agg(F.sum("delta").alias("change"), F.count(F.lit(1)).alias("settled"))


def append_ledger(source: DataFrame, path: str, checkpoint: str, checked: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> StreamingQuery:
    """Appends the accepted rows of each batch, and the rejected ones beside them.

    A batch that is run again replaces its own folder, so every row is stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = checked(batch)
        good.write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def invalidations(events: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Stream-static join: recommendations that a stream of feed failures (game_id, reason, at) hits."""
    open_ = recommendations.where(F.col("status").isin("BET", "WATCH"))
    return events.join(open_, "game_id").select("rec_id", "game_id", "reason", "at")
