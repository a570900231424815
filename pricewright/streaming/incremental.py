"""Recommendations kept up to date as events arrive: only the games that a batch touches are decided again.

Three folders grow batch by batch, each part under the number of its batch, so a batch that runs again replaces
its own parts and nothing else: ``log`` (the events), ``decided`` (recommendations of the games decided in that
batch) and ``pushed`` (recommendations that a failed feed has invalidated).  The row of a game with the highest
version is current.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewright.operators.pointintime import latest_by
from pricewright.plans.slate import evaluate
from pricewright.sources.tables import MARKET_OF_EVENT, Tables

FAILED = "Feed failed"
#: Event types that say something about the game they name.
TELLING = (*(kind for kind, _ in MARKET_OF_EVENT), "signup", "error")


@dataclass(frozen=True)
class LoggedTables(Tables):
    """Tables with the events of ``log``."""

    log: DataFrame | None = None

    def base(self, name: str) -> DataFrame:
        return self.log if name == "events" else super().base(name)


@dataclass(frozen=True)
class TouchedTables(LoggedTables):
    """All that is keyed by game is read for the games of ``touched`` only.

    Positions stay whole, since exposure to a team counts those of all its games.
    """

    touched: DataFrame | None = None

    def _of_touched(self, rows: DataFrame, key: str = "game_id") -> DataFrame:
        games = self.touched.select(F.col("game_id").alias("_touched"))
        return rows.join(games, F.col(key) == F.col("_touched"), "left_semi")

    @property
    def game_events(self) -> DataFrame:
        return self._of_touched(super().game_events)

    @property
    def games(self) -> DataFrame:
        return self._of_touched(super().games)

    @property
    def projection(self) -> DataFrame:
        return self._of_touched(super().projection, "part_id")

    @property
    def manual_prices(self) -> DataFrame:
        return self._of_touched(super().manual_prices)

    @property
    def availability(self) -> DataFrame:
        return self._of_touched(super().availability)

    @property
    def weather(self) -> DataFrame:
        return self._of_touched(super().weather)


class Recommendations:
    """The three folders below ``path``, kept up to date by ``follow``."""

    def __init__(self, tables: Tables, path: str, price_minutes: float) -> None:
        self.spark: SparkSession = tables.spark
        self.tables, self.path, self.price_minutes = tables, path, price_minutes

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes all events that are there, batch by batch; each batch leaves a complete table behind."""
        return events.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def take(self, batch: DataFrame, number: int) -> None:
        """Decides the games that a batch of events touches, on all events up to it."""
        batch.write.mode("overwrite").parquet(f"{self.path}/log/version={number}")
        arrived, before, log = (self._log(c) for c in (F.col("version") == number, F.col("version") < number, F.col("version") <= number))
        feeds, feeds_before = (self._feeds(rows) for rows in (log, before))
        # A feed that goes down or comes back touches every game, else an event touches the game it names.
        touching = arrived.where(F.col("event_type").isin(*TELLING)) if feeds == feeds_before else log
        touched = self._written(touching.select(F.col("user_id").alias("game_id")).where("game_id IS NOT NULL").distinct(), "touched", number)
        self._push(arrived, number)
        tables = TouchedTables(self.spark, self.tables.folder, self.tables.schemas, log=log, touched=touched)
        rows = self.spark.createDataFrame(feeds, "feed string, status string")
        self._written(evaluate(tables, price_minutes=self.price_minutes, feeds=rows), "decided", number)

    def _push(self, arrived: DataFrame, number: int) -> None:
        """Records open recommendations of earlier batches that a failure in this one hits, each version once."""
        failed = arrived.where((F.col("event_type") == "error") & (F.col("value") > 200)).groupBy(F.col("user_id").alias("game_id")).agg(F.min("ts").cast("timestamp").alias("at"))
        columns = "game_id long, version long, status string, reason string, at timestamp"
        if not number:
            rows = self.spark.createDataFrame([], columns)
        else:
            open_ = self.current(number - 1).where(F.col("status").isin("BET", "WATCH")).select("game_id", "version", "status")
            known = self.pushed(number - 1).select("game_id", "version")
            rows = open_.join(failed, "game_id").join(known, ["game_id", "version"], "left_anti").select("game_id", "version", "status", F.lit(FAILED).alias("reason"), "at")
        self._written(rows.withColumnRenamed("version", "of_version"), "pushed", number)

    def current(self, up_to: int | None = None) -> DataFrame:
        """The recommendation of each game, with the version (batch) that decided it."""
        rows = self.spark.read.parquet(f"{self.path}/decided").withColumn("version", F.col("version").cast("long"))
        return latest_by(rows if up_to is None else rows.where(F.col("version") <= up_to), ["game_id"], ["version"])

    def pushed(self, up_to: int | None = None) -> DataFrame:
        """Invalidated recommendations: game, version that was hit, its status, reason and time of the failure."""
        rows = self.spark.read.parquet(f"{self.path}/pushed")
        rows = rows if up_to is None else rows.where(F.col("version") <= up_to)
        return rows.select("game_id", F.col("of_version").alias("version"), "status", "reason", "at")

    def _log(self, of: object) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/log").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/log").where(of).drop("version")

    def _feeds(self, log: DataFrame) -> list[tuple[str, str]]:
        """Feeds and their status; as many rows as there are feeds."""
        return sorted(map(tuple, LoggedTables(self.spark, self.tables.folder, log=log).feed_statuses.collect()))

    def _written(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.path}/{name}/version={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
