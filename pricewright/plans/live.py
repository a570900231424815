"""Queries that run streams: tables arrive in several batches, in an order of their own, and partly twice.

Each one stages the arrivals of a base table, lets a stream take all of them, and returns what it has kept.
The result does not depend on the order, so the SQL beside it is that of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import times
from pricewright.operators import bitemporal, lateness
from pricewright.plans.catalog import PRICE_MINUTES, START, displayed, query
from pricewright.sources.scratch import arrivals, folder
from pricewright.sources.tables import Tables, now
from pricewright.streaming import bet_state, incremental, update_guard
from pricewright.streaming import lateness as lateness_stream

#: Files, and so batches, in which rows arrive.
BATCHES = 3
#: A feed's row is late if it is this much behind what the feed has shown.
LATE_SECONDS = 12 * 3600


def _stream(rows: DataFrame, name: str, *order: str, batches: int = BATCHES, files: int | None = None) -> DataFrame:
    """A stream that takes the arrivals of ``rows`` one after the other; each is one file, or ``files``."""
    spark = rows.sparkSession
    path = arrivals(rows, name, batches, *(F.col(c) for c in order), files=files)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files or 1).parquet(path)


def bet_events(t: Tables) -> DataFrame:
    """Every bet is placed, every second one settled, every tenth corrected to a push; ``copy`` 1 are repeats."""
    bets = t.positions.select("bet_id", "user_id", F.col("stake").cast("double").alias("stake"), F.col("american").cast("long").alias("american"))
    result = F.element_at(F.array(*map(F.lit, ("WIN", "LOSS", "PUSH", "VOID"))), (F.floor(F.col("bet_id") / 2) % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    event = lambda seq, kind, of: F.struct(F.lit(seq).alias("seq"), kind.alias("event_type"), of.alias("result"))
    events = F.array_compact(F.array(
        event(1, F.lit("PLACED"), none),
        F.when(F.col("bet_id") % 2 == 0, event(2, F.when(result == "VOID", "VOIDED").otherwise("SETTLED"), result)),
        F.when(F.col("bet_id") % 10 == 0, event(3, F.lit("CORRECTED"), F.lit("PUSH"))),
    ))
    rows = bets.withColumn("e", F.explode(events))
    copies = F.explode(F.when(F.col("bet_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("bet_id", "e.*", "user_id", "stake", "american", copies.alias("copy"))


def _bet_changes(t: Tables) -> DataFrame:
    """The stream of changes; its arrivals have as many files together as a shuffle has partitions, so that no task writes one alone."""
    files = -(-int(t.spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES)
    return bet_state.bet_changes(_stream(bet_events(t), "bet-events", "bet_id", "seq", "copy", files=files))


@query
def ledger_stream(t: Tables) -> DataFrame:
    """Last state of every bet, kept by a stateful stream."""
    changes = _bet_changes(t)
    path = folder(t.spark, "bet-changes")
    bet_state.append_to(changes, path, folder(t.spark, "checkpoint")).awaitTermination()
    rows = bet_state.current_bets(t.spark, path, changes.schema)
    return rows.select("bet_id", "result", "corrections", F.col("delta").cast("double").alias("delta"), F.col("payout").cast("double").alias("payout"))


@query
def ledger_stream_balances(t: Tables) -> DataFrame:
    """Balance of every user: one stream folds the bets, a second one adds up the changes that the first one appends."""
    changes = _bet_changes(t)
    path, balances = folder(t.spark, "bet-changes"), folder(t.spark, "balances")
    bet_state.append_to(changes, path, folder(t.spark, "checkpoint")).awaitTermination()
    appended = t.spark.readStream.schema(changes.schema).parquet(path)
    bet_state.update_in(bet_state.user_balances(appended), balances, folder(t.spark, "checkpoint")).awaitTermination()
    return bet_state.current_balances(t.spark, balances, START).select("user_id", F.col("balance").cast("double").alias("balance"))


@query
def incremental_recommendations(t: Tables) -> DataFrame:
    """The slate after several batches of events, each of which decided only the games it touched."""
    kept = incremental.Recommendations(t, folder(t.spark, "recommendations"), PRICE_MINUTES)
    kept.follow(_stream(t.base("events"), "events", "event_id", batches=2), folder(t.spark, "checkpoint")).awaitTermination()
    return displayed(kept.current().drop("version"))


def _feed_rows(t: Tables) -> DataFrame:
    """Events with three clocks: reported up to four minutes before they are observed, ingested up to three days after."""
    at = F.col("ts").cast("timestamp")
    late = F.timestamp_micros(F.unix_micros(at) + F.pmod(F.col("event_id") * 31, F.lit(73)) * 3_600_000_000)
    return t.base("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("feed"), times.minutes_before(at, F.col("event_id") % 5).alias("source_updated_at"), at.alias("observed_at"), late.alias("ingested_at")
    )


def _late_rows(t: Tables) -> lateness_stream.LateRows:
    """Takes the feed rows in three batches by ingest time."""
    rows = _feed_rows(t)
    path = folder(t.spark, "feeds")
    cuts = bitemporal.time_cuts(rows, "ingested_at", -(-rows.count() // BATCHES))
    for n in range(len(cuts) + 1):
        rows.where(bitemporal.range_of(F.col("ingested_at"), cuts) == n).coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = lateness_stream.LateRows(t.spark, folder(t.spark, "late"), LATE_SECONDS, rows_per_range=1000)
    kept.follow(stream, folder(t.spark, "checkpoint")).awaitTermination()
    return kept


@query
def late_rows(t: Tables) -> DataFrame:
    """Every event with what the stream made of it: accepted or late."""
    kept = _late_rows(t)
    return kept.accepted().select("id", "feed", F.lit(False).alias("late")).unionByName(kept.late().select("id", "feed", F.lit(True).alias("late")))


@query
def feed_clocks(t: Tables) -> DataFrame:
    """Late rows, clock faults and lags of each feed: the batch twin of the stream."""
    rows = _feed_rows(t)
    none = t.spark.createDataFrame([], "feed string, mark timestamp")
    judged = lateness.with_late(rows, none, LATE_SECONDS, cuts=bitemporal.time_cuts(rows, "ingested_at", 1000))
    return lateness.clock_report(judged)


@query
def feed_sessions(t: Tables) -> DataFrame:
    """Sessions of each feed; a pause of ten minutes ends one."""
    return lateness.sessions(_feed_rows(t), 600)


@query
def update_guard_stream(t: Tables) -> DataFrame:
    """Forbidden updates, found by a stream of updates and one of corrections that arrive in different orders."""
    old = t.positions.select("bet_id", "user_id", "game_id", "market", "american", "stake", "result")
    new = old.withColumn("american", F.when(F.col("bet_id") % 4 == 0, F.col("american") + 1).otherwise(F.col("american")))
    new = new.withColumn("result", F.when((F.col("bet_id") % 3 == 0) & (F.col("result") != "PENDING"), "VOID").otherwise(F.col("result")))
    new = new.withColumn("updated_at", times.minutes_before(now(), F.col("bet_id") % 500))
    events = new.where(F.col("bet_id") % 6 == 0).select("bet_id", F.lit("CORRECTED").alias("event_type"), times.minutes_before(F.col("updated_at"), F.col("bet_id") % 11).alias("created_at"))
    later = F.lit("2024-02-20 00:00:00").cast("timestamp")
    end = t.spark.range(1).select(F.lit(-1).cast("long").alias("bet_id"), later.alias("updated_at"), later.alias("created_at"), F.lit("CORRECTED").alias("event_type"))
    streams = []
    for rows, name in ((new, "updates"), (events, "corrections")):
        path = arrivals(rows, name, BATCHES, F.col("bet_id"), F.lit(name))
        rows.limit(0).unionByName(end.select(*(c for c in end.columns if c in rows.columns)), allowMissingColumns=True).select(rows.columns).coalesce(1).write.mode("append").parquet(path)
        streams.append(t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    found = update_guard.update_violations(old, *streams, delay="1 day")
    path = folder(t.spark, "violations")
    bet_state.append_to(found, path, folder(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.schema(found.schema).parquet(path).select("bet_id", "violation", F.concat_ws(",", "changed").alias("changed"))
