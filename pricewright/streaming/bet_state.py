"""Ledger state kept by a stream: every bet folded from its events in their own order, every balance from the bets.

Events of a bet are numbered from 1 (``seq``; the first one places the bet).  They may arrive in any order, more
than once, and across restarts.  An event whose predecessors are not all there waits in the state; of several
arrivals under one number the first counts.  What a bet is worth follows from stake, odds and last valid result, by the
same column expressions as in the batch fold, so both give the same cents.

State lives in the state store, so no task holds more than its own keys and a restart goes on where the checkpoint
is.  A call of the state function costs milliseconds, whatever it gets, so bets are dealt to a fixed number of parts: a
part is one row of state and one call for all its events of a batch.  Only with timers, which belong to a row of
state, every bet has a row of its own.  Balances are a second stream over the table of changes that the first one
appends to.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pricewright.functions.odds import payout, settlement_delta
from pricewright.operators.ledger import MONEY, SETTLED
from pricewright.operators.pointintime import latest_by

#: Parts to which bets are dealt.
PARTS = 1024

_STATE = "user_id long, stake double, american long, result string, before string, corrections int, applied int, waiting string"
_PART = "parts int, bets binary"
_APPLIED = "bet_id long, user_id long, seq int, event_type string, stake double, american long, result string, previous string, corrections int, valid boolean, missing int"
_NAMES = [c.split()[0] for c in _APPLIED.split(", ")]
_EVENT = ["bet_id", "seq", "event_type", "result", "user_id", "stake", "american"]
#: A bet without events; what waits comes after these.
_NEW = (None, None, None, "PENDING", None, 0, 0)


def _bet_functions():
    """``taken``, ``events`` and ``frame``; functions inside a function travel whole, so executors need no copy of this package."""

    def known(x: Any, kind: type) -> Any:
        return None if x is None or x != x else kind(x)

    def taken(bet_id: int, bet: tuple, event: tuple, rows: list[tuple]) -> tuple:
        """The bet after an event has arrived; ``rows`` gets a row for each event that can be applied now."""
        user, stake, american, result, before, corrections, applied, waiting = bet
        seq, kind, new, *of_bet = event
        if seq <= applied or seq in waiting:
            return bet
        of_bet = [known(x, of) for x, of in zip(of_bet, (int, float, int), strict=True)] if kind == "PLACED" else [None] * 3
        waiting[seq] = [kind, new, *of_bet]
        while (following := waiting.pop(applied + 1, None)) is not None:
            applied += 1
            kind, new, *of_bet = following
            previous, valid = result, kind == "PLACED"
            if valid:
                user, stake, american = of_bet
            elif new in SETTLED:
                valid = kind in ("SETTLED", "VOIDED") if before is None else kind == "CORRECTED" and new != before
                before = new
                if valid:
                    result, corrections = new, corrections + (kind == "CORRECTED")
            rows.append((bet_id, user, applied, kind, stake, american, result, previous, corrections, valid, None))
        return user, stake, american, result, before, corrections, applied, waiting

    def events(batch: pd.DataFrame) -> Iterator[tuple]:
        return zip(*(batch[c].tolist() for c in _EVENT), strict=True)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_NAMES, dtype=object)  # whole numbers stay whole beside missing ones

    return taken, events, frame


def _folded(patience_ms: int | None):
    """Applies a bet's events in order of ``seq``; a gap that is still there after ``patience_ms`` is reported once."""
    taken, events, frame = _bet_functions()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *bet, text = state.get if state.exists else (*_NEW, "{}")
        was = bet[-1]
        if state.hasTimedOut:
            yield frame([(key[0], bet[0], was, "GAP", None, None, None, None, None, False, was + 1)])
            return
        bet, rows = (*bet, {int(seq): event for seq, event in json.loads(text).items()}), []
        for batch in batches:
            for _, *event in events(batch):
                bet = taken(key[0], bet, event, rows)
        *known, waiting = bet
        state.update((*known, json.dumps(waiting)))
        if patience_ms is not None and waiting and (known[-1] > was or was == 0):
            state.setTimeoutDuration(patience_ms)
        if rows:
            yield frame(rows)

    return fold


def _folded_parts(parts: int):
    """The same for all bets of a part, whose state is packed."""
    taken, events, frame = _bet_functions()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dealt, packed = state.get if state.exists else (parts, None)
        if dealt != parts:
            raise ValueError(f"this checkpoint deals bets to {dealt} parts, not to {parts}")
        bets = {} if packed is None else pickle.loads(zlib.decompress(packed))
        for batch in batches:
            rows: list[tuple] = []
            for bet_id, *event in events(batch):
                bets[bet_id] = taken(bet_id, bets.get(bet_id) or (*_NEW, {}), event, rows)
            if rows:
                yield frame(rows)
        state.update((parts, zlib.compress(pickle.dumps(bets, 5), 1)))

    return fold


def bet_changes(events: DataFrame, patience_ms: int | None = None, parts: int = PARTS) -> DataFrame:
    """What each event does to its bet, in order: append-only, a row per applied event.

    ``events``: bet_id, seq, event_type, result, and in a PLACED event user_id, stake, american; rows without
    bet_id or seq are left out.  ``change`` is what the event adds to the user's balance; ``valid`` tells whether
    it counted.  With ``patience_ms``, rows of type GAP tell which number (``missing``) a bet has waited for
    longer than that; nothing is given up.  This sets timers on the clock, for a stream that keeps running: with
    the trigger ``availableNow`` Spark would go on with empty batches to serve them.

    Without it, bets are dealt to ``parts`` parts by a hash, and a batch rewrites the state of each part that it
    touches: more parts suit small batches, fewer suit large ones.  A checkpoint keeps its number of parts.
    """
    placed = lambda c: F.when(F.col("event_type") == "PLACED", F.col(c).cast("long").cast("string")).alias(c)  # noqa: E731  as text, numbers arrive exactly
    known = events.where(F.col("bet_id").isNotNull() & F.col("seq").isNotNull())
    known = known.select("bet_id", "seq", "event_type", "result", placed("user_id"), F.col("stake").cast("double").alias("stake"), placed("american"))
    if patience_ms is None:
        dealt = known.withColumn("part", F.pmod(F.xxhash64("bet_id"), F.lit(parts)).cast("int")).groupBy("part")
        rows = dealt.applyInPandasWithState(_folded_parts(parts), _APPLIED, _PART, "append", GroupStateTimeout.NoTimeout)
    else:
        rows = known.groupBy("bet_id").applyInPandasWithState(_folded(patience_ms), _APPLIED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    worth = lambda result: F.coalesce(settlement_delta(F.col("stake"), F.col("american"), F.col(result)), F.lit(0.0)).cast(MONEY)
    return rows.select(
        "bet_id", "user_id", "seq", "event_type", "result", "corrections", "valid", "missing",
        worth("result").alias("delta"), payout(F.col("stake"), F.col("american"), F.col("result")).cast(MONEY).alias("payout"),
        (worth("result") - worth("previous")).cast(MONEY).alias("change"),
    )


def user_balances(changes: DataFrame) -> DataFrame:
    """Balance change and number of events of each user, for every batch that touched it (update mode)."""
    moved = changes.where(F.col("event_type") != "GAP")
    return moved.groupBy("user_id").agg(F.sum("change").cast(MONEY).alias("balance"), F.count(F.lit(1)).alias("changes"))


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to a table; files of a batch count only once, also after a restart."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def update_in(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the rows that each batch changed, under the batch's number; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current_bets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """State of every bet in an appended table of ``bet_changes``."""
    rows = spark.read.schema(schema).parquet(path).where(F.col("event_type") != "GAP")
    return latest_by(rows, ["bet_id"], ["seq"])


def current_balances(spark: SparkSession, path: str, start: float) -> DataFrame:
    """Balance of every user in a versioned table of ``user_balances``, from the balance at the start."""
    schema = f"user_id long, balance {MONEY}, changes long, version long"
    rows = latest_by(spark.read.schema(schema).parquet(path), ["user_id"], ["version"])
    return rows.select("user_id", (F.col("balance") + F.lit(start).cast(MONEY)).cast(MONEY).alias("balance"), "changes")
