"""Append-only ledger: bets and events are only ever added, state is folded from them.

Money is rounded to cents per event and summed as decimal(18,2), so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.functions.odds import closing_line_value, implied_probability, payout, settlement_delta
from pricewright.functions.text import record_id

MONEY = "decimal(18,2)"
SETTLED = ("WIN", "LOSS", "PUSH", "VOID")


def bet_errors(stake: Column, balance: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(stake > 0, F.lit(False)), "Stake must be positive."),
            F.when(stake > balance, "Stake exceeds available bankroll."),
        )
    )


def place_bets(bets: DataFrame, balance: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accepted bets, their PLACED events, audit rows, and rejected rows with reasons.

    Stakes stay part of the balance until settlement; open stakes are not reserved.
    """
    checked = bets.withColumn("errors", bet_errors(F.col("stake"), F.lit(balance)))
    good = checked.where(F.size("errors") == 0).drop("errors")
    good = good.withColumn("bet_id", record_id("bet", *(F.col(c) for c in ("user_id", "game_id", "market", "selection", "placed_at", "seq")))).withColumn("result", F.lit("PENDING"))
    detail = F.format_string("%s bet placed: %s %s @ %d, stake %.2f", "mode", "selection", "market", F.col("american").cast("long"), F.col("stake").cast("double"))
    events = good.select(record_id("bev", F.col("bet_id"), F.lit("PLACED")).alias("event_id"), "bet_id", F.lit("PLACED").alias("event_type"), detail.alias("detail"), F.col("placed_at").alias("created_at"), F.col("user_id").alias("actor"), F.lit(None).cast("string").alias("result"))
    return good, events, audit(events, "BET_PLACED"), checked.where(F.size("errors") > 0)


def audit(events: DataFrame, action: str) -> DataFrame:
    return events.select(record_id("aud", F.col("event_id")).alias("audit_id"), F.lit(action).alias("action"), F.lit("bets").alias("entity"), F.col("bet_id").alias("entity_id"), "detail", "created_at", F.col("actor").alias("user_id"))


def settle(bets: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settles pending bets: result, delta, payout, event type; other settlements have an error.

    ``bets``: bet_id, stake, american, result.  ``settlements``: bet_id, new_result, and if known settled_at and
    closing_american; the latter gives ``clv`` in percentage points.  Of several settlements of one bet the
    first by settled_at, then by result, counts.
    """
    order = [c for c in ("settled_at", "new_result") if c in settlements.columns]
    nth = F.row_number().over(Window.partitionBy("bet_id").orderBy(*order))
    closing = F.col("closing_american") if "closing_american" in settlements.columns else F.lit(None).cast("long")
    joined = settlements.withColumns({"_nth": nth, "_closing": closing}).join(bets, "bet_id", "left")
    error = (
        F.when(F.col("result").isNull(), "unknown bet")
        .when((F.col("result") != "PENDING") | (F.col("_nth") > 1), "already settled")
        .when(~F.coalesce(F.col("new_result").isin(*SETTLED), F.lit(False)), "invalid result")
    )
    stake, american, result = F.col("stake"), F.col("american"), F.col("new_result")
    ok = lambda c: F.when(F.col("error").isNull(), c)
    taken, closed = implied_probability(american), implied_probability(F.col("_closing"))
    return joined.withColumn("error", error).select(
        *(c for c in joined.columns if c not in ("_nth", "_closing")),
        "error",
        ok(closing_line_value(taken, closed)).alias("clv"),
        ok(settlement_delta(stake, american, result)).cast(MONEY).alias("delta"),
        ok(payout(stake, american, result)).cast(MONEY).alias("payout"),
        ok(F.when(result == "VOID", "VOIDED").otherwise("SETTLED")).alias("event_type"),
    )


def fold_results(bets: DataFrame, events: DataFrame) -> DataFrame:
    """Current state of every bet from its events in order (``seq``): the last result wins.

    ``events``: bet_id, seq, event_type, result.  A correction counts only after a settlement and
    only if it changes the result.  Payout and delta follow the last result.
    """
    results = events.where(F.col("result").isin(*SETTLED))
    order = Window.partitionBy("bet_id").orderBy("seq")
    before = F.lag("result").over(order)
    first = F.row_number().over(order) == 1
    valid = F.when(first, F.col("event_type").isin("SETTLED", "VOIDED")).otherwise((F.col("event_type") == "CORRECTED") & (F.col("result") != before))
    last = (
        results.withColumn("valid", valid).where("valid").groupBy("bet_id").agg(F.max_by("result", "seq").alias("final"), F.count_if(F.col("event_type") == "CORRECTED").alias("corrections"))
    )
    stake, american = F.col("stake"), F.col("american")
    state = bets.join(last, "bet_id", "left").withColumn("result", F.coalesce("final", F.lit("PENDING"))).drop("final")
    return state.select(
        *[c for c in state.columns if c != "corrections"],
        F.coalesce("corrections", F.lit(0)).alias("corrections"),
        F.coalesce(settlement_delta(stake, american, F.col("result")), F.lit(0.0)).cast(MONEY).alias("delta"),
        payout(stake, american, F.col("result")).cast(MONEY).alias("payout"),
    )


def corrections(bets: DataFrame, changes: DataFrame) -> DataFrame:
    """Reversal and newly applied amount of each correction.  ``bets`` must be settled and change."""
    joined = changes.join(bets, "bet_id", "left")
    error = (
        F.when(F.col("result").isNull(), "unknown bet")
        .when(F.col("result") == "PENDING", "not settled")
        .when(F.col("result") == F.col("new_result"), "no change")
    )
    reversal = -settlement_delta(F.col("stake"), F.col("american"), F.col("result"))
    applied = settlement_delta(F.col("stake"), F.col("american"), F.col("new_result"))
    rows = joined.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select(*rows.columns, F.when(ok, reversal).cast(MONEY).alias("reversal"), F.when(ok, applied).cast(MONEY).alias("applied"))


def balances(state: DataFrame, keys: list[str], start: float) -> DataFrame:
    """Balance of each key: start plus all deltas."""
    total = F.coalesce(F.sum("delta"), F.lit(0).cast(MONEY))
    return state.groupBy(*keys).agg((total + F.lit(start).cast(MONEY)).cast(MONEY).alias("balance"))


def _checked_vintages(history: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``conflict``: a known id, or a known (game, vintage, model); of rows of ``new`` that
    clash with each other the first by id, model and game is no conflict."""
    slot = ["game_id", "vintage", "model"]
    ids = history.select("prediction_id").distinct().withColumn("known_id", F.lit(True))
    slots = history.select(*slot).distinct().withColumn("known_slot", F.lit(True))
    joined = new.join(ids, "prediction_id", "left").join(slots, slot, "left")
    known = F.coalesce("known_id", F.lit(False)) | F.coalesce("known_slot", F.lit(False))
    same_id = F.row_number().over(Window.partitionBy(known, "prediction_id").orderBy("model", "game_id", "vintage"))
    ranked = joined.withColumns({"known": known, "same_id": same_id})
    first = ~F.col("known") & (F.col("same_id") == 1)
    same_slot = F.row_number().over(Window.partitionBy(first, *slot).orderBy("prediction_id"))
    conflict = (
        F.when(F.col("known_id") | (~F.col("known") & (F.col("same_id") > 1)), "prediction exists")
        .when(F.col("known_slot") | (first & (F.col("same_slot") > 1)), "vintage exists")
    )
    return ranked.withColumn("same_slot", same_slot).withColumn("conflict", conflict).select(*new.columns, "conflict")


def vintage_conflicts(history: DataFrame, new: DataFrame) -> DataFrame:
    """New predictions that must not be appended: the id, or the (game, vintage, model), is known or comes earlier in ``new``."""
    return _checked_vintages(history, new).where(F.col("conflict").isNotNull())


def append_vintages(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(_checked_vintages(history, new).where(F.col("conflict").isNull()).drop("conflict"))


def invalidate(recs: DataFrame, games: DataFrame, reason: str, at: Column) -> DataFrame:
    """Marks open BET and WATCH recommendations of the listed games, with the reason put first."""
    listed = games.select("game_id").distinct().withColumn("_hit", F.lit(True))
    joined = recs.join(listed, "game_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("status").isin("BET", "WATCH") & F.col("invalidated_at").isNull()
    return joined.select(
        *[c for c in recs.columns if c not in ("invalidated_at", "reasons")],
        F.when(hit, F.concat(F.array(F.lit(reason)), "reasons")).otherwise(F.col("reasons")).alias("reasons"),
        F.when(hit, at).otherwise(F.col("invalidated_at")).alias("invalidated_at"),
    )
