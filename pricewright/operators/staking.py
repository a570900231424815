"""Stake sizing: Kelly fraction, haircuts, and the tightest of the portfolio caps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.odds import full_kelly, round_cents


@dataclass(frozen=True)
class RiskControls:
    """Default limits of the decision rules and the stake pipeline."""

    kelly_fraction: float = 0.25
    per_bet: float = 0.005
    per_game: float = 0.01
    per_team: float = 0.015
    per_cluster: float = 0.0125
    weekly: float = 0.04
    monthly_loss: float = 0.0
    min_edge: float = 0.02
    min_completeness: float = 0.85
    max_price_age: float = 60.0
    max_uncertainty: float = 15.5


#: Labels of what bounds a stake, in the order that breaks ties.
BOUNDS = (
    "Risk-adjusted Kelly",
    "Per-bet cap",
    "Same-game cap",
    "Team weekly cap",
    "Correlated-cluster cap",
    "Weekly open-stake cap",
)
NO_STAKE = "No positive Kelly stake"


def stake_input_errors(uncertainty: Column, quality: Column, calibration: Column, bankroll: Column) -> Column:
    """Names of invalid inputs: multipliers outside [0, 1], a missing or negative bankroll."""
    named = (("uncertaintyMultiplier", uncertainty), ("dataQualityMultiplier", quality), ("calibrationMultiplier", calibration))
    bad = [F.when(~F.coalesce((m >= 0) & (m <= 1), F.lit(False)), name) for name, m in named]
    return F.array_compact(F.array(*bad, F.when(~F.coalesce(bankroll >= 0, F.lit(False)), "bankroll")))


def with_stake(
    df: DataFrame, p: Column, american: Column, push: Column, bankroll: Column, controls: RiskControls,
    uncertainty: Column | float = 0.85, quality: Column | float = 1.0, calibration: Column | float = 0.9,
    game: Column | float = 0.0, team: Column | float = 0.0, cluster: Column | float = 0.0, weekly: Column | float = 0.0, name: str = "stake",
) -> DataFrame:
    """Adds a struct of every stage, the final fraction and amount, and what bound it.

    The minimum is taken over structs (fraction, order, label), so the first of equals wins.
    Exposures are fractions of the bankroll.  Invalid odds, probabilities, multipliers or
    bankrolls (``stake_input_errors`` names them) give NULL, so that one row doesn't stop a batch.  The
    steps are columns of their own, so that each is computed once per row.
    """
    column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    room = lambda cap, used: F.greatest(F.lit(0.0), cap - F.coalesce(column(used), F.lit(0.0)))
    valid = F.size(stake_input_errors(column(uncertainty), column(quality), column(calibration), bankroll)) == 0
    rows = df.withColumns({"_kelly": F.when(valid, full_kelly(p, american, push)), "_factors": F.array(*map(column, (uncertainty, quality, calibration)))})
    stages = [F.col("_kelly"), F.col("_kelly") * controls.kelly_fraction]
    for i in range(3):
        stages.append(stages[-1] * F.col("_factors")[i])
    limits = [
        stages[-1],
        F.lit(controls.per_bet),
        room(controls.per_game, game),
        room(controls.per_team, team),
        room(controls.per_cluster, cluster),
        room(controls.weekly, weekly),
    ]
    options = [F.struct(x.alias("pct"), F.lit(i).alias("rank"), F.lit(BOUNDS[i]).alias("label")) for i, x in enumerate(limits)]
    rows = rows.withColumn("_least", F.array_min(F.array(*options)))
    pct = F.greatest(F.lit(0.0), F.col("_least.pct"))
    bound = F.when((pct == 0) & (stages[-1] == 0), NO_STAKE).otherwise(F.col("_least.label"))
    names = ("full_kelly", "fraction_kelly", "after_uncertainty", "after_quality", "after_calibration")
    fields = [x.alias(n) for x, n in zip(stages, names, strict=True)]
    amount = round_cents(bankroll * pct)
    whole = F.struct(*fields, F.lit(controls.per_bet).alias("per_bet_cap"), pct.alias("pct"), amount.alias("amount"), bound.alias("bound"))
    return rows.withColumn(name, F.when(F.col("_kelly").isNotNull(), whole)).drop("_kelly", "_factors", "_least")
