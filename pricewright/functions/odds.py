"""Odds, expected value and stake fractions as column expressions.

Invalid input gives NULL (never NaN or an error), so one bad row cannot stop a batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conservative shrink to the market, clamp before fair odds, tolerance of p + q <= 1.
MARKET_SHRINK = 0.35
FAIR_LOW, FAIR_HIGH = 0.015, 0.985
TOTAL_TOLERANCE = 1e-12


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def round_cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def valid_american(a: Column) -> Column:
    a = a.cast("double")
    return a.isNotNull() & ~F.isnan(a) & (F.abs(a) >= 100) & (F.abs(a) < float("inf"))


def american_to_decimal(a: Column) -> Column:
    a = a.cast("double")
    return F.when(valid_american(a), F.when(a > 0, 1 + a / 100).otherwise(1 + 100 / F.abs(a)))


def implied_probability(a: Column) -> Column:
    a = a.cast("double")
    return F.when(valid_american(a), F.when(a > 0, 100 / (a + 100)).otherwise(F.abs(a) / (F.abs(a) + 100)))


def fair_american(p: Column) -> Column:
    """American odds without margin for a probability strictly between 0 and 1."""
    p = p.cast("double")
    dog, favourite = round_half_up(100 * (1 - p) / p), round_half_up(-100 * p / (1 - p))
    return F.when((p > 0) & (p < 1), F.when(p <= 0.5, dog).otherwise(favourite)).cast("long")


def decimal_to_american(d: Column) -> Column:
    d = d.cast("double")
    return F.when(d > 1, F.when(d >= 2, round_half_up((d - 1) * 100)).otherwise(round_half_up(-100 / (d - 1)))).cast("long")


def overround(*american: Column) -> Column:
    """Sum of implied probabilities less 1; NULL if any side is invalid."""
    return reduce(lambda a, b: a + b, map(implied_probability, american)) - 1


def no_vig(*american: Column) -> list[Column]:
    """Implied probabilities scaled to sum to 1."""
    implied = [implied_probability(a) for a in american]
    total = reduce(lambda a, b: a + b, implied)
    return [p / total for p in implied]


def no_vig_array(american: Column) -> Column:
    """The same for an array column; NULL with fewer than two sides or an invalid one."""
    implied = F.transform(american, implied_probability)
    total = F.aggregate(implied, F.lit(0.0), lambda s, p: s + p)
    return F.when((F.size(american) >= 2) & total.isNotNull(), F.transform(implied, lambda p: p / total))


def _valid_probability(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)


def break_even(a: Column, push: Column | float = 0.0) -> Column:
    q = _column(push)
    return F.when((q >= 0) & (q < 1), (1 - q) / american_to_decimal(a))


def expected_value(p: Column, a: Column, push: Column | float = 0.0) -> Column:
    """Per unit staked: p * profit less the chance of losing the stake."""
    p, q = p.cast("double"), _column(push)
    ok = _valid_probability(p) & _valid_probability(q) & (p + q <= 1 + TOTAL_TOLERANCE)
    return F.when(ok, p * (american_to_decimal(a) - 1) - (1 - p - q))


def edge(p: Column, break_even_p: Column) -> Column:
    ok = _valid_probability(p.cast("double")) & _valid_probability(break_even_p.cast("double"))
    return F.when(ok, p - break_even_p)


def full_kelly(p: Column, a: Column, push: Column | float = 0.0) -> Column:
    """Kelly fraction of the decided part; 1 if a win is certain, never below 0."""
    p, q, b = p.cast("double"), _column(push), american_to_decimal(a) - 1
    won = p / (1 - q)
    ok = _valid_probability(p) & (q >= 0) & (q < 1) & (p + q <= 1 + TOTAL_TOLERANCE)
    return F.when(ok & b.isNotNull(), F.when(won >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), (b * won - (1 - won)) / b)))


def fractional_kelly(p: Column, a: Column, fraction: Column | float, push: Column | float = 0.0) -> Column:
    f = _column(fraction)
    return F.when((f > 0) & (f <= 1), full_kelly(p, a, push) * f)


def conservative_probability(model: Column, market: Column, shrink: float = MARKET_SHRINK) -> Column:
    return model * (1 - shrink) + market * shrink


def clamped(p: Column, low: float = FAIR_LOW, high: float = FAIR_HIGH) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), p)))


def with_vig(p: Column, vig: Column | float) -> Column:
    return fair_american(clamped(p + vig))


def second_price(first: Column) -> Column:
    """The other side of a two-way price pair."""
    return -220 - first


def settlement_delta(stake: Column, a: Column, result: Column) -> Column:
    return (
        F.when(result == "WIN", round_cents(stake * (american_to_decimal(a) - 1)))
        .when(result == "LOSS", -stake)
        .when(result.isin("PUSH", "VOID"), F.lit(0.0))
    )


def payout(stake: Column, a: Column, result: Column) -> Column:
    return (
        F.when(result == "WIN", round_cents(stake + settlement_delta(stake, a, result)))
        .when(result.isin("PUSH", "VOID"), round_cents(stake))
        .when(result == "LOSS", F.lit(0.0))
    )


def target_price(fair: Column) -> Column:
    return F.when(fair.isNotNull(), F.greatest(fair, F.lit(-125).cast("long")))


def invalidation_price(a: Column) -> Column:
    return a - 10


def confidence(completeness: Column, edge_: Column) -> Column:
    e = F.coalesce(edge_, F.lit(0.0))
    high = (F.coalesce(completeness, F.lit(0.0)) > 0.92) & (e > 0.03)
    return F.when(high, "HIGH").when(e > 0.015, "MEDIUM").otherwise("LOW")


def closing_line_value(taken: Column, closing: Column) -> Column:
    """Percentage points between closing and taken probability."""
    ok = _valid_probability(taken.cast("double")) & _valid_probability(closing.cast("double"))
    return F.when(ok, (closing - taken) * 100)


def _column(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))
