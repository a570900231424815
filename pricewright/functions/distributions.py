"""Discretised outcome distributions.

All forms are local to a row: distributions are arrays, ``long_*`` explode them.  ``outcome_sums``
is the bulk form for sums over outcomes of many rows: an explode and a hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key-number boosts of the margin, ranges, rating scale, tolerance of a push.
KEY_BOOST = ((3, 2.1), (7, 1.75), (6, 1.35), (10, 1.3), (4, 1.2), (14, 1.2), (17, 1.1))
MARGIN_RANGE, TOTAL_RANGE = (-45, 45), (10, 90)
RATING_STD = 13.2
PUSH_TOLERANCE = 1e-9
#: Rational approximation of the error function (five coefficients).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    x = x.cast("double")
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    y = 1 - poly * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column | float, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    z = (_column(x) - _column(mu)) / _column(sigma)
    return 0.5 * (1 + erf(z / F.sqrt(F.lit(2.0))))


def normal_pdf(x: Column | float, mu: Column | float, sigma: Column | float) -> Column:
    s = _column(sigma)
    z = (_column(x) - _column(mu)) / s
    return F.exp(-0.5 * z * z) / (s * F.sqrt(2 * F.pi()))


def margin_to_win_probability(margin: Column, sigma: float = RATING_STD) -> Column:
    return 1 - normal_cdf(0.0, margin, sigma)


def key_boost(value: Column) -> Column:
    out = F.when(F.abs(value) == KEY_BOOST[0][0], KEY_BOOST[0][1])
    for key, boost in KEY_BOOST[1:]:
        out = out.when(F.abs(value) == key, boost)
    return out.otherwise(1.0)


def margin_values() -> Column:
    return F.filter(F.sequence(F.lit(MARGIN_RANGE[0]), F.lit(MARGIN_RANGE[1])), lambda v: v != 0)


def total_values() -> Column:
    return F.sequence(F.lit(TOTAL_RANGE[0]), F.lit(TOTAL_RANGE[1]))


def _bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def _array(values: Column, weight) -> Column:
    raw = F.transform(values, lambda v: F.struct(v.alias("value"), weight(v).alias("w")))
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["w"])
    share = lambda t: lambda x: F.struct(x["value"].alias("value"), (x["w"] / t).alias("probability"))
    return _bound(raw, lambda rows: _bound(total(rows), lambda t: F.transform(rows, share(t))))


def margin_distribution(mu: Column, sigma: Column) -> Column:
    """array<struct<value, probability>> of the margin; a tie is impossible."""
    return _array(margin_values(), lambda v: normal_pdf(v, mu, sigma) * key_boost(v))


def total_distribution(mu: Column, sigma: Column) -> Column:
    return _array(total_values(), lambda v: normal_pdf(v, mu, sigma))


def probability_where(dist: Column, condition) -> Column:
    """Sum of probabilities of the values that satisfy ``condition``."""
    return F.aggregate(dist, F.lit(0.0), lambda s, x: s + F.when(condition(x["value"]), x["probability"]).otherwise(0.0))


def spread_outcomes(dist: Column, line: Column) -> Column:
    """struct<cover, push, lose> of the home side at a line."""
    cover = probability_where(dist, lambda v: v + line > PUSH_TOLERANCE)
    push = probability_where(dist, lambda v: F.abs(v + line) < PUSH_TOLERANCE)
    return F.struct(cover.alias("cover"), push.alias("push"), F.greatest(F.lit(0.0), 1 - cover - push).alias("lose"))


def total_outcomes(dist: Column, line: Column) -> Column:
    over = probability_where(dist, lambda v: v - line > PUSH_TOLERANCE)
    push = probability_where(dist, lambda v: F.abs(v - line) < PUSH_TOLERANCE)
    return F.struct(over.alias("over"), push.alias("push"), F.greatest(F.lit(0.0), 1 - over - push).alias("under"))


def long_margins(df: DataFrame, mu: str, sigma: str) -> DataFrame:
    """``df`` with value and probability, one row per margin.  Weights are normalised inside the row, so nothing is shuffled."""
    return _long(df, margin_distribution(F.col(mu), F.col(sigma)))


def long_totals(df: DataFrame, mu: str, sigma: str) -> DataFrame:
    return _long(df, total_distribution(F.col(mu), F.col(sigma)))


def _long(df: DataFrame, outcomes: Column) -> DataFrame:
    columns = [c for c in df.columns if c not in ("value", "probability")]
    return df.select(*columns, F.explode(outcomes).alias("_outcome")).select(*columns, "_outcome.value", "_outcome.probability")


def cumulative(dist: Column) -> Column:
    """struct<values, upto>: the values in order and the mass up to each of them, with a 0 in front.

    One pass over the outcomes; lines and quantiles are then looked up by halving.
    """
    first = F.array(F.lit(0.0))
    sums = lambda rows: F.aggregate(rows, first, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["probability"]))
    return _bound(F.array_sort(dist), lambda rows: F.struct(F.transform(rows, lambda x: x["value"]).alias("values"), sums(rows).alias("upto")))


def _count_where(items: Column, holds) -> Column:
    """How many items at the start of the array satisfy ``holds``, which no later item does again; seven steps for up to 127 items."""
    steps = F.array(*(F.lit(1 << k) for k in range(6, -1, -1)))
    ahead = lambda n, step: F.coalesce(holds(F.get(items, n + step - 1)), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(ahead(n, step), n + step).otherwise(n))


def mass_upto(cdf: Column, x: Column) -> Column:
    """Mass of the values that are at most ``x``."""
    return F.get(cdf["upto"], _count_where(cdf["values"], lambda v: v <= x))


def _outcomes_at(cdf: Column, at: Column, names: tuple[str, str, str]) -> Column:
    """struct of the mass above, at and below a point."""
    whole = F.element_at(cdf["upto"], -1)

    def shares(upto: Column) -> Column:
        above, tied = whole - upto, upto - mass_upto(cdf, at - PUSH_TOLERANCE)
        return F.struct(above.alias(names[0]), tied.alias(names[1]), F.greatest(F.lit(0.0), 1 - above - tied).alias(names[2]))

    return F.when(at.isNotNull(), _bound(mass_upto(cdf, at + PUSH_TOLERANCE), shares))


def spread_outcomes_at(cdf: Column, line: Column) -> Column:
    """``spread_outcomes`` from cumulative mass."""
    return _outcomes_at(cdf, -line, ("cover", "push", "lose"))


def total_outcomes_at(cdf: Column, line: Column) -> Column:
    """``total_outcomes`` from cumulative mass."""
    return _outcomes_at(cdf, line, ("over", "push", "under"))


def ladder(dist: Column, lines: Column, result) -> Column:
    """array<struct<line, result>>: ``result(cdf, line)`` at every line, the cumulative mass being computed once."""
    at = lambda d: F.transform(lines, lambda x: F.struct(x.alias("line"), result(d, x).alias("result")))
    return _bound(cumulative(dist), at)


def outcome_sums(df: DataFrame, keys: list[str], weight: Column, value: Column, conditions: dict[str, Column]) -> DataFrame:
    """One row per key: for each condition the share of weight where it holds, in one aggregate.

    The weights need not be normalised, so neither a window nor a second pass is needed.
    """
    rows = df.withColumn("value", F.explode(value)).withColumn("weight", weight)
    total = F.sum("weight")
    return rows.groupBy(*keys).agg(
        *((F.sum(F.when(c, F.col("weight")).otherwise(0.0)) / total).alias(name) for name, c in conditions.items())
    )


def central_interval(dist: Column, mass: float = 0.8) -> Column:
    """struct<low, high>: where the mass from either end first reaches the tail (1 - mass) / 2; row-local."""
    tail = (1 - mass) / 2

    def ends(cdf: Column) -> Column:
        whole = F.element_at(cdf["upto"], -1)
        below = _count_where(F.slice(cdf["upto"], 2, F.size(cdf["values"])), lambda m: m < tail)  # values before the tail is reached
        upto = _count_where(cdf["upto"], lambda m: whole - m >= tail)  # values from which the upper tail is still reached
        return F.struct(F.get(cdf["values"], below).alias("low"), F.get(cdf["values"], upto - 1).alias("high"))

    return _bound(cumulative(dist), ends)


def chart_points(dist: Column, least: float = 0.0005) -> Column:
    """array<struct<x, y>> for a chart: probabilities in percent, those below ``least`` left out."""
    shown = F.filter(dist, lambda p: p["probability"] >= least)
    return F.transform(shown, lambda p: F.struct(p["value"].alias("x"), (p["probability"] * 100).alias("y")))


def scenario(
    margin: Column, total: Column, margin_std: Column, total_std: Column, *,
    qb_out: Column, qb_restricted: Column, qb_impact: Column, wind_delta: Column, roof_closed: Column, snap_share_delta: Column,
) -> Column:
    """struct<margin, total, margin_std, total_std> under an exploratory what-if.

    ``roof_closed`` NULL leaves the roof as it is; any change also widens both distributions.
    """
    impact = F.coalesce(qb_impact, F.lit(4.5))
    lost = F.when(qb_out, impact).when(qb_restricted, impact * 0.4).otherwise(0.0)
    lost_total = F.when(qb_out, 2.0).when(qb_restricted, 0.8).otherwise(0.0)
    roof = F.when(roof_closed.isNull(), 0.0).when(roof_closed, 0.8).otherwise(-0.4)
    active = qb_out | qb_restricted | (wind_delta != 0) | roof_closed.isNotNull() | (snap_share_delta != 0)
    wider = lambda sigma, by: sigma + F.when(active, by).otherwise(0.0)
    return F.struct(
        (margin - lost + snap_share_delta * 0.05).alias("margin"),
        (total - lost_total - wind_delta * 0.12 + roof).alias("total"),
        wider(margin_std, 0.6).alias("margin_std"),
        wider(total_std, 0.5).alias("total_std"),
    )


def weather_severity(wind: Column, precipitation: Column) -> Column:
    return F.when(wind >= 18, "HIGH").when((wind >= 12) | (precipitation > 0.4), "MODERATE").otherwise("LOW")


def weather_adjustment(wind: Column) -> Column:
    return -(wind - 8) * 0.12


def favours(value: Column, band: float = 0.3) -> Column:
    return F.when(value > band, "HOME").when(value < -band, "AWAY").otherwise("NEUTRAL")


def _column(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))
