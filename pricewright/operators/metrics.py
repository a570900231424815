"""Scoring, calibration and portfolio aggregates.

Undefined values (empty input, zero variance) are NULL.  Bins and slices come from a small
dimension by left join, so empty ones are still shown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.sources.scratch import written

EPSILON = 1e-12
#: Edge tiers with lower and upper bound.
EDGE_TIERS = (("<1%", None, 0.01), ("1–3%", 0.01, 0.03), ("≥3%", 0.03, None))
STATUSES = ("BET", "WATCH", "PASS", "DATA INCOMPLETE")


def log_loss_of(p: Column, y: Column) -> Column:
    """Log loss of one record."""
    clamped = F.when(p.isNotNull(), F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), p)))
    return F.when(y == 1, -F.log(clamped)).otherwise(-F.log(1 - clamped))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(log_loss_of(p, y))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def bin_index(p: Column, bins: int = 10) -> Column:
    """Equal-width half-open bins, the last one closed; out of range: NULL.

    Edges are compared as i / n, not by multiplying, so that a value on an edge is in its bin.
    """
    guess = F.floor(p * bins)
    edge = lambda i: i / F.lit(float(bins))
    fixed = F.when(p < edge(guess), guess - 1).when(p >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.when((p >= 0) & (p <= 1), F.least(fixed, F.lit(bins - 1))).cast("int")


def _bin_dimension(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high")
    )


def calibration_bins(df: DataFrame, p: str = "p", y: str = "outcome", bins: int = 10) -> DataFrame:
    """bin, low, high, n, mean_predicted (empty: midpoint), observed (empty: NULL)."""
    grouped = (
        df.groupBy(bin_index(F.col(p), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.avg(F.col(y).cast("double")).alias("observed"))
        .where(F.col("bin").isNotNull())
    )
    return _bin_dimension(df, bins).join(grouped, "bin", "left").select(
        "bin",
        "low",
        "high",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("mean", (F.col("low") + F.col("high")) / 2).alias("mean_predicted"),
        "observed",
    )


def expected_calibration_error(df: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "outcome", bins: int = 10) -> DataFrame:
    binned = df.groupBy(*keys, bin_index(F.col(p), bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy")
    )
    inside = F.col("_bin").isNotNull()
    gap = F.sum(F.when(inside, F.abs(F.col("sy") - F.col("sp"))))
    return binned.groupBy(*keys).agg(F.try_divide(gap, F.sum("n").cast("double")).alias("ece"))


def calibration_line(p: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of outcome on probability; NULL without two different probabilities."""
    defined = (F.count(p) >= 2) & (F.max(p) > F.min(p))
    slope = F.when(defined, F.regr_slope(y.cast("double"), p))
    return slope, F.when(defined, F.regr_intercept(y.cast("double"), p))


def metric_bundle(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All scalar metrics of each key in one aggregate.

    Needs p, outcome, edge, clv, stake, profit, push, within80.  Wagers are rows with a stake;
    the win rate leaves pushes out, the push rate is over all rows.
    """
    p, y = F.col("p"), F.col("outcome")
    wager, decided = F.col("stake") > 0, (F.col("stake") > 0) & ~F.col("push")
    staked, profit = F.sum(F.when(wager, F.col("stake"))), F.sum(F.when(wager, F.col("profit")))
    slope, intercept = calibration_line(p, y)
    of = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(
        log_loss(p, y).alias("log_loss"),
        brier(p, y).alias("brier"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        F.avg("clv").alias("mean_clv"),
        F.try_divide(profit.cast("double"), staked.cast("double")).alias("roi"),
        F.try_divide(F.count_if(decided & (y == 1)).cast("double"), F.count_if(decided).cast("double")).alias("win_rate"),
        of(F.col("push")).alias("push_rate"),
        F.avg("edge").alias("avg_edge"),
        F.count(F.lit(1)).alias("n_recs"),
        F.count_if(wager).alias("n_wagers"),
        F.coalesce(F.try_divide(staked.cast("double"), F.count_if(wager).cast("double")), F.lit(0.0)).alias("avg_stake"),
        of(F.col("within80")).alias("coverage80"),
    )


def edge_tier(edge: Column) -> Column:
    return F.when(edge < 0.01, EDGE_TIERS[0][0]).when(edge < 0.03, EDGE_TIERS[1][0]).when(edge >= 0.03, EDGE_TIERS[2][0])


def slices(df: DataFrame, slice_name: str, slice_value: Column, values: Sequence[str]) -> DataFrame:
    """slice, name, n, log_loss, brier, mean_clv, avg_edge for every value, also empty ones."""
    p, y = F.col("p"), F.col("outcome")
    grouped = df.groupBy(slice_value.alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        log_loss(p, y).alias("log_loss"),
        brier(p, y).alias("brier"),
        F.avg("clv").alias("mean_clv"),
        F.avg("edge").alias("avg_edge"),
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("name"))
    return names.join(grouped, "name", "left").select(
        F.lit(slice_name).alias("slice"), "name", F.coalesce("n", F.lit(0)).alias("n"), "log_loss", "brier", "mean_clv", "avg_edge"
    )


def slice_tables(df: DataFrame) -> DataFrame:
    """Edge tiers and statuses."""
    return slices(df, "edge", edge_tier(F.col("edge")), [t[0] for t in EDGE_TIERS]).unionByName(
        slices(df, "status", F.col("status"), STATUSES)
    )


# Ordered curves --------------------------------------------------------------------------


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, how=F.sum) -> DataFrame:
    """Adds a running aggregate in a total order within each key, for keys of moderate size: one task sees a whole key."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, how(value).over(rows))


def spread_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """Adds running sums and maxima (name: ("sum" or "max", value)) without one task seeing all rows of a key.

    Rows are dealt into ranges of key and order; what the ranges before hold of a key is added
    to (or compared with) the running value inside each one.  Only a row per range and key meets in one place.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    how = {"sum": F.sum, "max": F.max}
    given = df.withColumns({f"_v_{n}": value for n, (_, value) in values.items()})
    dealt = written(given.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range", *keys).agg(*(how[h](f"_v_{n}").alias(f"_t_{n}") for n, (h, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(how[h](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (h, _) in values.items()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"_i_{n}": how[h](f"_v_{n}").over(inside) for n, (h, _) in values.items()})
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(before, same)
    both = {n: F.coalesce(F.col(f"_b_{n}") + F.col(f"_i_{n}"), f"_i_{n}", f"_b_{n}") if h == "sum" else F.greatest(f"_b_{n}", f"_i_{n}") for n, (h, _) in values.items()}
    return joined.select(*df.columns, *(c.alias(n) for n, c in both.items()))


def bankroll_curve(df: DataFrame, keys: Sequence[str], order: Sequence[str], profit: str, start: float) -> DataFrame:
    """Balance after each record (``balance``), with point 0 the starting balance of every key."""
    points = spread_running(df.select(*keys, *order, profit), keys, order, {"_sum": ("sum", F.col(profit)), "point": ("sum", F.lit(1))})
    after = points.select(*keys, F.col("point").cast("int").alias("point"), (F.col("_sum") + start).cast("double").alias("balance"))
    origin = df.select(*keys).distinct().select(*keys, F.lit(0).alias("point"), F.lit(float(start)).alias("balance"))
    return origin.unionByName(after)


def drawdown_curve(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds peak so far and drawdown in percent of it (0 without a positive peak)."""
    peaks = spread_running(curve, keys, ["point"], {"peak": ("max", F.col("balance"))})
    down = (F.col("balance") - F.col("peak")) / F.when(F.col("peak") > 0, F.col("peak")) * 100
    return peaks.withColumn("drawdown_pct", F.coalesce(down, F.lit(0.0)))


def max_drawdown(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    return drawdown_curve(curve, keys).groupBy(*keys).agg((F.max(-F.col("drawdown_pct")) / 100).alias("max_drawdown"))


def folded_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], profit: str, start: float, ranges: int | None = None) -> DataFrame:
    """The largest drawdown of each key's balance, without its curve.

    Records are dealt once into ranges of key and order.  A range is summed up by its total and its highest
    running total; folded in order, these give the balance and the peak that every range starts from, and the
    deepest fall below the peak is found inside the ranges.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = df.select(*keys, *order, F.coalesce(F.col(profit), F.lit(0)).alias("_v")).repartitionByRange(ranges, *keys, *order)
    dealt = written(given.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_s", F.sum("_v").over(inside)).withColumn("_high", F.max("_s").over(inside))
    totals = local.groupBy("_range", *keys).agg(F.sum("_v").alias("_total"), F.max("_s").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_from", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    before = before.withColumn("_peak", F.greatest(F.lit(0), F.max(F.col("_from") + F.col("_top")).over(earlier)))
    before = before.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k_{k}") for k in keys), "_from", "_peak")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    balance = (F.col("_from") + F.col("_s") + start).cast("double")
    peak = (F.greatest("_peak", F.col("_from") + F.col("_high")) + start).cast("double")
    fall = F.coalesce((peak - balance) / F.when(peak > 0, peak), F.lit(0.0))
    return local.join(before, same).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown"))


def full_bundle(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: float) -> DataFrame:
    """``metric_bundle`` with the expected calibration error and the largest drawdown of each key."""
    out = metric_bundle(df, keys)
    for side in (expected_calibration_error(df, keys), folded_drawdown(df, keys, order, "profit", start)):
        out = out.join(side, list(keys), "left")
    return out


def global_running_sum(df: DataFrame, order: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Running sum over a whole table without one task seeing all rows."""
    return spread_running(df, [], [order], {name: ("sum", F.col(value))}, ranges)


def vintage_deltas(df: DataFrame, key: str, order: str, margin: str, probability: str) -> DataFrame:
    """Change against the vintage before: moved if over 0.5 points or 0.01 probability; first: baseline."""
    at = Window.partitionBy(key).orderBy(order)
    change = lambda c: F.col(c) - F.lag(c).over(at)
    rows = df.withColumn("margin_delta", change(margin)).withColumn("probability_delta", change(probability))
    note = (
        F.when(F.col("margin_delta").isNull(), "baseline")
        .when((F.abs("margin_delta") > 0.5) | (F.abs("probability_delta") > 0.01), "moved")
        .otherwise("stable")
    )
    return rows.withColumn("note", note)
