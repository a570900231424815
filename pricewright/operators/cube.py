"""Performance metrics from sums per combination of facets, so that any filter is answered without the records.

A cell holds what its records add to every metric: counts, sums, sums of products and sums per bin of probability.
Cells of two days or two tables merge by adding up, and every metric that does not depend on the order of records
follows from the sums (a drawdown does depend on it and is not among them).  There are as many cells as
combinations of facets, at most 4 * 3 * 3 * 2 * 2 * 2 * 2 * 18 and those with a missing facet, whatever the number of records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.operators import metrics

#: The facets and how a record's columns give them.
FACETS = ("status", "market", "tier", "venue", "side", "horizon", "data", "week")
BINS = 10
#: Sums are merged by adding up, but for these.
_LEAST, _MOST = "least_p", "most_p"


def facets() -> dict[str, Column]:
    either = lambda c, yes, no: F.when(c, yes).when(~c, no)
    return {
        "status": F.col("status"),
        "market": F.col("market"),
        "tier": metrics.edge_tier(F.col("edge")),
        "venue": either(F.col("indoor"), "INDOOR", "OUTDOOR"),
        "side": either(F.col("favorite"), "FAVORITES", "UNDERDOGS"),
        "horizon": either(F.col("hours_before") < 24, "<24h", "≥24h"),
        "data": either(F.col("completeness") >= 0.9, "HIGH", "LOW"),
        "week": F.col("week").cast("string"),
    }


def _terms() -> dict[str, Column]:
    """What one record adds to each sum."""
    p, y = F.col("p"), F.col("outcome")
    both = p.isNotNull() & y.isNotNull()
    wager, decided = F.col("stake") > 0, (F.col("stake") > 0) & ~F.col("push")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    loss, square = metrics.log_loss_of(p, y), (p - y) * (p - y)
    terms = {
        "n": F.lit(1).cast("long"), "loss": loss, "n_loss": one(loss.isNotNull()), "square": square, "n_square": one(square.isNotNull()),
        "n_both": one(both), "p": F.when(both, p), "y": F.when(both, y.cast("double")), "pp": F.when(both, p * p), "py": F.when(both, p * y),
        "clv": F.col("clv"), "n_clv": one(F.col("clv").isNotNull()), "edge": F.col("edge"), "n_edge": one(F.col("edge").isNotNull()),
        "n_wagers": one(wager), "staked": F.when(wager, F.col("stake")), "profit": F.when(wager, F.col("profit")),
        "n_decided": one(decided), "n_won": one(decided & (y == 1)), "n_push": one(F.col("push")), "n_within": one(F.col("within80")),
    }
    index = metrics.bin_index(p, BINS)
    for k in range(BINS):
        terms[f"p_{k}"], terms[f"y_{k}"] = F.when(index == k, p), F.when(index == k, y.cast("double"))
    return terms


def cells(records: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row per combination of facets (and of the columns ``more``, such as a day) with its sums; one hash aggregate."""
    terms = _terms()
    of = records.select(*more, *(c.alias(f) for f, c in facets().items() if f not in more), F.col("p").alias("_p"), *(c.alias(f"_{n}") for n, c in terms.items() if n != "p"), terms["p"].alias("_pb"))
    sums = [F.sum("_pb" if n == "p" else f"_{n}").alias(f"s_{n}") for n in terms]
    return of.groupBy(*more, *FACETS).agg(*sums, F.min("_p").alias(_LEAST), F.max("_p").alias(_MOST))


def merged(some: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells added up to coarser keys."""
    sums = [F.sum(c).alias(c) for c in some.columns if c.startswith("s_")]
    return some.groupBy(*keys).agg(*sums, F.min(_LEAST).alias(_LEAST), F.max(_MOST).alias(_MOST))


def by_facet(some: DataFrame) -> DataFrame:
    """Cells added up to facet and value, for every value of every facet."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FACETS))).alias("of")
    values = [c for c in some.columns if c.startswith("s_")]
    return merged(some.select(pairs, *values, _LEAST, _MOST).select("of.*", *values, _LEAST, _MOST), ["facet", "value"])


def matching(statuses: Sequence[str] | None = None, **wanted: str | int | None) -> Column:
    """Cells that any of the eight filters lets through; None lets all through."""
    out = F.lit(True) if statuses is None else F.col("status").isin(*statuses)
    for facet, value in wanted.items():
        if facet not in FACETS:
            raise ValueError(f"no facet {facet}")
        if value is not None:
            out = out & (F.col(facet) == str(value))
    return out


def metrics_of(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The metric bundle of each row of merged cells; undefined values are null."""
    s = lambda n: F.col(f"s_{n}").cast("double")
    ratio = lambda a, b: F.try_divide(a, b)
    across = s("n_both") * s("pp") - s("p") * s("p")
    defined = (s("n_both") >= 2) & (F.col(_MOST) > F.col(_LEAST))
    slope = F.when(defined, ratio(s("n_both") * s("py") - s("p") * s("y"), across))
    gap = sum((F.abs(F.coalesce(s(f"y_{k}") - s(f"p_{k}"), F.lit(0.0))) for k in range(BINS)), F.lit(0.0))
    return sums.select(
        *keys,
        ratio(s("loss"), s("n_loss")).alias("log_loss"), ratio(s("square"), s("n_square")).alias("brier"), ratio(gap, s("n")).alias("ece"),
        slope.alias("slope"), (ratio(s("y"), s("n_both")) - slope * ratio(s("p"), s("n_both"))).alias("intercept"),
        ratio(s("clv"), s("n_clv")).alias("mean_clv"), ratio(s("profit"), s("staked")).alias("roi"), ratio(s("n_won"), s("n_decided")).alias("win_rate"),
        ratio(s("n_push"), s("n")).alias("push_rate"), ratio(s("edge"), s("n_edge")).alias("avg_edge"), F.col("s_n").alias("n_recs"), F.col("s_n_wagers").alias("n_wagers"),
        F.coalesce(ratio(s("staked"), s("n_wagers")), F.lit(0.0)).alias("avg_stake"), ratio(s("n_within"), s("n")).alias("coverage80"),
    )
