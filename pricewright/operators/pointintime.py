"""Point-in-time operators: nothing observed after a cutoff is ever used.

Cutoffs are literals, so they reach the scan as pushed filters.  "Latest" and "first" always
name a total order; the tie rule is an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: what every lookahead error ends with.
LOOKAHEAD = "Future information must never enter a historical prediction."


def usable_at(observed_at: Column, cutoff: Column) -> Column:
    """Observed no later than the cutoff (inclusive); a missing time is not usable."""
    return F.coalesce(observed_at <= cutoff, F.lit(False))


def filter_to_cutoff(df: DataFrame, cutoff: Column, at: str = "observed_at") -> DataFrame:
    return df.where(F.col(at) <= cutoff)


def forecast_usable(generated_at: Column, observed_at: Column, cutoff: Column) -> Column:
    """Both times must be known and no later than the cutoff."""
    return usable_at(generated_at, cutoff) & usable_at(observed_at, cutoff)


def model_usable(approved_at: Column, cutoff: Column) -> Column:
    return usable_at(approved_at, cutoff)


def result_usable(ended_at: Column, cutoff: Column) -> Column:
    return usable_at(ended_at, cutoff)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key that is last in ``order``; one hash aggregate, no sort of groups."""
    return _extreme(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return _extreme(df, keys, order, F.min_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)))
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("row"))
    return out.select(*keys, "row.*").select(*df.columns)


def latest_at_cutoff(df: DataFrame, keys: Sequence[str], cutoff: Column, at: str = "observed_at", id_col: str = "id") -> DataFrame:
    """Latest usable row of each key; of equal times the greatest id (missing: empty string)."""
    return latest_by(filter_to_cutoff(df, cutoff, at), keys, [at, F.coalesce(F.col(id_col).cast("string"), F.lit(""))])


def latest_snapshot(df: DataFrame, keys: Sequence[str], cutoff: Column | None = None, at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """Latest row of each key; of equal times the last in input order (``seq``)."""
    return latest_by(df if cutoff is None else filter_to_cutoff(df, cutoff, at), keys, [at, seq])


def opening_snapshot(df: DataFrame, keys: Sequence[str], cutoff: Column | None = None, at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """First row in input order, of the rows flagged ``is_opening`` where there is such a flag."""
    opening = df.where("is_opening") if "is_opening" in df.columns else df
    return first_by(opening if cutoff is None else filter_to_cutoff(opening, cutoff, at), keys, [seq])


def latest_manual_price(df: DataFrame, cutoff: Column | None = None, match_line: bool = False) -> DataFrame:
    """Latest confirmed entry per (game, market, selection), and per line if ``match_line``."""
    keys = ["game_id", "market", "selection", *["line"] * match_line]
    return latest_snapshot(df.where("confirmed"), keys, cutoff, "entered_at")


def lookahead_violations(df: DataFrame, cutoff: Column, at: str = "observed_at") -> DataFrame:
    """Rows observed after the cutoff; in a sound data set there are none."""
    return df.where(F.col(at) > cutoff)


def first_violation(cutoff: Column, at: Column, seq: Column, within: Column | bool = True) -> Column:
    """Aggregate: time of the first row in input order (of those ``within``) that is after the cutoff; else NULL."""
    late = (at > cutoff) & (within if isinstance(within, Column) else F.lit(within))
    return F.min_by(F.when(late, at), F.when(late, seq))


def violation_message(context: Column | str, key: Column, at: Column, cutoff: Column) -> Column:
    """What a lookahead error says; NULL if ``at`` is.  Times are shown as UTC to the millisecond."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    context = context if isinstance(context, Column) else F.lit(context)
    text = F.concat(context, F.lit(" for "), key.cast("string"), F.lit(": record observed at "), iso(at), F.lit(" is after prediction cutoff "), iso(cutoff), F.lit(". " + LOOKAHEAD))
    return F.when(at.isNotNull(), text)


def lookahead_by_key(df: DataFrame, keys: Sequence[str], cutoff: Column, context: str, at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """For each key with a violation, its first one in input order and a message."""
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    late = lookahead_violations(df, cutoff, at).groupBy(*keys).agg(F.min_by(F.col(at), F.col(seq)).alias("first_at"), F.count(F.lit(1)).alias("violations"))
    return late.withColumn("message", violation_message(context, name, F.col("first_at"), cutoff))


def assert_no_lookahead(df: DataFrame, cutoff: Column, context: str, at: str = "observed_at") -> DataFrame:
    """Strict form: evaluating the result fails on the first violation."""
    bad = F.raise_error(F.concat(F.lit(f"{context}: observed after the cutoff at "), F.col(at).cast("string")))
    return df.withColumn(at, F.when(F.col(at) > cutoff, bad.cast(df.schema[at].dataType)).otherwise(F.col(at)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, left_id: str, right_seq: str, prefix: str = "r_") -> DataFrame:
    """Each left row with the latest right row of its key observed no later than ``left_at``.

    Both sides are merged into one time line per key and the last right row is carried
    forward, so the work is one shuffle and sort on the key, however many rows a key has:
    no pair of rows is ever formed.  Left rows without a match stay, with nulls.
    """
    rest = [c for c in right.columns if c not in keys]
    marked = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(right_seq).cast("long").alias("_seq"), F.struct(*rest).alias("_row"))
    lines = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), F.struct(*(c for c in left.columns if c not in keys)).alias("_left"))
    merged = marked.unionByName(lines, allowMissingColumns=True)
    timeline = Window.partitionBy(*keys).orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(timeline)).where("_side = 1")
    return carried.select(*keys, "_left.*", *(F.col(f"_row.{c}").alias(prefix + c) for c in rest))


def prediction_as_of_guard(as_of: Column, now: Column, tolerance_minutes: int = 1) -> Column:
    """Write-time check: as-of may be at most a minute after now."""
    return F.coalesce(as_of <= now + F.make_interval(mins=F.lit(tolerance_minutes)), F.lit(False))
