"""As-of joins on one and on two time axes whose work is split within a key.

A key's time line is cut into ranges.  Each range carries its last row within itself; what earlier ranges hold
reaches it as one row per key and range.  So a key with half of all rows is spread over as many tasks as there are
ranges, and no pair of rows is formed.

On two axes a row must be valid by then *and* known by then.  Rows are numbered by when they became known, within
ranges of that axis; "known by then" is a prefix of those numbers, and every prefix is a union of a few dyadic blocks
(those of its set bits).  Each row goes into the blocks that contain it, about half a logarithm of them, and in
each block the question is one as-of lookup by valid time again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most ranges of an axis; their bounds are literals of the plan.
MAX_RANGES = 512


def time_cuts(df: DataFrame, at: str, rows_per_range: int = 1_000_000) -> list[int]:
    """Bounds (microseconds) that cut the rows into ranges of about that many rows; at most MAX_RANGES - 1 of them."""
    micros = df.select(F.unix_micros(F.col(at).cast("timestamp")).alias("at")).where("at IS NOT NULL")
    ranges = min(MAX_RANGES, -(-micros.count() // max(1, rows_per_range)))
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    return sorted({int(x) for x in micros.approxQuantile("at", shares, 1 / (4 * ranges))})


def range_of(at: Column, cuts: Sequence[int]) -> Column:
    """Number of bounds that are no later than ``at``, by halving."""
    micros = F.unix_micros(at.cast("timestamp"))

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(micros >= cuts[middle], pick(middle + 1, high)).otherwise(pick(low, middle))

    return pick(0, len(cuts)).cast("int")


def asof_join_split(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_order: Sequence[str], prefix: str = "r_", cuts: Sequence[int] = ()
) -> DataFrame:
    """Each left row with the latest right row of its key no later than ``left_at``; of equal times the last by ``right_order``.

    ``cuts`` (see ``time_cuts``) split the time line of every key.  Left rows without a match stay, with nulls; null
    keys match each other; right rows without a time match nothing.
    """
    rest = [c for c in right.columns if c not in keys]
    order = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(right_order)))
    kind = right.select(order.alias("o")).schema["o"].dataType
    known = right.where(F.col(right_at).isNotNull())
    marked = known.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), order.alias("_order"), F.struct(*rest).alias("_row"))
    lines = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_order"), F.struct(*(c for c in left.columns if c not in keys)).alias("_left"))
    merged = marked.unionByName(lines, allowMissingColumns=True).withColumn("_range", range_of(F.col("_at"), cuts))
    timeline = Window.partitionBy(*keys, "_range").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(timeline)).where("_side = 1 AND _left IS NOT NULL")
    if cuts:
        latest = F.max_by(F.when(F.col("_side") == 0, F.col("_row")), F.when(F.col("_side") == 0, F.struct("_at", "_order")))
        ranges = merged.groupBy(*keys, "_range").agg(latest.alias("_row"))
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_range").alias("_of"), F.last("_row", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
        same = F.col("_range") == F.col("_of")
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
        carried = carried.join(ranges, same, "left").withColumn("_row", F.coalesce("_row", "_before"))
    row = F.when(F.col(f"_left.{left_at}").isNotNull(), F.col("_row"))
    return carried.select(*keys, "_left.*", *(row[c].alias(prefix + c) for c in rest))


def bitemporal_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_valid: str, left_known: str, right_valid: str, right_known: str, left_id: str, right_seq: str,
    prefix: str = "r_", valid_cuts: Sequence[int] = (), known_cuts: Sequence[int] = (),
) -> DataFrame:
    """Each left row with the right row of its key that is valid latest, of those valid by ``left_valid`` and known by ``left_known``.

    Of equal valid times the one known last counts, then the greatest ``right_seq``.  ``left_id`` is unique among
    left rows.  Left rows without a match stay, with nulls, as do those without one of the two times; right rows
    without one of them match nothing, null keys match each other.  ``valid_cuts`` and ``known_cuts`` (see
    ``time_cuts``) split the work within a key on both axes.
    """
    rest = [c for c in right.columns if c not in keys]
    rows = right.where(F.col(right_valid).isNotNull() & F.col(right_known).isNotNull())
    rows = rows.select(*keys, F.col(right_known).alias("_known"), F.lit(0).alias("_side"), F.struct(*rest).alias("_row"))
    asks = left.select(*keys, F.col(left_known).alias("_known"), F.lit(1).alias("_side"), F.struct(*(c for c in left.columns if c not in keys)).alias("_left"))
    merged = rows.unionByName(asks, allowMissingColumns=True).withColumn("_range", range_of(F.col("_known"), known_cuts))
    group = Window.partitionBy(*keys, "_range")
    isright = (F.col("_side") == 0).cast("long")
    upto = F.sum(isright).over(group.orderBy("_known", "_side").rowsBetween(Window.unboundedPreceding, 0))
    numbered = merged.withColumns({"_upto": upto, "_total": F.sum(isright).over(group)})
    bits = max(1, len(known_cuts).bit_length())
    number = F.col("_upto") - 1
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.col("_total"), F.lit(1)))) - 1)
    coarse = F.sequence(F.lit(0), F.lit(bits - 1))
    node = lambda of, level, block: F.struct(of.alias("range"), level.alias("level"), block.cast("long").alias("block"))
    shifted = lambda x, level: F.floor(x / F.pow(F.lit(2), level)).cast("long")
    even = lambda x: lambda level: shifted(x, level) % 2 == 0
    odd = lambda x: lambda level: shifted(x, level) % 2 == 1
    everywhere, place = F.lit(-1), F.col("_range").cast("long")
    of_right = F.concat(
        F.transform(F.filter(levels, even(number)), lambda level: node(F.col("_range"), level, shifted(number, level))),
        F.transform(F.filter(coarse, even(place)), lambda level: node(everywhere, level, shifted(place, level))),
    )
    of_left = F.concat(
        F.transform(F.filter(levels, odd(F.col("_upto"))), lambda level: node(F.col("_range"), level, shifted(F.col("_upto"), level) - 1)),
        F.transform(F.filter(coarse, odd(place)), lambda level: node(everywhere, level, shifted(place, level) - 1)),
    )
    placed = numbered.withColumn("_node", F.when(F.col("_side") == 0, of_right).otherwise(of_left))
    candidates = placed.where("_side = 0").select(*keys, F.explode("_node").alias("_node"), "_row.*")
    asked = placed.where("_side = 1").withColumn("_node", F.when(F.col("_known").isNotNull() & F.col(f"_left.{left_valid}").isNotNull(), F.col("_node")))
    asked = asked.select(*keys, F.explode_outer("_node").alias("_node"), "_left.*")
    alone = asked.where("_node IS NULL").drop("_node")
    found = asof_join_split(asked.where("_node IS NOT NULL"), candidates, [*keys, "_node"], left_valid, right_valid, [right_known, right_seq], "_r_", valid_cuts)
    hit = F.struct(*(F.col(f"_r_{c}").alias(c) for c in rest))
    best = F.max_by(hit, F.when(F.col(f"_r_{right_valid}").isNotNull(), F.struct(*(F.col(f"_r_{c}") for c in (right_valid, right_known, right_seq)))))
    own = [c for c in left.columns if c != left_id]
    joined = found.groupBy(left_id).agg(F.any_value(F.struct(*own)).alias("_own"), best.alias("_hit"))
    joined = joined.select(left_id, "_own.*", *(F.col(f"_hit.{c}").alias(prefix + c) for c in rest)).select(*left.columns, *(prefix + c for c in rest))
    return joined.unionByName(alone.select(*left.columns), allowMissingColumns=True)
