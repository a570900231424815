"""Guard of updates in a stream: a settled bet may change only shortly after a CORRECTED event of the same bet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.operators.guards import CORRECTION_MINUTES, FROZEN


def update_violations(old: DataFrame, updates: DataFrame, events: DataFrame, delay: str = "1 hour", key: str = "bet_id") -> DataFrame:
    """Updates that are not allowed, as a stream: the update's columns, ``changed`` and ``violation``.

    ``old`` is a table; ``updates`` (with updated_at) and ``events`` (key, event_type, created_at) are streams in
    any order, as long as no row is later than ``delay`` behind the latest of its stream.  A changed identity of a
    pending bet shows at once.  A changed settled bet is joined with corrections by an interval of
    time, with watermarks on both sides: once they have passed it, an update that met no correction is a violation and its
    state goes.  To close the streams, let both send a row of a later time for a bet that ``old`` doesn't have (on the
    side of events a CORRECTED one); filters on null keys are pushed below the watermark, so the key must not be null.
    """
    frozen = [c for c in FROZEN if c in old.columns]
    was = old.select(F.col(key).alias("_bet"), *(F.col(c).alias(f"_old_{c}") for c in (*frozen, "result")))
    timed = updates.withWatermark("updated_at", delay)
    joined = timed.join(was, F.col(key) == F.col("_bet"))
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    identity = F.array_compact(F.array(*(F.when(changed(c), c) for c in frozen)))
    pending = joined.where(F.col("_old_result") == "PENDING").select(*updates.columns, identity.alias("changed")).where(F.size("changed") > 0)
    fixes = events.where(F.col("event_type") == "CORRECTED").select(F.col(key).alias("_key"), F.col("created_at").alias("_at")).withWatermark("_at", delay)
    settled = joined.where((F.col("_old_result") != "PENDING") & changed("result")).select(*updates.columns)
    in_time = (
        (F.col(key) == F.col("_key"))
        & (F.col("_at") <= F.col("updated_at"))
        & (F.col("_at") >= F.col("updated_at") - F.expr(f"INTERVAL {CORRECTION_MINUTES} MINUTES"))
    )
    alone = settled.join(fixes, in_time, "left_outer").where(F.col("_key").isNull())
    return pending.withColumn("violation", F.lit("identity changed")).unionByName(
        alone.select(*updates.columns, F.array(F.lit("result")).alias("changed")).withColumn("violation", F.lit("settled without correction"))
    )
