"""Write guards, row visibility, and validation reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must not change while a bet is pending; bounds of a price form.
FROZEN = ("user_id", "game_id", "market", "selection", "line", "american", "stake", "placed_at")
MARKETS, SELECTIONS = ("SPREAD", "TOTAL", "MONEYLINE"), ("HOME", "AWAY", "OVER", "UNDER")
BOOK, MAX_FORM_AGE, CORRECTION_MINUTES = "bet365", 240, 5


def price_form_errors(df: DataFrame) -> DataFrame:
    """Adds errors: game, book, market, selection, line (half points), odds, age, confirmation."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    line, odds = F.col("line"), F.col("american").cast("double")
    checks = (
        ("game_id", bad(F.col("game_id").cast("string") != "")),
        ("book", bad(F.col("book") == BOOK)),
        ("market", bad(F.col("market").isin(*MARKETS))),
        ("selection", bad(F.col("selection").isin(*SELECTIONS))),
        ("line", line.isNotNull() & (line * 2 != F.floor(line * 2))),
        ("american", bad((odds == F.floor(odds)) & (F.abs(odds) >= 100))),
        ("age", bad(F.col("age_minutes").between(0, MAX_FORM_AGE))),
        ("confirmed", bad(F.col("confirmed"))),
    )
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(c, name) for name, c in checks))))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined rows with their errors."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def visible_to(df: DataFrame, user: str, owner: str = "user_id", shared: bool = False) -> DataFrame:
    """Owner-only rows; ``shared`` also shows rows without an owner."""
    own = F.col(owner) == user
    return df.where(own | F.col(owner).isNull() if shared else own)


def visible_children(df: DataFrame, parents: DataFrame, user: str, key: str, owner: str = "user_id") -> DataFrame:
    """Rows whose parent belongs to the user."""
    return df.join(parents.where(F.col(owner) == user).select(key).distinct(), key, "left_semi")


def update_violations(old: DataFrame, new: DataFrame, events: DataFrame, key: str = "bet_id") -> DataFrame:
    """Updates that are not allowed: changed identity while pending, or a changed settled bet
    without a CORRECTED event within the last minutes before the update (``updated_at``)."""
    frozen = [c for c in FROZEN if c in old.columns]
    renamed = old.select(key, *(F.col(c).alias(f"old_{c}") for c in (*frozen, "result")))
    joined = new.join(renamed, key)
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    identity = F.array_compact(F.array(*(F.when(changed(c), c) for c in frozen)))
    fixes = events.where(F.col("event_type") == "CORRECTED").select(F.col(key).alias("_key"), F.col("created_at").alias("_at"))
    in_time = (
        (F.col(key) == F.col("_key"))
        & (F.col("_at") <= F.col("updated_at"))
        & (F.col("_at") >= F.col("updated_at") - F.make_interval(mins=F.lit(CORRECTION_MINUTES)))
    )
    pending = joined.where(F.col("old_result") == "PENDING").select(*new.columns, identity.alias("changed")).where(F.size("changed") > 0)
    settled = joined.where((F.col("old_result") != "PENDING") & changed("result")).join(fixes, in_time, "left_anti")
    return pending.withColumn("violation", F.lit("identity changed")).unionByName(
        settled.select(*new.columns, F.array(F.lit("result")).alias("changed")).withColumn("violation", F.lit("settled without correction"))
    )


def mutated_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of an append-only table whose row has gone or changed since ``before``."""
    digest = lambda df: F.xxhash64(*(F.col(c) for c in sorted(df.columns) if c != key))
    now = after.select(key, digest(after).alias("now"))
    joined = before.select(key, digest(before).alias("was")).join(now, key, "left")
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "updated")
    return joined.select(key, kind.alias("mutation")).where(F.col("mutation").isNotNull())


def constraint_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """rows and failures of every named check, in one pass; a NULL check passes, as in SQL."""
    failed = df.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()), F.count(F.lit(1)).alias("_rows"))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks))
    return failed.select(F.explode(pairs).alias("x"), F.col("_rows").alias("rows")).select("x.check", "rows", "x.failures")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent; a NULL key needs none."""
    side = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return df.where(F.col(key).isNotNull()).join(side, F.col(key) == F.col("_parent"), "left_anti")


def real_mode_errors(loss_budget: Column, acknowledged: Column) -> Column:
    """What is missing before real tracking, the first of which is shown."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(loss_budget > 0, F.lit(False)), "Set a positive monthly loss budget before enabling real tracking."),
            F.when(~F.coalesce(acknowledged, F.lit(False)), "You must acknowledge the risk statement."),
        )
    )
