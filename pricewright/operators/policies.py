"""Row policies as data, compiled to filters and semi-joins for reading and writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Who may do what to the rows of each user-owned table.  A rule is "own" (the column holds the user),
#: "own or none" (or nobody), "child" (the bet that the column names is the user's), "own and confirmed".
OWNED = """
users | select | own | id
users | update | own | id
users | insert | own | id
user_settings | select | own | user_id
user_settings | insert | own | user_id
user_settings | update | own | user_id
user_settings | delete | own | user_id
manual_book_prices | select | own | user_id
manual_book_prices | insert | own and confirmed | user_id
bankroll_accounts | select | own | user_id
bankroll_accounts | insert | own | user_id
bankroll_accounts | update | own | user_id
bankroll_transactions | select | own | user_id
bankroll_transactions | insert | own | user_id
bets | select | own | user_id
bets | insert | own | user_id
bets | update | own | user_id
bet_events | select | child | bet_id
bet_events | insert | child | bet_id
settlements | select | child | bet_id
settlements | insert | child | bet_id
exposure_snapshots | select | own | user_id
exposure_snapshots | insert | own | user_id
recommendations | select | own or none | user_id
recommendations | insert | own | user_id
audit_log | select | own | user_id
audit_log | insert | own | user_id
"""
#: Tables that every signed-in user may read and none may write.
SHARED = (
    "providers", "ingestion_runs", "raw_objects", "source_records", "entity_mappings", "teams", "players", "stadiums", "officials", "games", "game_officials",
    "roster_snapshots", "depth_chart_snapshots", "participation", "injury_reports", "player_availability_snapshots", "weather_snapshots", "odds_snapshots",
    "feature_sets", "game_feature_snapshots", "model_versions", "calibration_models", "predictions", "prediction_components", "model_evaluations", "data_quality_events",
)
COMMANDS = ("select", "insert", "update", "delete")


@dataclass(frozen=True)
class Policy:
    table: str
    command: str
    rule: str
    column: str | None


def policies() -> dict[tuple[str, str], Policy]:
    """The policy of each table and command that has one; what has none is denied."""
    rows = [Policy(*(part.strip() for part in line.split("|"))) for line in OWNED.strip().split("\n")]
    rows += [Policy(t, "select", "signed in", None) for t in SHARED]
    return {(p.table, p.command): p for p in rows}


def policy_table(spark) -> DataFrame:
    return spark.createDataFrame([(p.table, p.command, p.rule, p.column) for p in policies().values()], "table string, command string, rule string, column string")


def allowed(rows: DataFrame, table: str, user: object | None, command: str = "select", bets: DataFrame | None = None, owner: str | None = None, bet_key: str = "bet_id", confirmed: str = "confirmed_visible") -> DataFrame:
    """Rows that a policy lets through: those to be seen for "select", those that may be written for other commands.

    ``user`` None is nobody signed in and passes no policy.  ``bets`` (bet_key, user_id) are the parents of child
    rows, reduced to the user's before the semi-join.  ``owner`` names the policy's column where a view calls
    it otherwise.  Comparisons are with the bare column, so they reach the scan as pushed filters.
    """
    policy = policies().get((table, command))
    if command not in COMMANDS:
        raise ValueError(f"no command {command}")
    if policy is None or user is None:
        return rows.where(F.lit(False))
    if policy.rule == "signed in":
        return rows
    column = F.col(owner or policy.column)
    if policy.rule == "child":
        if bets is None:
            raise ValueError(f"rows of {table} belong to bets, which are needed")
        mine = bets.where(F.col("user_id") == user).select(F.col(bet_key).alias("_mine")).distinct()
        return rows.join(mine, column == F.col("_mine"), "left_semi")
    return rows.where(_own(policy.rule, column, user, confirmed))


def _own(rule: str, column: Column, user: object, confirmed: str) -> Column:
    own = column == user
    return {"own": own, "own or none": own | column.isNull(), "own and confirmed": own & F.col(confirmed)}[rule]


def refused(rows: DataFrame, key: str, table: str, user: object | None, command: str, **more) -> DataFrame:
    """Rows that a policy does not let a user write."""
    return rows.join(allowed(rows, table, user, command, **more).select(F.col(key).alias("_passed")).distinct(), F.col(key).eqNullSafe(F.col("_passed")), "left_anti")
