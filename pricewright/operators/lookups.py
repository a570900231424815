"""Lookups against dimension tables, set membership, and dedupe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str], default: dict[str, Column] | None = None) -> DataFrame:
    """Left join that takes ``columns`` (dim name -> result name); misses get ``default``.

    No broadcast is forced: Spark broadcasts the dimension if its size is below the threshold.
    """
    default = default or {}
    side = dim.select(F.col(dim_key).alias("_key"), *(F.col(c).alias(f"_{n}") for c, n in columns.items()))
    out = df.join(side, F.col(key) == F.col("_key"), "left")
    values = [F.coalesce(F.col(f"_{n}"), default[n]).alias(n) if n in default else F.col(f"_{n}").alias(n) for n in columns.values()]
    return out.select(*df.columns, *values)


def with_prior_games(games: DataFrame, prior: DataFrame) -> DataFrame:
    """Current slate first, then earlier games it lacks."""
    return games.unionByName(prior.join(games.select("game_id"), "game_id", "left_anti"), allowMissingColumns=True)


def in_set(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def not_in_set(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def correlated_positions(recs: DataFrame, positions: DataFrame) -> DataFrame:
    """Recommendations with an open position on the same game in another market (moneyline excepted)."""
    side = positions.select(F.col("game_id").alias("_game"), F.col("market").alias("_market")).distinct()
    different = (F.col("game_id") == F.col("_game")) & (F.col("market") != F.col("_market"))
    return recs.where(F.col("market") != "MONEYLINE").join(side, different, "left_semi")


def last_write_wins(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def append_missing(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that does nothing on conflict: rows of ``new`` whose key doesn't exist yet, once each."""
    return existing.unionByName(not_in_set(new.dropDuplicates(list(keys)), existing, keys))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in order: each task keeps k, and only those are merged."""
    return df.orderBy(*order).limit(k)


def sorted_by(df: DataFrame, *columns: str, missing: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows in an order chosen by column names, descending where a name starts with ``-``; nulls last, or as ``missing`` says."""
    missing = missing or {}
    keys = []
    for c in columns:
        name = c.lstrip("-")
        key = F.coalesce(F.col(name), missing[name]) if name in missing else F.col(name)
        keys.append(key.desc_nulls_last() if c.startswith("-") else key.asc_nulls_last())
    return df.orderBy(*keys)


def ranked(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def unnest(df: DataFrame, array: str, alias: str, outer: bool = False) -> DataFrame:
    return df.withColumn(alias, (F.explode_outer if outer else F.explode)(array))
