"""Slate and exposure derivations used by displays and by the decision plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions import times

from pricewright.operators.lookups import unnest
from pricewright.operators.metrics import edge_tier
from pricewright.operators.pointintime import first_violation

OFFENSIVE_LINE = ("LT", "LG", "C", "RG", "RT")
DEGRADED = ("MISSING", "STALE", "CONFLICTING")


def injury_severity(impact: Column) -> Column:
    return F.when(impact > 2.5, "HIGH").when(impact > 1, "MODERATE").when(impact > 0, "LOW").otherwise("NONE")


def availability_summary(availability: DataFrame, keys: list[str], cutoff: Column | None = None) -> DataFrame:
    """Per key: worst loss and its severity, summed impact of doubtful players, uncertainty flags.

    With a cutoff only rows observed by then count, and ``late_at`` is the first later one, all in one aggregate.
    """
    usable = F.lit(True) if cutoff is None else F.coalesce(F.col("observed_at") <= cutoff, F.lit(False))
    p, impact = F.when(usable, F.col("active_probability")), F.col("impact")
    quarterback = (F.col("position") == "QB") & (p > 0.15) & (p < 0.85)
    uncertain = (p > 0.2) & (p < 0.9) & (impact >= 1.5)
    worst = F.greatest(F.coalesce(F.max((1 - p) * impact), F.lit(0.0)), F.lit(0.0))
    more = []
    if cutoff is not None:
        doubtful = F.struct(F.col("player_id"), F.col("position"), p.alias("active_probability"))
        more = [F.min_by(F.when(p < 0.9, doubtful), F.when(p < 0.9, F.col("seq"))).alias("doubtful"), first_violation(cutoff, F.col("observed_at"), F.col("seq")).alias("late_at")]
    return availability.groupBy(*keys).agg(
        worst.alias("worst_impact"),
        injury_severity(worst).alias("injury_severity"),
        F.coalesce(F.sum(F.when(p < 0.9, impact * (1 - p) * 0.4)), F.lit(0.0)).alias("availability_impact"),
        F.coalesce(F.bool_or(quarterback), F.lit(False)).alias("quarterback_unresolved"),
        F.coalesce(F.bool_or(uncertain), F.lit(False)).alias("injury_uncertain"),
        *more,
    )


def position_group(position: Column) -> Column:
    return F.when(position.isin(*OFFENSIVE_LINE), "OL").otherwise(position)


def injury_clusters(injuries: DataFrame, least: int = 2) -> DataFrame:
    """(team, position group, game) with at least ``least`` injuries."""
    return (
        injuries.groupBy("team_id", position_group(F.col("position")).alias("position_group"), "game_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def game_conflicts(injuries: DataFrame) -> DataFrame:
    """Per game whether any report warns of a conflict."""
    return injuries.groupBy("game_id").agg(F.bool_or(F.col("conflict_warning").isNotNull()).alias("any_conflict"))


def impacted_games(incidents: DataFrame) -> DataFrame:
    """One row per incident and game that it touches; an incident without games stays, with a null game."""
    return unnest(incidents, "impacted_game_ids", "game_id", outer=True).drop("impacted_game_ids")


def touching(incidents: DataFrame, game: Column) -> DataFrame:
    """Incidents that list a game."""
    return incidents.where(F.array_contains("impacted_game_ids", game))


def injury_highlights(rows: DataFrame) -> DataFrame:
    """0 to 4 highlight rows per injury, with a label each."""
    p = F.col("active_probability")
    found = F.array_compact(
        F.array(
            F.when((F.col("position") == "QB") & (p > 0.15) & (p < 0.85), "Quarterback uncertainty"),
            F.when(F.col("position").isin(*OFFENSIVE_LINE) & (p < 0.9), "Offensive-line continuity"),
            F.when(F.col("conflict_warning").isNotNull(), "Conflicting reports"),
            F.when((F.col("practice_wed") == "FULL") & (F.col("practice_thu") == "DNP"), "Practice-status deterioration"),
        )
    )
    return rows.withColumn("label", F.explode(found))


def indoor(roof: Column) -> Column:
    return roof.isin("DOME", "RETRACTABLE_CLOSED")


def weather_severity_for(roof: Column, severity: Column) -> Column:
    return F.when(indoor(roof), "NONE").otherwise(F.coalesce(severity, F.lit("MISSING")))


def slate_filter(
    status: str | None = None, market: str | None = None, min_edge_pct: float = 0.0, completeness: str | None = None,
    injury: str | None = None, weather: str | None = None, window: str | None = None, roof: str | None = None, side: str | None = None,
) -> Column:
    """Facets of the slate combined with AND; None leaves a facet out."""
    spread = F.coalesce(F.col("consensus_spread"), F.lit(0.0))
    facets = [
        (status, F.col("status") == status),
        (market, F.col("best_market").startswith(market or "")),
        (min_edge_pct or None, F.col("edge") * 100 >= min_edge_pct),
        (completeness, F.col("completeness") >= 0.9 if completeness == "HIGH" else F.col("completeness") < 0.9),
        (injury, F.col("injury_severity") == injury),
        (weather, F.col("weather_severity") == weather),
        (window, F.col("kickoff_window") == window),
        (roof, indoor(F.col("roof")) if roof == "INDOOR" else ~indoor(F.col("roof"))),
        (side, spread <= 0 if side == "FAVORITES" else spread > 0),
    ]
    out = F.lit(True)
    for given, condition in facets:
        if given is not None:
            out = out & condition
    return out


def performance_filter(
    statuses: tuple[str, ...] | None = None, market: str | None = None, tier: str | None = None, venue: str | None = None,
    side: str | None = None, horizon: str | None = None, data: str | None = None, week: int | None = None,
) -> Column:
    facets = [
        (statuses, F.col("status").isin(*(statuses or ()))),
        (market, F.col("market") == market),
        (tier, edge_tier(F.col("edge")) == tier),
        (venue, F.col("indoor") == (venue == "INDOOR")),
        (side, F.col("favorite") == (side == "FAVORITES")),
        (horizon, F.col("hours_before") < 24 if horizon == "<24h" else F.col("hours_before") >= 24),
        (data, F.col("completeness") >= 0.9 if data == "HIGH" else F.col("completeness") < 0.9),
        (week, F.col("week") == week),
    ]
    out = F.lit(True)
    for given, condition in facets:
        if given is not None:
            out = out & condition
    return out


def exposure(positions: DataFrame, *groupings: str) -> DataFrame:
    """Open stake by each grouping column in one pass: dimension, key, stake."""
    open_ = positions.where(F.col("result") == "PENDING")
    sets = open_.groupingSets([[F.col(g)] for g in groupings], *map(F.col, groupings)).agg(
        F.sum("stake").alias("stake"), *(F.grouping(g).alias(f"_{g}") for g in groupings)
    )
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g in groupings:
        name = F.when(F.col(f"_{g}") == 0, g).otherwise(name)
        key = F.when(F.col(f"_{g}") == 0, F.col(g).cast("string")).otherwise(key)
    return sets.select(name.alias("dimension"), key.alias("key"), F.col("stake"))


def portfolio(positions: DataFrame, keys: list[str], bankroll: float) -> DataFrame:
    """Open stake, its share of the bankroll, realised profit and counts."""
    pending = F.col("result") == "PENDING"
    open_stake = F.coalesce(F.sum(F.when(pending, F.col("stake"))), F.lit(0).cast("decimal(18,2)"))
    return positions.groupBy(*keys).agg(
        open_stake.alias("open_stake"),
        (open_stake.cast("double") / bankroll).alias("open_pct"),
        F.coalesce(F.sum(F.when(~pending, F.col("delta"))), F.lit(0).cast("decimal(18,2)")).alias("realized"),
        F.count_if(pending).alias("n_open"),
        F.count_if(~pending).alias("n_settled"),
    )


def components_disagree(components: DataFrame, key: str, over: float = 6.5) -> DataFrame:
    """Keys whose weighted, real components differ in margin by more than ``over`` points."""
    real = components.where((F.col("weight") > 0) & ~F.col("placeholder"))
    span = F.max("margin") - F.min("margin")
    return real.groupBy(key).agg((F.coalesce(span > over, F.lit(False)) & (F.count(F.lit(1)) >= 2)).alias("components_disagree"))


def of_week(games: DataFrame, season: int | None = None, week: int | None = None, limit: int | None = None) -> DataFrame:
    """Games of a season and week (None: of all), the earliest ``limit`` ones by kickoff, then id."""
    for column, wanted in (("season", season), ("week", week)):
        if wanted is not None:
            games = games.where(F.col(column) == wanted)
    return games if limit is None else games.orderBy("kickoff", "game_id").limit(limit)


#: What is done about a feed of each class.
RESOLUTIONS = (("MISSING", "FAILED"), ("STALE", "DEGRADED"), ("AGING", "INVESTIGATING"), ("CONFLICTING", "INVESTIGATING"))


def feed_health(records: DataFrame, clock: Column) -> DataFrame:
    """One row per known feed, also without records: class, last record, records, minutes since, games it fails, resolution.

    ``records``: feed, game_id, at, conflict; those after the clock don't count.  A feed with a record in
    conflict is CONFLICTING.  A game is impacted if its own latest record of the feed is stale or in conflict.
    Records are added up per feed and game first, so a feed with most of them is spread.
    """
    names = F.explode(F.array(*(F.struct(F.lit(f).alias("feed"), F.lit(float(a)).alias("aging"), F.lit(float(s)).alias("stale")) for f, a, s in times.FEED_THRESHOLDS)))
    known = records.sparkSession.range(1).select(names.alias("f")).select("f.*")
    by_game = records.where(F.col("at") <= clock).groupBy("feed", "game_id").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"))
    stale = F.element_at(F.create_map(*(F.lit(x) for f, _, s in times.FEED_THRESHOLDS for x in (f, float(s)))), F.col("feed"))
    fails = F.col("game_id").isNotNull() & (F.col("conflict") | (times.age_minutes(F.col("at"), clock) > stale))
    by_feed = by_game.where(F.col("feed").isin(*(f for f, _, _ in times.FEED_THRESHOLDS))).groupBy("feed").agg(
        F.max("at").alias("last_success_at"), F.sum("n").alias("records"), F.bool_or("conflict").alias("conflict"), F.count_if(fails).alias("impacted_games")
    )
    rows = known.join(by_feed, "feed", "left")
    rows = rows.withColumn("status", times.classify_freshness(F.col("last_success_at"), clock, F.col("aging"), F.col("stale"), F.coalesce("conflict", F.lit(False))))
    resolution = F.create_map(*(F.lit(x) for pair in RESOLUTIONS for x in pair))
    return rows.select(
        "feed", "status", "last_success_at", F.coalesce("records", F.lit(0)).alias("records"), times.age_minutes(F.col("last_success_at"), clock).alias("freshness_minutes"),
        F.coalesce("impacted_games", F.lit(0)).alias("impacted_games"), F.coalesce(F.try_element_at(resolution, F.col("status")), F.lit("OK")).alias("resolution"),
    )
