"""Query catalogue: every query is a function of (spark, folder of base tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import distributions as dist
from pricewright.functions import odds, text, times
from pricewright.operators import bitemporal, cube, digests, guards, ledger, lookups, metrics, policies, slate, staking
from pricewright.operators import pointintime as pit
from pricewright.plans import slate as plan
from pricewright.sources.reference import stadiums, teams
from pricewright.sources.scratch import folder
from pricewright.sources.state import export_state, parsed_state, read_prices, submit_prices
from pricewright.sources.tables import BANKROLL, Tables, cutoff, now

Query = Callable[[SparkSession, str], DataFrame]
#: Quotes in the synthetic tables are days apart, so the slate accepts spread prices of this age.
PRICE_MINUTES = 5 * 24 * 60
START = 10_000.0

_QUERIES: dict[str, Query] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers a function of Tables under its own name."""
    _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


def queries() -> dict[str, Query]:
    from pricewright.plans import live  # noqa: F401  registers its queries, and needs this module

    return dict(_QUERIES)


def r6(c: Column | str) -> Column:
    """Displayed ratios are rounded to six places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Scans and scalar pricing ----------------------------------------------------------------


@query
def pricing_convert(t: Tables) -> DataFrame:
    a = F.col("home_american")
    rows = t.quotes.select("seq", "home_american", odds.american_to_decimal(a).alias("d"), odds.implied_probability(a).alias("p"))
    return rows.select(
        "seq", r6("d").alias("decimal"), r6("p").alias("implied"),
        odds.fair_american(F.col("p")).alias("fair"), odds.decimal_to_american(F.col("d")).alias("american"),
    )


@query
def novig_market(t: Tables) -> DataFrame:
    home, away = odds.no_vig(F.col("home_american"), F.col("away_american"))
    return t.quotes.select("seq", r6(home).alias("home"), r6(away).alias("away"), r6(odds.overround(F.col("home_american"), F.col("away_american"))).alias("overround"))


@query
def breakeven_ev_kelly(t: Tables) -> DataFrame:
    p, a, q = F.col("p"), F.col("american"), F.when(F.col("push"), 0.05).otherwise(0.0)
    return t.forecasts.select(
        "seq", r6(odds.break_even(a, q)).alias("break_even"), r6(odds.expected_value(p, a, q)).alias("ev"),
        r6(odds.full_kelly(p, a, q)).alias("kelly"), r6(odds.fractional_kelly(p, a, 0.25, q)).alias("quarter_kelly"),
        r6(odds.edge(p, odds.break_even(a, q))).alias("edge"),
    )


@query
def slate_games(t: Tables) -> DataFrame:
    """Games of a slate with labels: two lookups of the team dimension, one of models."""
    rows = _labelled(t, t.games.join(t.predictions.select("game_id", "model_id"), "game_id", "left"))
    return rows.select(
        "game_id", text.game_label(F.col("away"), F.col("home"), F.col("game_id")).alias("label"),
        text.long_game_label(F.col("away_name"), F.col("home_name"), F.col("game_id")).alias("long_label"), "home_name", text.roof_label(F.col("roof")).alias("roof_label"), "model",
    )


def _labelled(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` with short and full names of both teams, and the model's label and time of approval."""
    d = teams(t.spark)
    rows = lookups.lookup(rows, d, "home_team", "team_id", {"abbreviation": "home", "name": "home_name"})
    rows = lookups.lookup(rows, d, "away_team", "team_id", {"abbreviation": "away", "name": "away_name"})
    rows = lookups.lookup(rows, t.models, "model_id", "model_id", {"name": "model_name", "version": "version", "approved_at": "approved_at"})
    return rows.withColumn("model", text.model_label(F.col("model_name"), F.col("version"), F.col("model_id"))).drop("model_name", "version")


# Point in time ---------------------------------------------------------------------------


@query
def asof_filter(t: Tables) -> DataFrame:
    return pit.filter_to_cutoff(t.quotes, cutoff()).select("seq", "game_id", "market", "line")


@query
def latest_quote(t: Tables) -> DataFrame:
    rows = pit.latest_snapshot(t.quotes, ["game_id", "market"], cutoff())
    return rows.select("game_id", "market", "seq", "line", "home_american")


@query
def latest_record(t: Tables) -> DataFrame:
    """Latest record of a feed by day, ties to the greatest id."""
    rows = t.feed_log.select("feed", F.date_trunc("day", "observed_at").alias("observed_at"), F.col("seq").cast("string").alias("id"))
    return pit.latest_at_cutoff(rows, ["feed"], cutoff()).select("feed", "id")


@query
def opening_quote(t: Tables) -> DataFrame:
    return pit.opening_snapshot(t.quotes, ["game_id", "market"], cutoff()).select("game_id", "market", "seq", "line")


@query
def opening_flagged(t: Tables) -> DataFrame:
    """Opening quotes where the feed flags them: the first flagged one, never an earlier one without the flag."""
    flagged = t.quotes.withColumn("is_opening", F.col("seq") % 4 == 1)
    return pit.opening_snapshot(flagged, ["game_id", "market"], cutoff()).select("game_id", "market", "seq", "line")


@query
def manual_price_latest(t: Tables) -> DataFrame:
    return pit.latest_manual_price(t.manual_prices, now()).select("game_id", "market", "selection", "seq", "american")


@query
def asof_join_quotes(t: Tables) -> DataFrame:
    """Each error event with the latest spread quote of its game at that moment."""
    probes = t.base("events").where("event_type = 'error'").select(F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("probe"))
    spreads = t.quotes.where("market = 'SPREAD'").select("game_id", "observed_at", "seq", "line")
    return pit.asof_join(probes, spreads, ["game_id"], "at", "observed_at", "probe", "seq").select("probe", "game_id", F.col("r_seq").alias("quote_seq"), F.col("r_line").alias("line"))


def _probes(t: Tables) -> DataFrame:
    return t.base("events").where("event_type = 'error'").select(F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("probe"))


@query
def asof_join_split(t: Tables) -> DataFrame:
    """Each error event with the latest spread quote of its game, time lines cut into ranges of a thousand quotes."""
    spreads = t.quotes.where("market = 'SPREAD'").select("game_id", "observed_at", "seq", "line")
    cuts = bitemporal.time_cuts(spreads, "observed_at", 1000)
    rows = bitemporal.asof_join_split(_probes(t), spreads, ["game_id"], "at", "observed_at", ["seq"], cuts=cuts)
    return rows.select("probe", "game_id", F.col("r_seq").alias("quote_seq"), F.col("r_line").alias("line"))


@query
def bitemporal_quotes(t: Tables) -> DataFrame:
    """Each error event with the quote of its market group that was valid latest, of those ingested by then.

    A quote is ingested up to four days after it was observed; half of all quotes belong to one group.
    """
    group = lambda c: F.when(F.col(c) % 2 == 0, 0).otherwise(F.col(c) % 50)
    late = F.timestamp_micros(F.unix_micros("observed_at") + F.col("seq") % 97 * 3_600_000_000)
    quotes = t.quotes.select(group("game_id").alias("grp"), "observed_at", late.alias("ingested_at"), "seq", "line")
    asks = _probes(t).select(group("game_id").alias("grp"), "at", F.col("at").alias("known_at"), "probe")
    cuts = {"valid_cuts": bitemporal.time_cuts(quotes, "observed_at", 1000), "known_cuts": bitemporal.time_cuts(quotes, "ingested_at", 1000)}
    rows = bitemporal.bitemporal_join(asks, quotes, ["grp"], "at", "known_at", "observed_at", "ingested_at", "probe", "seq", **cuts)
    return rows.select("probe", "grp", F.col("r_seq").alias("quote_seq"), F.col("r_line").alias("line"))


@query
def lookahead_violations(t: Tables) -> DataFrame:
    return pit.lookahead_by_key(t.quotes, ["game_id"], cutoff(), "odds snapshots").select("game_id", "violations", "message")


@query
def usable_forecasts(t: Tables) -> DataFrame:
    """Model, forecast and result guards at the cutoff."""
    days = lambda n: F.col("approved_at") + F.make_dt_interval(days=F.lit(n))
    ended = F.when(F.col("game_id") % 3 != 0, days(16)).alias("ended_at")
    m = t.predictions.join(t.models, "model_id").select("game_id", "approved_at", days(17).alias("made_at"), ended)
    return m.select(
        "game_id", pit.model_usable(F.col("approved_at"), cutoff()).alias("model_ok"),
        pit.forecast_usable(F.col("made_at"), F.col("approved_at"), cutoff()).alias("forecast_ok"),
        pit.result_usable(F.col("ended_at"), cutoff()).alias("result_ok"),
        pit.prediction_as_of_guard(F.col("made_at"), cutoff()).alias("as_of_ok"),
    )


@query
def line_movement(t: Tables) -> DataFrame:
    return plan.moving_toward(t.quotes, cutoff()).select("game_id", "market", "toward_first", "toward_second", "line_move")


# Distributions ---------------------------------------------------------------------------


@query
def margin_distribution(t: Tables) -> DataFrame:
    rows = dist.long_margins(t.projection.select("part_id", "mu", "sd"), "mu", "sd")
    return rows.select("part_id", "value", r6("probability").alias("probability"))


@query
def spread_outcomes(t: Tables) -> DataFrame:
    rows = t.projection.withColumn("line", (F.col("part_id") % 15 - 7).cast("double") / 2)
    v, line = F.col("value"), F.col("line")
    weight = dist.normal_pdf(v, F.col("mu"), F.col("sd")) * dist.key_boost(v)
    out = dist.outcome_sums(rows, ["part_id"], weight, dist.margin_values(), {"cover": v + line > 1e-9, "push": F.abs(v + line) < 1e-9})
    return out.select("part_id", r6("cover").alias("cover"), r6("push").alias("push"), r6(F.greatest(F.lit(0.0), 1 - F.col("cover") - F.col("push"))).alias("lose"))


@query
def total_outcomes(t: Tables) -> DataFrame:
    """Row-local form: arrays of outcomes."""
    rows = t.projection.withColumn("d", dist.total_distribution(F.col("total"), F.col("sd")))
    o = dist.total_outcomes(F.col("d"), (F.col("part_id") % 17 + 36).cast("double"))
    return rows.select("part_id", o.alias("o")).select("part_id", r6("o.over").alias("over"), r6("o.push").alias("push"), r6("o.under").alias("under"))


@query
def win_probability(t: Tables) -> DataFrame:
    return t.projection.select("part_id", r6(dist.margin_to_win_probability(F.col("mu"))).alias("home_win"), r6(dist.normal_pdf(F.lit(0.0), F.col("mu"), F.col("sd"))).alias("density"))


@query
def key_number_mass(t: Tables) -> DataFrame:
    v = F.col("value")
    weight = dist.normal_pdf(v, F.col("mu"), F.col("sd")) * dist.key_boost(v)
    keys = {f"at_{k}": F.abs(v) == k for k in (3, 6, 7, 10)}
    out = dist.outcome_sums(t.projection, ["part_id"], weight, dist.margin_values(), {"home_win": v > 0, **keys})
    return out.select("part_id", *(r6(c).alias(c) for c in ("home_win", *keys)))


@query
def total_distribution(t: Tables) -> DataFrame:
    rows = dist.long_totals(t.projection.select("part_id", "total", "sd"), "total", "sd")
    return rows.select("part_id", "value", r6("probability").alias("probability"))


@query
def central_interval(t: Tables) -> DataFrame:
    interval = dist.central_interval(dist.margin_distribution(F.col("mu"), F.col("sd"))).alias("i")
    return t.projection.select("part_id", interval).select("part_id", "i.low", "i.high")


@query
def line_ladder(t: Tables) -> DataFrame:
    """Cover probability at fifteen candidate lines around each projection."""
    d = dist.margin_distribution(F.col("mu"), F.col("sd"))
    cover = lambda cdf, line: dist.spread_outcomes_at(cdf, line)["cover"]
    rows = t.projection.select("part_id", F.explode(dist.ladder(d, F.sequence(F.lit(-7), F.lit(7)), cover)).alias("x"))
    return rows.select("part_id", "x.line", r6("x.result").alias("cover"))


@query
def total_ladder(t: Tables) -> DataFrame:
    """Probability of the over at seventeen candidate totals."""
    d = dist.total_distribution(F.col("total"), F.col("sd"))
    over = lambda cdf, line: dist.total_outcomes_at(cdf, line)["over"]
    rows = t.projection.select("part_id", F.explode(dist.ladder(d, F.sequence(F.lit(37), F.lit(53)), over)).alias("x"))
    return rows.select("part_id", "x.line", r6("x.result").alias("over"))


@query
def distribution_points(t: Tables) -> DataFrame:
    """Chart points of the margin distribution."""
    points = dist.chart_points(dist.margin_distribution(F.col("mu"), F.col("sd")), 0.01)
    rows = t.projection.select("part_id", F.explode(points).alias("p"))
    return rows.select("part_id", "p.x", F.round("p.y", 4).alias("y"))


@query
def scenario_interval(t: Tables) -> DataFrame:
    """Text of the central 80 % of margin and total under a what-if."""
    s = dist.scenario(
        F.col("mu"), F.col("total"), F.col("sd"), F.col("sd"), qb_out=F.col("part_id") % 2 == 0, qb_restricted=F.lit(False), qb_impact=F.lit(None).cast("double"),
        wind_delta=F.lit(5.0), roof_closed=F.lit(None).cast("boolean"), snap_share_delta=F.lit(0.0),
    )
    rows = t.projection.select("part_id", s.alias("s"))
    margin = dist.central_interval(dist.margin_distribution(F.col("s.margin"), F.col("s.margin_std")))
    total = dist.central_interval(dist.total_distribution(F.col("s.total"), F.col("s.total_std")))
    rows = rows.select("part_id", margin.alias("m"), total.alias("t"))
    return rows.select("part_id", F.format_string("80%% margin %d to %d, total %d to %d", "m.low", "m.high", "t.low", "t.high").alias("text"))


@query
def display_factors(t: Tables) -> DataFrame:
    """Which side a projection favours, the adjustment for wind, and both prices of a two-way market."""
    wind = (F.col("part_id") % 30).cast("double")
    p = dist.margin_to_win_probability(F.col("mu"))
    return t.projection.select(
        "part_id", dist.favours(F.col("mu")).alias("favours"), r6(dist.weather_adjustment(wind)).alias("weather_adjustment"),
        odds.with_vig(p, 0.02).alias("price"), odds.second_price(F.lit(-115) + F.col("part_id") % 11).alias("second_price"),
    )


@query
def scenario_adjustments(t: Tables) -> DataFrame:
    k = F.col("part_id")
    s = dist.scenario(
        F.col("mu"), F.col("total"), F.col("sd"), F.col("sd") * 0.75, qb_out=k % 4 == 0, qb_restricted=k % 4 == 1,
        qb_impact=F.when(k % 3 != 0, (k % 7).cast("double")), wind_delta=(k % 5).cast("double"),
        roof_closed=F.when(k % 6 == 0, True).when(k % 6 == 1, False), snap_share_delta=(k % 11 - 5).cast("double"),
    )
    return t.projection.select("part_id", s.alias("s")).select("part_id", *(r6(f"s.{c}").alias(c) for c in ("margin", "total", "margin_std", "total_std")))


# Candidates, stakes, decisions -----------------------------------------------------------


@query
def candidates(t: Tables) -> DataFrame:
    rows = plan.candidates(t.quotes, t.predictions, t.manual_prices, now())
    return rows.select("game_id", "market", "selection", "line", "american", "manual_id", r6("model_p").alias("model_p"), r6("conservative_p").alias("conservative_p"), r6("edge").alias("edge"), r6("ev").alias("ev"), "fair_american")


@query
def best_candidate(t: Tables) -> DataFrame:
    rows = plan.best_candidates(t.quotes, t.predictions, t.manual_prices, now())
    return rows.select("game_id", "market", "selection", r6("edge").alias("edge"))


@query
def recommendations(t: Tables) -> DataFrame:
    rows = plan.evaluate(t, price_minutes=PRICE_MINUTES)
    return displayed(rows)


@query
def recommendations_feed_outage(t: Tables) -> DataFrame:
    """The same slate while the injury feed is missing."""
    feeds = t.spark.createDataFrame([("injury", "MISSING"), ("odds", "CURRENT")], "feed string, status string")
    return displayed(plan.evaluate(t, price_minutes=PRICE_MINUTES, feeds=feeds)).select("game_id", "status", "reasons")


def displayed(rows: DataFrame) -> DataFrame:
    ratios = ("model_p", "conservative_p", "market_p", "break_even_p", "edge", "ev", "push_p", "stake_pct")
    return rows.select(*(r6(c).alias(c) if c in ratios else F.col(c) for c in rows.columns))


@query
def top_picks(t: Tables) -> DataFrame:
    """The ten largest edges among recommendations that are bet or watched, ranked."""
    rows = plan.evaluate(t, price_minutes=PRICE_MINUTES).where(F.col("status").isin("BET", "WATCH"))
    rows = lookups.top_k(rows, 10, F.col("edge").desc(), F.col("game_id"))
    return lookups.ranked(rows.withColumn("all", F.lit(1)), ["all"], F.col("edge").desc(), F.col("game_id")).select(
        "rank", "game_id", text.pick_label(F.col("market"), F.col("selection"), F.col("team"), F.col("line")).alias("label"), text.confidence_label(F.col("confidence")).alias("confidence")
    )


@query
def watch_list(t: Tables) -> DataFrame:
    """Recommendations to watch, the largest edge first."""
    rows = plan.evaluate(t, price_minutes=PRICE_MINUTES).where(F.col("status") == "WATCH")
    return lookups.sorted_by(rows, "-edge", "game_id").select("game_id", "market", "selection", r6("edge").alias("edge"), "reasons")


@query
def slate_sorted(t: Tables) -> DataFrame:
    """The slate by kickoff, then by edge downwards."""
    rows = _slate(t)
    return lookups.sorted_by(rows, "kickoff", "-edge", "game_id").select("game_id", "kickoff", "kickoff_window", r6("edge").alias("edge"))


@query
def slate_rows(t: Tables) -> DataFrame:
    """Display rows of the slate that pass a filter: outdoor games with incomplete data."""
    rows = _slate(t).where(slate.slate_filter(roof="OUTDOOR", completeness="LOW"))
    return rows.select("game_id", "kickoff_window", "injury_severity", "weather_severity", r6("spread_diff").alias("spread_diff"), r6("total_diff").alias("total_diff"), "best_market")


@query
def slate_board(t: Tables) -> DataFrame:
    """The whole slate, with what is highlighted: differences from 1.5 and 2 points, an edge above 2 %."""
    rows = _slate(t)
    ratios = ("model_spread", "spread_diff", "model_total", "total_diff", "home_win", "edge")
    return rows.select(
        *(r6(c).alias(c) if c in ratios else F.col(c) for c in rows.columns),
        (F.abs("spread_diff") >= 1.5).alias("spread_stands_out"), (F.abs("total_diff") >= 2).alias("total_stands_out"), (F.col("edge") > 0.02).alias("edge_stands_out"),
    )


#: One choice for every facet of the slate.
FACETS = (
    {"status": "WATCH"}, {"market": "SPREAD"}, {"min_edge_pct": 1.0}, {"completeness": "HIGH"}, {"injury": "HIGH"}, {"weather": "MISSING"},
    {"window": "SUN_LATE"}, {"roof": "INDOOR"}, {"side": "FAVORITES"}, {"market": "TOTAL", "roof": "OUTDOOR", "side": "UNDERDOGS"},
)


@query
def slate_facets(t: Tables) -> DataFrame:
    """Games that pass each facet alone, and three of them together."""
    rows = _slate(t)
    return rows.agg(*(F.count_if(slate.slate_filter(**facet)).alias("_".join(facet)) for facet in FACETS))


def _slate(t: Tables) -> DataFrame:
    """Display row of every game; market, edge and status are those of its recommendation."""
    board = plan.board(t.quotes, now()).select("game_id", F.col("spread.line").alias("consensus_spread"), (F.col("total_quote.line") + plan.TOTAL_BASE).alias("consensus_total"))
    best = plan.evaluate(t, price_minutes=PRICE_MINUTES).select("game_id", F.concat_ws(" ", "market", "selection").alias("best_market"), "edge", "status")
    rows = _labelled(t, t.games.join(t.predictions, "game_id", "left"))
    rows = lookups.lookup(rows, stadiums(t.spark), "home_team", "team_id", {"stadium": "stadium"}, {"stadium": F.lit(text.MISSING)})
    for side in (board, best, slate.availability_summary(t.availability, ["game_id"]), pit.latest_snapshot(t.weather, ["game_id"]).select("game_id", "severity")):
        rows = rows.join(side, "game_id", "left")
    model_spread = 0 - F.col("mu")
    return rows.select(
        "game_id", "kickoff", times.kickoff_window(F.col("kickoff")).alias("kickoff_window"), "away", "home", "stadium", "roof",
        "consensus_spread", model_spread.alias("model_spread"), F.coalesce(model_spread - F.col("consensus_spread"), F.lit(0.0)).alias("spread_diff"),
        "consensus_total", F.col("total").alias("model_total"), F.coalesce(F.col("total") - F.col("consensus_total"), F.lit(0.0)).alias("total_diff"),
        "home_win", "best_market", "edge", "status",
        F.coalesce("injury_severity", F.lit("NONE")).alias("injury_severity"),
        slate.weather_severity_for(F.col("roof"), F.col("severity")).alias("weather_severity"),
        "completeness", (F.col("approved_at") + F.make_dt_interval(days=F.lit(17))).alias("prediction_at"), "model",
    )


@query
def stake_breakdown(t: Tables) -> DataFrame:
    key = F.col("seq")
    rows = staking.with_stake(
        t.forecasts, F.col("p"), F.col("american"), F.lit(0.0), F.lit(START), staking.RiskControls(), 0.85, 0.95, 0.9,
        game=(key % 5) / 400, team=(key % 7) / 500, cluster=(key % 3) / 200, weekly=(key % 11) / 250, name="new",
    )
    names = ("full_kelly", "fraction_kelly", "after_uncertainty", "after_quality", "after_calibration", "pct", "amount")
    return rows.select("seq", *(r6(f"new.{n}").alias(n) for n in names), F.col("new.bound").alias("bound"))


#: Which feed each event type stands for.
FEED_OF_EVENT = (("click", "odds"), ("view", "weather"), ("purchase", "manualPrice"), ("signup", "injury"), ("error", "schedule"))


@query
def freshness(t: Tables) -> DataFrame:
    last = t.feed_log.groupBy(F.col("feed").alias("event")).agg(F.max("observed_at").alias("at"))
    names = F.create_map(*(F.lit(x) for pair in FEED_OF_EVENT for x in pair))
    last = last.withColumn("feed", F.try_element_at(names, F.col("event")))
    return last.select(
        "event", "feed", r6(times.age_minutes(F.col("at"), now())).alias("age_minutes"),
        times.feed_freshness(F.col("feed"), F.col("at"), now()).alias("status"), times.format_utc(F.col("at")).alias("at_utc"), times.format_ago(F.col("at"), now()).alias("ago"),
    )


@query
def age_tiers(t: Tables) -> DataFrame:
    """Age tiers of manual prices (45 and 60 minutes) and of the latest quotes (30 and 120 minutes)."""
    manual = t.manual_prices.select(F.lit("manual").alias("kind"), "seq", times.age_tier(times.age_minutes(F.col("entered_at"), now()), 45, 60).alias("tier"))
    latest = pit.latest_snapshot(t.quotes, ["game_id", "market"], now())
    quotes = latest.select(F.lit("quote").alias("kind"), "seq", times.age_tier(times.age_minutes(F.col("observed_at"), now()), 30, 120).alias("tier"))
    return manual.unionByName(quotes)


@query
def kickoff_labels(t: Tables) -> DataFrame:
    return t.games.select("game_id", times.format_kickoff(F.col("kickoff"), "UTC").alias("label"), text.record_id("game", F.col("game_id"), F.col("home_team")).alias("id"))


@query
def feed_health(t: Tables) -> DataFrame:
    """Health of every feed with thresholds; two of them have no records, injury reports are in conflict now and then."""
    names = F.create_map(*(F.lit(x) for pair in FEED_OF_EVENT for x in pair))
    conflict = (F.col("event_type") == "signup") & (F.col("event_id") % 11 == 0)
    records = t.base("events").select(F.try_element_at(names, F.col("event_type")).alias("feed"), F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("at"), conflict.alias("conflict"))
    rows = slate.feed_health(records, now())
    return rows.withColumn("freshness_minutes", r6("freshness_minutes"))


@query
def kickoff_in_zones(t: Tables) -> DataFrame:
    """Kickoff in each reader's zone; unknown and missing zones show UTC."""
    zones = F.array(*map(F.lit, ("America/Phoenix", "Asia/Tokyo", "Mars/Base", None)))
    zone = F.element_at(zones, (F.col("game_id") % 4 + 1).cast("int"))
    return t.games.select("game_id", zone.alias("zone"), times.format_kickoff(F.col("kickoff"), zone).alias("label"))


@query
def freshness_of_texts(t: Tables) -> DataFrame:
    """Freshness of records whose times are texts, some of them unreadable or missing."""
    key = F.col("event_id")
    at = F.when(key % 7 == 0, "soon").when(key % 11 == 0, F.lit(None).cast("string")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = t.base("events").select("event_id", at.alias("at"))
    return rows.select("event_id", times.classify_freshness(F.col("at"), now(), 1440, 14400).alias("status"))


@query
def games_of_week(t: Tables) -> DataFrame:
    """One week of a season, the earliest twenty games."""
    return slate.of_week(t.schedule, 2024, 5, 20).select("game_id", "season", "week", "kickoff")


@query
def feed_impact(t: Tables) -> DataFrame:
    """Incidents per game that they touch, and whether one of them failed; games of the slate without one are shown too."""
    per_game = slate.impacted_games(t.incidents).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("resolution") == "FAILED").alias("failed"))
    rows = t.games.select("game_id").join(per_game, "game_id", "left")
    return rows.select("game_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query
def incidents_of_game(t: Tables) -> DataFrame:
    return slate.touching(t.incidents, F.lit(7).cast("long")).select("incident_id", "resolution")


@query
def game_factors(t: Tables) -> DataFrame:
    """Games with crew and stadium; a game without either stays."""
    crews = t.base("nation").select(F.col("n_nationkey").alias("crew_id"), F.col("n_name").alias("crew"))
    rows = t.games.withColumn("crew_id", F.when(F.col("game_id") % 9 != 0, F.col("game_id") % 25))
    rows = lookups.lookup(rows, crews, "crew_id", "crew_id", {"crew": "crew"}, {"crew": F.lit(text.MISSING)})
    rows = lookups.lookup(rows, stadiums(t.spark), "home_team", "team_id", {"stadium": "stadium", "surface": "surface", "altitude": "altitude"})
    return rows.select("game_id", "crew", "stadium", "surface", "altitude")


@query
def games_with_prior(t: Tables) -> DataFrame:
    """Games of the slate first, earlier ones that it lacks after them; unknown teams have a placeholder."""
    prior = t.base("part").select(F.col("p_partkey").alias("game_id"), (F.col("p_partkey") % 40).cast("int").alias("home_team"))
    rows = lookups.with_prior_games(t.games.select("game_id", "home_team"), prior)
    return lookups.lookup(rows, teams(t.spark), "home_team", "team_id", {"name": "home_name"}, {"home_name": F.lit("Unknown")}).select("game_id", "home_name")


@query
def bets_on_slate(t: Tables) -> DataFrame:
    return lookups.in_set(t.positions.select("bet_id", "game_id"), t.games, ["game_id"])


@query
def picks_union(t: Tables) -> DataFrame:
    """Live picks and recorded ones whose game is no longer live."""
    live = plan.best_candidates(t.quotes, t.predictions, t.manual_prices, now()).select("game_id", "market", F.lit("live").alias("source"))
    recorded = lookups.not_in_set(t.positions.select("game_id", "market"), live, ["game_id"])
    return live.unionByName(recorded.withColumn("source", F.lit("recorded"))).groupBy("source", "market").agg(F.count(F.lit(1)).alias("n"), F.sum("game_id").alias("games"))


@query
def worst_feed(t: Tables) -> DataFrame:
    """The worst class per game over its latest record of every event type."""
    rows = t.base("events").groupBy(F.col("user_id").alias("game_id"), "event_type").agg(F.max("ts").cast("timestamp").alias("at"))
    status = times.classify_freshness(F.col("at"), now(), 1440, 5 * 1440)
    return rows.withColumn("status", status).groupBy("game_id").agg(times.worst_freshness(F.col("status")).alias("worst"), F.count_if(F.col("status").isin(*slate.DEGRADED)).alias("degraded"))


# Metrics and curves ----------------------------------------------------------------------


@query
def log_loss_brier(t: Tables) -> DataFrame:
    return t.forecasts.groupBy("segment").agg(r6(metrics.log_loss(F.col("p"), F.col("outcome"))).alias("log_loss"), r6(metrics.brier(F.col("p"), F.col("outcome"))).alias("brier"))


@query
def calibration_bins(t: Tables) -> DataFrame:
    return metrics.calibration_bins(t.forecasts).select("bin", r6("low").alias("low"), r6("high").alias("high"), "n", r6("mean_predicted").alias("mean_predicted"), r6("observed").alias("observed"))


@query
def calibration_labels(t: Tables) -> DataFrame:
    return metrics.calibration_bins(t.labels_eval).select("bin", "n", r6("mean_predicted").alias("mean_predicted"), r6("observed").alias("observed"))


@query
def ece(t: Tables) -> DataFrame:
    return metrics.expected_calibration_error(t.forecasts, ["segment"]).select("segment", r6("ece").alias("ece"))


@query
def calibration_line(t: Tables) -> DataFrame:
    slope, intercept = metrics.calibration_line(F.col("p"), F.col("outcome"))
    return t.forecasts.groupBy("segment").agg(r6(slope).alias("slope"), r6(intercept).alias("intercept"))


@query
def metric_bundle(t: Tables) -> DataFrame:
    rows = metrics.full_bundle(t.forecasts, ["segment"], ["seq"], START)
    counts = ("segment", "n_recs", "n_wagers")
    return rows.select(*(F.col(c) if c in counts else r6(c).alias(c) for c in rows.columns))


@query
def performance_filtered(t: Tables) -> DataFrame:
    facets = slate.performance_filter(statuses=("BET", "WATCH"), market="SPREAD", venue="OUTDOOR", horizon="≥24h", data="HIGH")
    rows = t.forecasts.where(facets)
    return rows.groupBy("week").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("edge")).alias("avg_edge"), F.sum("profit").cast("double").alias("profit"))


def _rounded_bundle(rows: DataFrame) -> DataFrame:
    whole = ("facet", "value", "n_recs", "n_wagers")
    return rows.select(*(F.col(c) if c in whole else r6(c).alias(c) for c in rows.columns))


@query
def performance_cube(t: Tables) -> DataFrame:
    """Metric bundle of every value of the eight performance facets, all from one table of sums."""
    return _rounded_bundle(cube.metrics_of(cube.by_facet(cube.cells(t.forecasts)), ["facet", "value"]))


@query
def performance_tier_side_week(t: Tables) -> DataFrame:
    """Metric bundle under the filters for edge tier, side and week, from the sums."""
    some = cube.cells(t.forecasts).where(cube.matching(tier="≥3%", side="FAVORITES", week=5))
    return _rounded_bundle(cube.metrics_of(cube.merged(some, [])))


@query
def edge_tier_slices(t: Tables) -> DataFrame:
    rows = metrics.slice_tables(t.forecasts)
    return rows.select("slice", "name", "n", *(r6(c).alias(c) for c in ("log_loss", "brier", "mean_clv", "avg_edge")))


def _curve(t: Tables) -> DataFrame:
    return metrics.bankroll_curve(t.forecasts, ["segment"], ["seq"], "profit", START)


@query
def bankroll_curve(t: Tables) -> DataFrame:
    return _curve(t).select("segment", "point", F.round("balance", 2).alias("balance"))


@query
def settled_curve(t: Tables) -> DataFrame:
    """Balance per customer by time of settlement, ties by bet."""
    settled = t.positions.where(F.col("result") != "PENDING")
    rows = metrics.running(settled, ["user_id"], ["settled_at", "bet_id"], F.col("delta"), "sum")
    return rows.select("bet_id", "user_id", (F.col("sum") + START).cast("double").alias("balance"))


@query
def max_drawdown(t: Tables) -> DataFrame:
    return metrics.folded_drawdown(t.forecasts, ["segment"], ["seq"], "profit", START).select("segment", r6("max_drawdown").alias("max_drawdown"))


@query
def drawdown_curve(t: Tables) -> DataFrame:
    return metrics.drawdown_curve(_curve(t), ["segment"]).select("segment", "point", F.round("peak", 2).alias("peak"), r6("drawdown_pct").alias("drawdown_pct"))


@query
def running_clv(t: Tables) -> DataFrame:
    tenths = F.round(F.col("clv") * 10).cast("long")  # whole numbers, so the order of summing cannot matter
    rows = metrics.spread_running(t.forecasts.select("segment", "seq", "clv"), ["segment"], ["seq"], {"sum": ("sum", tenths), "n": ("sum", F.lit(1))})
    mean = F.col("sum") / (F.col("n") * 10)
    return rows.select("segment", "seq", "n", (F.floor(mean * 1e6 + 0.5) / 1e6).alias("mean_clv"))


@query
def closing_line_value(t: Tables) -> DataFrame:
    """Points between the implied probability at opening and at the latest quote."""
    b = plan.board(t.quotes, now())
    taken, closing = odds.implied_probability(F.col("moneyline_open.home_american")), odds.implied_probability(F.col("moneyline.home_american"))
    return b.select("game_id", r6(odds.closing_line_value(taken, closing)).alias("clv"))


@query
def global_balance(t: Tables) -> DataFrame:
    """One running balance over all records, by two-level sums."""
    rows = metrics.global_running_sum(t.forecasts.select("seq", "profit"), "seq", "profit", "total")
    return rows.select("seq", F.col("total").cast("double").alias("total"))


@query
def vintage_delta(t: Tables) -> DataFrame:
    """Three vintages per projection that mature toward the final margin."""
    v = F.explode(F.array(*(F.struct(F.lit(i).alias("vintage"), F.lit(m).alias("maturity")) for i, m in ((0, 0.45), (1, 0.7), (2, 1.0))))).alias("v")
    rows = t.projection.select("part_id", "mu", v).select("part_id", "v.vintage", (F.col("mu") * F.col("v.maturity")).alias("margin"))
    rows = rows.withColumn("probability", dist.margin_to_win_probability(F.col("margin")))
    out = metrics.vintage_deltas(rows, "part_id", "vintage", "margin", "probability")
    return out.select("part_id", "vintage", r6("margin_delta").alias("margin_delta"), r6("probability_delta").alias("probability_delta"), "note")


# Portfolio and ledger --------------------------------------------------------------------


@query
def exposure_grouping_sets(t: Tables) -> DataFrame:
    return slate.exposure(t.positions, "game_id", "team", "cluster").select("dimension", "key", F.col("stake").cast("double").alias("stake"))


@query
def open_exposure(t: Tables) -> DataFrame:
    rows = slate.portfolio(t.positions, ["user_id"], BANKROLL)
    return rows.select("user_id", F.col("open_stake").cast("double").alias("open_stake"), F.round("open_pct", 9).alias("open_pct"), "n_open", "n_settled")


@query
def realized_pnl(t: Tables) -> DataFrame:
    rows = slate.portfolio(t.positions, ["team"], BANKROLL)
    return rows.select("team", F.col("realized").cast("double").alias("realized"), (F.lit(BANKROLL) - F.col("open_stake").cast("double")).alias("available"))


@query
def balance_reconciliation(t: Tables) -> DataFrame:
    return ledger.balances(t.positions, ["user_id"], START).select("user_id", F.col("balance").cast("double").alias("balance"))


def _raw_bets(t: Tables) -> DataFrame:
    return t.positions.select("bet_id", F.col("stake").cast("double").alias("stake"), "american", F.lit("PENDING").alias("result"))


def _outcomes(t: Tables) -> DataFrame:
    """A settlement of every bet; two of three have a closing price."""
    results = F.array(*map(F.lit, ledger.SETTLED))
    return t.positions.select(
        "bet_id", F.element_at(results, (F.floor(F.col("bet_id") / 2) % 4 + 1).cast("int")).alias("new_result"), "settled_at",
        F.when(F.col("bet_id") % 3 != 0, F.col("american") - 5 + F.when(F.col("american") > 0, 10).otherwise(0)).alias("closing_american"),
    )


@query
def settlement_ledger(t: Tables) -> DataFrame:
    """Every bet is settled; every fifth a second time, which is refused."""
    again = _outcomes(t).where(F.col("bet_id") % 5 == 0).withColumn("settled_at", F.col("settled_at") + F.make_dt_interval(days=F.lit(1)))
    rows = ledger.settle(_raw_bets(t), _outcomes(t).unionByName(again))
    return rows.select("bet_id", "new_result", "error", "event_type", F.col("delta").cast("double").alias("delta"), F.col("payout").cast("double").alias("payout"), r6("clv").alias("clv"))


@query
def mean_clv_settled(t: Tables) -> DataFrame:
    """Mean closing line value by result, over the bets that have one."""
    rows = ledger.settle(_raw_bets(t), _outcomes(t))
    return rows.groupBy("new_result").agg(F.count("clv").alias("n"), F.round(F.avg("clv"), 4).alias("mean_clv"))


@query
def events_newest(t: Tables) -> DataFrame:
    """Settlements, the newest first."""
    rows = t.positions.where(F.col("result") != "PENDING").select("bet_id", "result", "settled_at")
    return lookups.sorted_by(rows, "-settled_at", "-bet_id")


@query
def placed_bets(t: Tables) -> DataFrame:
    """Bets placed through the ledger: accepted ones with their event, rejected ones with reasons."""
    side = F.when(F.col("market") == "TOTAL", "OVER").otherwise("HOME")
    stake = F.when(F.col("bet_id") % 10 == 0, 0.0).otherwise(F.col("stake").cast("double"))
    bets = t.positions.select(
        F.col("bet_id").alias("seq"), "user_id", "game_id", "market", side.alias("selection"), "american", stake.alias("stake"),
        F.lit("PAPER").alias("mode"), F.date_format("settled_at", "yyyy-MM-dd").alias("placed_at"),
    )
    good, events, _, bad = ledger.place_bets(bets, 300.0)
    accepted = good.select("seq", "bet_id").join(events.select("bet_id", "event_id", "detail"), "bet_id").select("seq", "bet_id", "event_id", "detail")
    none = F.lit(None).cast("string")
    return accepted.unionByName(bad.select("seq", none.alias("bet_id"), none.alias("event_id"), F.concat_ws("; ", "errors").alias("detail")))


@query
def stake_inputs(t: Tables) -> DataFrame:
    k = F.col("seq")
    errors = staking.stake_input_errors((k % 13) / 10, F.col("p"), F.when(k % 4 != 0, 0.9), F.when(k % 7 == 0, -1.0).otherwise(START))
    return t.forecasts.select("seq", F.concat_ws(",", errors).alias("errors"))


@query
def correction_fold(t: Tables) -> DataFrame:
    """Settlements, some of them corrected to a push; a correction to the same result does nothing."""
    first = _outcomes(t).where(F.col("bet_id") % 2 == 0).select("bet_id", F.lit(1).alias("seq"), F.when(F.col("new_result") == "VOID", "VOIDED").otherwise("SETTLED").alias("event_type"), F.col("new_result").alias("result"))
    fix = first.where(F.col("bet_id") % 5 == 0).select("bet_id", F.lit(2).alias("seq"), F.lit("CORRECTED").alias("event_type"), F.lit("PUSH").alias("result"))
    rows = ledger.fold_results(_raw_bets(t), first.unionByName(fix))
    return rows.select("bet_id", "result", "corrections", F.col("delta").cast("double").alias("delta"), F.col("payout").cast("double").alias("payout"))


@query
def correction_amounts(t: Tables) -> DataFrame:
    settled = t.positions.select("bet_id", F.col("stake").cast("double").alias("stake"), "american", "result")
    changes = t.positions.select("bet_id", F.lit("PUSH").alias("new_result"))
    rows = ledger.corrections(settled, changes)
    return rows.select("bet_id", "error", F.col("reversal").cast("double").alias("reversal"), F.col("applied").cast("double").alias("applied"))


def _vintages(t: Tables) -> tuple[DataFrame, DataFrame]:
    row = [F.concat(F.lit("p"), "part_id").alias("prediction_id"), F.col("part_id").alias("game_id"), F.lit("OPEN").alias("vintage"), (F.col("part_id") % 5).alias("model")]
    history = t.projection.select(*row)
    shifted = [F.concat(F.lit("p"), F.col("part_id") * 2).alias("prediction_id"), F.col("part_id").alias("game_id"), F.lit("OPEN").alias("vintage"), (F.col("part_id") % 4).alias("model")]
    return history, t.projection.select(*shifted)


@query
def vintage_conflicts(t: Tables) -> DataFrame:
    return ledger.vintage_conflicts(*_vintages(t)).select("prediction_id", "game_id", "conflict")


@query
def append_vintages(t: Tables) -> DataFrame:
    return ledger.append_vintages(*_vintages(t)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query
def invalidate_recs(t: Tables) -> DataFrame:
    recs = t.forecasts.select(F.col("seq").alias("rec_id"), (F.col("seq") % 150).alias("game_id"), "status", F.array(F.lit("first reason")).alias("reasons"), F.when(F.col("seq") % 10 == 0, now()).alias("invalidated_at"))
    rows = ledger.invalidate(recs, t.failures, "Feed failed", cutoff())
    return rows.select("rec_id", "status", F.concat_ws("; ", "reasons").alias("reasons"), F.date_format("invalidated_at", "yyyy-MM-dd").alias("invalidated"))


# Guards, sets, formats -------------------------------------------------------------------


@query
def rls_filter(t: Tables) -> DataFrame:
    owned = t.positions.select("bet_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("owner"), "result")
    shared = guards.visible_to(owned, "7", "owner", shared=True).withColumn("via", F.lit("shared"))
    children = owned.select("bet_id", F.col("result").alias("x"))
    own = guards.visible_children(children, owned, "7", "bet_id", "owner").select("bet_id", F.lit("7").alias("owner"), F.col("x").alias("result"), F.lit("child").alias("via"))
    return shared.unionByName(own)


@query
def constraint_report(t: Tables) -> DataFrame:
    q = t.positions.withColumn("p", F.col("stake").cast("double") / 500)
    return guards.constraint_report(
        q, {"stake_positive": F.col("stake") > 0, "probability_range": F.col("p").between(0, 1), "odds_magnitude": F.abs("american") >= 100, "even_bet": F.col("bet_id") % 2 == 0}
    )


@query
def key_report(t: Tables) -> DataFrame:
    """Duplicate keys and orphans."""
    duplicates = guards.duplicate_keys(t.base("lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate").alias("kind"), F.col("l_orderkey").alias("key"), F.col("n"))
    missing = guards.orphans(t.base("orders"), t.base("customer").where("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")
    return duplicates.unionByName(missing.groupBy(F.lit("orphan").alias("kind"), F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def _price_form(t: Tables) -> DataFrame:
    k = F.col("seq")
    return t.quotes.select(
        "seq", F.col("game_id").cast("string").alias("game_id"), F.when(k % 13 == 0, "other").otherwise("bet365").alias("book"), "market",
        F.when(k % 17 == 0, "MIDDLE").otherwise("HOME").alias("selection"), F.when(k % 5 == 0, F.col("line") + 0.25).otherwise(F.col("line")).alias("line"),
        F.when(k % 7 == 0, 50).otherwise(F.col("home_american")).alias("american"), (k % 300).alias("age_minutes"), (k % 3 != 0).alias("confirmed"),
    )


@query
def price_form(t: Tables) -> DataFrame:
    return guards.price_form_errors(_price_form(t)).select("seq", F.concat_ws(",", "errors").alias("errors"))


@query
def submitted_prices(t: Tables) -> DataFrame:
    """Prices submitted to a new folder of JSON lines, read back from it."""
    path = folder(t.spark, "prices")
    submit_prices(_price_form(t), path)
    return read_prices(t.spark, path).select("seq", "game_id", "market", "line", "american")


@query
def exported_state(t: Tables) -> DataFrame:
    """Bets and prices exported as JSON lines and read back."""
    path = folder(t.spark, "export")
    bets, prices = t.positions.select("bet_id", "user_id", "result"), t.manual_prices.select("seq", "market", "american")
    export_state({"bets": bets, "prices": prices}, path)
    back = lambda name, rows: t.spark.read.schema(rows.schema).json(f"{path}/{name}")
    return back("bets", bets).select(F.lit("bet").alias("kind"), F.col("bet_id").alias("key"), F.col("result").alias("value")).unionByName(
        back("prices", prices).select(F.lit("price").alias("kind"), F.col("seq").alias("key"), F.concat_ws(" ", "market", F.col("american").cast("string")).alias("value"))
    )


@query
def update_guard(t: Tables) -> DataFrame:
    old = t.positions.select("bet_id", "user_id", "game_id", "market", "american", "stake", "result")
    new = old.withColumn("american", F.when(F.col("bet_id") % 4 == 0, F.col("american") + 1).otherwise(F.col("american")))
    new = new.withColumn("result", F.when((F.col("bet_id") % 3 == 0) & (F.col("result") != "PENDING"), "VOID").otherwise(F.col("result"))).withColumn("updated_at", now())
    events = old.where(F.col("bet_id") % 6 == 0).select("bet_id", F.lit("CORRECTED").alias("event_type"), times.minutes_before(now(), 3).alias("created_at"))
    rows = guards.update_violations(old, new, events)
    return rows.select("bet_id", "violation", F.concat_ws(",", "changed").alias("changed"))


@query
def mutation_audit(t: Tables) -> DataFrame:
    before = t.positions.select("bet_id", "stake", "result")
    after = before.where(F.col("bet_id") % 11 != 0).withColumn("result", F.when(F.col("bet_id") % 13 == 0, "VOID").otherwise(F.col("result")))
    return guards.mutated_rows(before, after, "bet_id")


@query
def mutation_audit_digests(t: Tables) -> DataFrame:
    """The same audit by digests: rows are read of the buckets that differ only; a fifth of the keys is touched."""
    before = t.positions.select("bet_id", "stake", "result")
    touched = F.col("bet_id") % 5 == 0
    after = before.where(~(touched & (F.col("bet_id") % 11 == 0))).withColumn("result", F.when(touched & (F.col("bet_id") % 13 == 0), "VOID").otherwise(F.col("result")))
    paths = []
    for rows, name in ((before, "before"), (after, "after")):
        paths.append(folder(t.spark, name))
        digests.write_snapshot(rows, "bet_id", paths[-1])
    return digests.audit(t.spark, *paths, "bet_id")


@query
def policy_rows(t: Tables) -> DataFrame:
    """How many rows of each table user 7 may see, and how many of an update of all bets are refused."""
    bets = t.positions.select("bet_id", "user_id", "result")
    events = t.positions.select("bet_id", F.lit("PLACED").alias("event_type"))
    recs = t.positions.select(F.col("bet_id").alias("rec_id"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"))
    prices = t.manual_prices.select("seq", F.col("game_id").alias("user_id"), "confirmed")
    seen = {
        "bets": policies.allowed(bets, "bets", 7), "bet_events": policies.allowed(events, "bet_events", 7, bets=bets), "recommendations": policies.allowed(recs, "recommendations", 7),
        "odds_snapshots": policies.allowed(t.quotes, "odds_snapshots", 7), "nobody": policies.allowed(t.quotes, "odds_snapshots", None), "unknown": policies.allowed(bets, "secrets", 7),
        "prices to insert": policies.allowed(prices, "manual_book_prices", 7, "insert", confirmed="confirmed"), "bets refused": policies.refused(bets, "bet_id", "bets", 7, "update"),
    }
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rows_of"), "n") for name, rows in seen.items()]
    return reduce(DataFrame.unionByName, counted)


@query
def injury_conflicts(t: Tables) -> DataFrame:
    return slate.game_conflicts(t.injury_reports)


@query
def injury_board(t: Tables) -> DataFrame:
    """Injury reports with the player's availability in that game and name, the least available first; missing counts as 1."""
    latest = pit.latest_by(t.availability.select("game_id", "player_id", "active_probability", "seq"), ["game_id", "player_id"], ["seq"])
    reports = t.injury_reports.select("report_id", "game_id", "player_id", "designation")
    rows = reports.join(latest.drop("seq"), ["game_id", "player_id"], "left").join(t.players.select("player_id", "player"), "player_id", "left")
    rows = lookups.sorted_by(rows, "active_probability", "report_id", missing={"active_probability": F.lit(1.0)})
    return rows.select("report_id", "game_id", "player", "designation", r6("active_probability").alias("active_probability"))


@query
def activity_windows(t: Tables) -> DataFrame:
    """Quotes per market and day of event time with the last line: the batch twin of the stream."""
    rows = t.quotes.groupBy(F.window("observed_at", "1 day").alias("w"), "market")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.max_by("line", F.struct("observed_at", "seq")).alias("last_line"))
    return rows.select(F.col("w.start").alias("start"), "market", "n", "last_line")


@query
def injury_clusters(t: Tables) -> DataFrame:
    return slate.injury_clusters(t.injury_reports)


@query
def injury_highlights(t: Tables) -> DataFrame:
    return slate.injury_highlights(t.injury_reports).select("report_id", "label")


@query
def availability_summary(t: Tables) -> DataFrame:
    rows = slate.availability_summary(t.availability, ["game_id"])
    return rows.select("game_id", r6("worst_impact").alias("worst_impact"), "injury_severity", r6("availability_impact").alias("availability_impact"), "quarterback_unresolved", "injury_uncertain")


@query
def component_disagreement(t: Tables) -> DataFrame:
    return slate.components_disagree(t.components, "game_id").withColumnRenamed("game_id", "part_id")


@query
def dedupe_last_wins(t: Tables) -> DataFrame:
    return lookups.last_write_wins(t.manual_prices, ["game_id", "market", "selection"]).select("game_id", "market", "selection", "seq")


@query
def union_prices(t: Tables) -> DataFrame:
    manual = t.manual_prices.select("game_id", "market", "american", F.lit("manual").alias("source"))
    quoted = t.quotes.select("game_id", "market", F.col("home_american").alias("american"), F.lit("consensus").alias("source"))
    rows = manual.unionByName(quoted)
    return rows.groupBy("source", "market").agg(F.count(F.lit(1)).alias("n"), F.min("american").alias("low"), F.max("american").alias("high"), F.count_distinct("game_id").alias("games"))


@query
def append_missing(t: Tables) -> DataFrame:
    existing = t.manual_prices.where("seq % 2 = 0").select("game_id", "market")
    return lookups.append_missing(existing.distinct(), t.manual_prices.select("game_id", "market"), ["game_id", "market"])


@query
def recorded_not_live(t: Tables) -> DataFrame:
    """Positions whose game is not on the slate."""
    return lookups.not_in_set(t.positions.select("bet_id", "game_id"), t.games, ["game_id"])


@query
def correlated_positions(t: Tables) -> DataFrame:
    recs = plan.best_candidates(t.quotes, t.predictions, t.manual_prices, now()).select("game_id", "market")
    return lookups.correlated_positions(recs, t.positions.where("result = 'PENDING'"))


@query
def odds_board(t: Tables) -> DataFrame:
    b = plan.board(t.quotes, now())
    columns = [F.col(f"{plan.QUOTE[m]}{o}.line").alias(f"{plan.QUOTE[m]}{o}") for m in ("SPREAD", "TOTAL") for o in ("_open", "")]
    return b.select("game_id", *columns, F.col("moneyline.home_american").alias("moneyline"))


@query
def market_monitor(t: Tables) -> DataFrame:
    """Opening and current prices of every game, moves to a tenth, and what a recommendation to watch waits for.

    ``shown_spread`` and ``shown_total`` fall back to 0 and 45 where a market has no line.
    """
    recs = plan.evaluate(t, price_minutes=PRICE_MINUTES).select("game_id", "status", "target_price", "invalidation_price")
    rows = _labelled(t, t.games.withColumn("model_id", F.lit(None).cast("int"))).join(plan.board(t.quotes, now()), "game_id", "left").join(recs, "game_id", "left")
    rows = rows.withColumns({f"{m}_move": F.coalesce(F.col(f"{m}.line") - F.col(f"{m}_open.line"), F.lit(0.0)) for m in ("spread", "total_quote")})
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5) / 10
    shown = lambda c: F.coalesce(text.format_odds(F.col(c)), F.lit(text.MISSING))
    band = F.concat(F.lit("qualify ≥ "), text.format_odds(F.coalesce("target_price", F.lit(-110))), F.lit("; pass ≤ "), text.format_odds(F.coalesce("invalidation_price", F.lit(-125))))
    return rows.select(
        "game_id", text.game_label(F.col("away"), F.col("home"), F.col("game_id")).alias("label"),
        F.col("spread_open.line").alias("spread_open"), F.col("spread.line").alias("spread"), tenth("spread_move").alias("spread_move"), (F.abs("spread_move") >= 1).alias("spread_moved"),
        (F.col("total_quote_open.line") + plan.TOTAL_BASE).alias("total_open"), (F.col("total_quote.line") + plan.TOTAL_BASE).alias("total"), tenth("total_quote_move").alias("total_move"),
        (F.abs("total_quote_move") >= 1).alias("total_moved"),
        F.when(F.col("moneyline").isNotNull(), F.concat(shown("moneyline.away_american"), F.lit(" / "), shown("moneyline.home_american"))).otherwise(text.MISSING).alias("moneyline"),
        shown("target_price").alias("target"), F.when(F.col("status") == "WATCH", band).otherwise(text.MISSING).alias("watch_band"),
        F.coalesce("spread.line", F.lit(0.0)).alias("shown_spread"), F.coalesce(F.col("total_quote.line") + plan.TOTAL_BASE, F.lit(float(plan.TOTAL_BASE))).alias("shown_total"),
    )


@query
def kickoff_window(t: Tables) -> DataFrame:
    rows = t.feed_log.withColumn("window", times.kickoff_window(F.col("observed_at")))
    return rows.groupBy("window").agg(F.count(F.lit(1)).alias("n"))


@query
def formatted_quotes(t: Tables) -> DataFrame:
    a, line = F.col("home_american"), F.col("line")
    return t.quotes.select(
        "seq", text.format_odds(a).alias("american"), text.format_odds(a, "DECIMAL").alias("decimal"), text.format_market_line(F.col("market"), line).alias("line"),
        times.format_utc(F.col("observed_at")).alias("at"), text.ordinal(F.col("seq")).alias("nth"), text.format_signed(line).alias("signed"),
    )


@query
def formatted_money(t: Tables) -> DataFrame:
    d = F.col("delta").cast("double")
    return t.positions.select("bet_id", text.format_signed_money(d).alias("signed"), text.format_money(F.abs(d)).alias("money"), text.string_seed(F.col("bet_id").cast("string")).alias("seed"))


@query
def json_state(t: Tables) -> DataFrame:
    """Event properties read as state with defaults; every seventh text is corrupt."""
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{oops")).otherwise(F.col("props"))
    state = parsed_state(broken, "k int, mode string", {"k": F.lit(-1), "mode": F.lit("PAPER")})
    return t.base("events").select("event_id", state.alias("s")).select("event_id", "s.k", "s.mode")


@query
def nested_state(t: Tables) -> DataFrame:
    """State with settings in it, of which any part may be absent or the whole text corrupt."""
    k = F.col("event_id")
    json = F.when(k % 7 == 0, "{oops").when(k % 5 == 0, '{"version": 3}').when(k % 3 == 0, F.format_string('{"settings": {"unit": %d}}', k % 4))
    json = json.otherwise(F.format_string('{"settings": {"risk": {"per_bet": 0.%d}}}', k % 9 + 1))
    risk = {"per_bet": F.lit(0.005), "per_game": F.lit(0.01)}
    state = parsed_state(json, "version int, settings struct<unit int, risk struct<per_bet double, per_game double>>", {"version": F.lit(-1), "settings": {"unit": F.lit(25), "risk": risk}})
    return t.base("events").select("event_id", state.alias("s")).select("event_id", "s.version", "s.settings.unit", "s.settings.risk.per_bet", "s.settings.risk.per_game")


@query
def mode_gate(t: Tables) -> DataFrame:
    """What keeps each record from real tracking: no positive loss budget, or no acknowledgement."""
    k = F.col("seq")
    errors = guards.real_mode_errors(F.when(k % 11 != 0, (k % 5 - 1) * 100), F.when(k % 13 != 0, k % 3 != 0))
    return t.forecasts.select("seq", F.concat_ws("; ", errors).alias("errors"))
