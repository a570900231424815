"""The decision plan: from quotes and predictions to a recommendation with its stake.

All of it is keyed by game.  Quotes and manual prices are each reduced to one row per game in a
single aggregate, candidates are priced inside that row, and every side input is one row per
game before it is joined, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions import distributions as dist
from pricewright.functions import odds
from pricewright.functions.text import format_percent, plain_number
from pricewright.functions.times import age_minutes
from pricewright.operators import pointintime as pit
from pricewright.operators import rules, slate
from pricewright.operators.lookups import lookup
from pricewright.operators.staking import RiskControls, with_stake
from pricewright.sources.reference import teams
from pricewright.sources.tables import BANKROLL, Tables, now

MARKETS = ("SPREAD", "TOTAL", "MONEYLINE")
QUOTE = {"SPREAD": "spread", "TOTAL": "total_quote", "MONEYLINE": "moneyline"}
#: Quoted totals are relative to this base.
TOTAL_BASE = 45
CANDIDATES = (
    ("SPREAD", "HOME", 0),
    ("SPREAD", "AWAY", 1),
    ("TOTAL", "OVER", 2),
    ("TOTAL", "UNDER", 3),
    ("MONEYLINE", "HOME", 4),
    ("MONEYLINE", "AWAY", 5),
)


def board_columns(usable: Column | None = None) -> list[Column]:
    """Aggregates: latest and opening quote of each market, of all rows or of the ``usable`` ones."""
    fields = F.struct("line", "home_american", "away_american", "observed_at", "seq")
    columns = []
    for m in MARKETS:
        of = (F.col("market") == m) if usable is None else (F.col("market") == m) & usable
        latest = F.max_by(F.when(of, fields), F.when(of, F.struct("observed_at", "seq")))
        columns += [latest.alias(QUOTE[m]), F.min_by(F.when(of, fields), F.when(of, F.col("seq"))).alias(QUOTE[m] + "_open")]
    return columns


def board(quotes: DataFrame, cutoff: Column) -> DataFrame:
    """One row per game: latest and opening quote of each market by the cutoff, which is pushed to the scan."""
    return pit.filter_to_cutoff(quotes, cutoff).groupBy("game_id").agg(*board_columns())


def game_facts(events: DataFrame, clock: Column) -> DataFrame:
    """The board of every game with what else is known of it from event feeds, in one aggregate over one scan.

    ``late_quote_at`` and ``late_injury_at`` are the first records after the clock; ``awaiting``: an
    official injury update is still to come; ``failed``: a provider failure touches the game; ``quoted``: there
    is a quote of any time.
    """
    of = lambda kind: F.col("kind") == kind
    awaiting = of("injury") & (F.col("practice_fri") == "NO_DATA") & (F.col("designation") == "QUESTIONABLE")
    late = lambda kind: pit.first_violation(clock, F.col("observed_at"), F.col("seq"), of(kind))
    return events.groupBy("game_id").agg(
        *board_columns(of("quote") & (F.col("observed_at") <= clock)),
        late("quote").alias("late_quote_at"), late("injury").alias("late_injury_at"),
        F.bool_or(F.coalesce(awaiting, F.lit(False))).alias("awaiting"), F.bool_or(of("failure")).alias("failed"), F.bool_or(of("quote")).alias("quoted"),
    )


def outcome_probabilities(games: DataFrame) -> DataFrame:
    """cover, spread_push, over and total_push of each game, in one hash aggregate over exploded outcomes.

    Needs mu, sd, total, total_sd, spread_line and total_line.  A missing line gives NULLs.
    """
    outcome = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    outcomes = F.concat(F.transform(dist.margin_values(), outcome("margin")), F.transform(dist.total_values(), outcome("total")))
    rows = games.select("game_id", "mu", "sd", "total", "total_sd", "spread_line", "total_line", F.explode(outcomes).alias("o"))
    v, margin = F.col("o.value"), F.col("o.kind") == "margin"
    weight = F.when(margin, dist.normal_pdf(v, F.col("mu"), F.col("sd")) * dist.key_boost(v)).otherwise(dist.normal_pdf(v, F.col("total"), F.col("total_sd")))
    rows = rows.select("game_id", margin.alias("margin"), weight.alias("w"), F.when(margin, v + F.col("spread_line")).otherwise(v - F.col("total_line")).alias("by"))
    part = lambda of, c: F.sum(F.when(of & c, F.col("w")).otherwise(F.when(F.col("by").isNotNull() & of, 0.0))) / F.sum(F.when(of, F.col("w")))
    wins, ties = F.col("by") > dist.PUSH_TOLERANCE, F.abs("by") < dist.PUSH_TOLERANCE
    of_margin, of_total = F.col("margin"), ~F.col("margin")
    return rows.groupBy("game_id").agg(
        part(of_margin, wins).alias("cover"), part(of_margin, ties).alias("spread_push"), part(of_total, wins).alias("over"), part(of_total, ties).alias("total_push")
    )


def priced_slate(board_rows: DataFrame, predictions: DataFrame, manual: DataFrame, cutoff: Column) -> DataFrame:
    """One row per game of the board with it and ``candidates``: up to six priced structs, in order.

    A total line is the quoted one plus TOTAL_BASE.  Manual prices are reduced to one row per
    game before the join.
    """
    entered = [
        F.max_by(F.when(side, F.struct(F.col("american").cast("long").alias("american"), "entered_at", "seq")), F.when(side, F.struct("entered_at", "seq"))).alias(_manual(m, x))
        for m, x, _ in CANDIDATES
        for side in [(F.col("market") == m) & (F.col("selection") == x)]
    ]
    latest = pit.filter_to_cutoff(manual.where("confirmed"), cutoff, "entered_at").groupBy("game_id").agg(*entered)
    rows = board_rows.join(predictions, "game_id")
    rows = rows.withColumns({"spread_line": F.col("spread.line"), "total_line": F.col("total_quote.line") + TOTAL_BASE})
    rows = rows.join(outcome_probabilities(rows), "game_id").join(latest, "game_id", "left")
    rows = rows.withColumn("open", F.array(*(_candidate(m, x, rank) for m, x, rank in CANDIDATES)))
    return rows.withColumn("candidates", F.transform(F.array_compact("open"), _priced)).drop("open")


def _manual(market: str, selection: str) -> str:
    return f"manual_{market}_{selection}".lower()


def _rest(won: str, push: str) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.col(won) - F.col(push))


def _candidate(market: str, selection: str, rank: int) -> Column:
    """What is known of one candidate before pricing; NULL without a quote of its market, or without its line."""
    quote, entered = F.col(QUOTE[market]), F.col(_manual(market, selection))
    home, away = odds.no_vig(quote["home_american"], quote["away_american"])
    first = selection in ("HOME", "OVER")
    if market == "SPREAD":
        line = F.col("spread_line") if first else F.when(F.col("spread_line") == 0, 0.0).otherwise(-F.col("spread_line"))
        model, push = F.col("cover") if first else _rest("cover", "spread_push"), F.col("spread_push")
    elif market == "TOTAL":
        line, model, push = F.col("total_line"), F.col("over") if first else _rest("over", "total_push"), F.col("total_push")
    else:
        line, model, push = F.lit(None).cast("double"), F.col("home_win") if first else 1 - F.col("home_win"), F.lit(0.0)
    fields = {
        "market": F.lit(market), "selection": F.lit(selection), "rank": F.lit(rank), "line": line,
        "american": F.coalesce(entered["american"], (quote["home_american"] if first else quote["away_american"]).cast("long")),
        "manual_id": entered["seq"], "manual_at": entered["entered_at"], "model_p": model, "market_p": home if first else away, "push_p": push,
    }
    known = quote.isNotNull() if market == "MONEYLINE" else quote.isNotNull() & line.isNotNull()
    return F.when(known, F.struct(*(c.alias(n) for n, c in fields.items())))


def _priced(c: Column) -> Column:
    conservative = odds.conservative_probability(c["model_p"], c["market_p"])
    break_even = odds.break_even(c["american"], c["push_p"])
    more = {
        "conservative_p": conservative, "break_even_p": break_even, "edge": conservative - break_even,
        "ev": odds.expected_value(conservative, c["american"], c["push_p"]), "fair_american": odds.fair_american(odds.clamped(conservative)),
    }
    names = ("market", "selection", "rank", "line", "american", "manual_id", "manual_at", "model_p", "market_p", "push_p")
    return F.struct(*(c[n].alias(n) for n in names), *(x.alias(n) for n, x in more.items()))


def candidates(quotes: DataFrame, predictions: DataFrame, manual: DataFrame, cutoff: Column) -> DataFrame:
    """One row per candidate."""
    rows = priced_slate(board(quotes, cutoff), predictions, manual, cutoff)
    return rows.select("game_id", F.explode("candidates").alias("c")).select("game_id", "c.*")


def best_of(candidates_: Column) -> Column:
    """The candidate with the largest edge; of equal ones the first in order."""
    ordered = F.transform(candidates_, lambda c: F.struct(c["edge"].alias("edge"), (-c["rank"]).alias("order"), c.alias("c")))
    return F.array_max(ordered)["c"]


def best_candidates(quotes: DataFrame, predictions: DataFrame, manual: DataFrame, cutoff: Column) -> DataFrame:
    rows = priced_slate(board(quotes, cutoff), predictions, manual, cutoff)
    return rows.select("game_id", best_of(F.col("candidates")).alias("c")).select("game_id", "c.*")


def movement(market: str) -> Column:
    """struct<market, toward_first, toward_second, line_move> of a board row: moves since opening."""
    latest, opening = F.col(QUOTE[market]), F.col(QUOTE[market] + "_open")
    if market == "MONEYLINE":
        new, old = odds.no_vig(latest["home_american"], latest["away_american"]), odds.no_vig(opening["home_american"], opening["away_american"])
        first, second = (new[i] < old[i] - 0.003 for i in (0, 1))
    else:
        change = latest["line"] - opening["line"]
        up, down = change >= 0.5, change <= -0.5
        first, second = (up, down) if market == "SPREAD" else (down, up)
    differs = latest["seq"] != opening["seq"]
    return F.struct(
        F.lit(market).alias("market"),
        F.coalesce(differs & first, F.lit(False)).alias("toward_first"),
        F.coalesce(differs & second, F.lit(False)).alias("toward_second"),
        (latest["line"] - opening["line"]).alias("line_move"),
    )


def moving_toward(quotes: DataFrame, cutoff: Column) -> DataFrame:
    """Per game and market whether the market has moved toward each side since opening."""
    return board(quotes, cutoff).select("game_id", F.explode(F.array(*map(movement, MARKETS))).alias("m")).select("game_id", "m.*")


def evaluate(
    t: Tables, controls: RiskControls | None = None, bankroll: float = BANKROLL, weekly_open: float = 0.01, price_minutes: float = 8 * 60,
    feeds: DataFrame | None = None,
) -> DataFrame:
    """One recommendation per game of the slate, at the frozen clock.

    ``feeds`` (feed, status; one row per feed) tells which feeds are down, by default ``t.feed_statuses``.  A
    game with a record observed after the clock is not priced: it is DATA INCOMPLETE and says why.
    """
    controls = controls or RiskControls()
    clock = now()
    facts = priced_slate(game_facts(t.game_events, clock), t.predictions, t.manual_prices, clock)
    moves = F.element_at(F.map_from_entries(F.array(*(F.struct(F.lit(m), movement(m)) for m in MARKETS))), F.col("best.market"))
    facts = facts.withColumn("best", best_of(F.col("candidates"))).select(
        "game_id", "best.*", F.col("spread.observed_at").alias("spread_at"), F.col("spread.line").alias("market_line"), moves.alias("move"),
        "late_quote_at", "late_injury_at", "awaiting", "failed", "model_id", "mu", "sd", "completeness",
    )
    available = slate.availability_summary(t.availability, ["game_id"], clock).withColumnRenamed("late_at", "late_availability_at")
    names = t.players.select(F.col("player_id").alias("doubtful_id"), "player")
    available = available.withColumn("doubtful_id", F.col("doubtful.player_id")).join(names, "doubtful_id", "left")
    seen = F.col("observed_at") <= clock
    weather = t.weather.groupBy("game_id").agg(
        F.max_by(F.when(seen, F.struct("severity", "wind")), F.when(seen, F.struct("observed_at", "seq"))).alias("weather"),
        pit.first_violation(clock, F.col("observed_at"), F.col("seq")).alias("late_weather_at"),
    )
    open_ = t.positions.where(F.col("result") == "PENDING")
    by_game = open_.groupBy("game_id").agg(F.sum("stake").cast("double").alias("game_open"))
    by_team = open_.groupBy(F.col("team").alias("backed_team")).agg(F.sum("stake").cast("double").alias("team_open"))
    models = t.models.select("model_id", F.col("status").alias("model_status"), "approved_at")
    rows = t.games
    for side in (facts, available, weather, slate.components_disagree(t.components, "game_id"), by_game):
        rows = rows.join(side, "game_id", "left")
    rows = rows.withColumns({"severity": F.col("weather.severity"), "wind": F.col("weather.wind")})
    backed = F.when(F.col("selection") == "HOME", F.col("home_team")).when(F.col("selection") == "AWAY", F.col("away_team"))
    rows = rows.withColumn("backed_team", backed).join(by_team, "backed_team", "left").join(models, "model_id", "left")
    rows = lookup(rows, teams(t.spark), "backed_team", "team_id", {"name": "backed_name"})
    # One row at most: a feed has one status.
    feeds = t.feed_statuses if feeds is None else feeds
    down = feeds.where((F.col("feed") == "injury") & (F.col("status") == "MISSING")).groupBy("feed").agg(F.lit(True).alias("injury_feed_down"))
    rows = rows.withColumn("feed", F.lit("injury")).join(F.broadcast(down), "feed", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / bankroll if bankroll > 0 else F.lit(0.0)
    rows = rows.withColumns({"game_pct": share("game_open"), "team_pct": share("team_open")})
    return _decided(rows, controls, bankroll, weekly_open, clock, price_minutes)


def _violation(clock: Column) -> Column:
    """Message of the first lookahead violation of a game, in the order in which feeds are checked; else NULL."""
    checks = (("odds snapshots", "late_quote_at"), ("weather snapshots", "late_weather_at"), ("injury reports", "late_injury_at"), ("availability snapshots", "late_availability_at"))
    return F.coalesce(*(pit.violation_message(context, F.col("game_id"), F.col(at), clock) for context, at in checks))


def _decided(rows: DataFrame, rc: RiskControls, bankroll: float, weekly: float, clock: Column, price_minutes: float) -> DataFrame:
    false, edge = F.lit(False), F.coalesce("edge", F.lit(-1.0))
    flag = lambda c: F.coalesce(F.col(c), false)
    outdoor = F.col("roof").isin("OUTDOOR", "RETRACTABLE_OPEN")
    manual_age = age_minutes(F.col("manual_at"), clock)
    checks = {
        "quarterback_resolved": ~flag("quarterback_unresolved"),
        "injury_feed_available": ~flag("injury_feed_down"),
        "market_price_fresh": F.coalesce(age_minutes(F.col("spread_at"), clock) <= price_minutes, false),
        "manual_price_confirmed": F.lit(True),  # unconfirmed prices are never taken
        "kickoff_consistent": F.lit(True),
        "venue_consistent": F.lit(True),
        "weather_available": ~outdoor | F.col("severity").isNotNull(),
        "model_approved": F.coalesce(F.col("model_status") == "APPROVED_DEMO", false) & pit.model_usable(F.col("approved_at"), clock),
        "prediction_timestamp": F.col("mu").isNotNull(),
        "feature_snapshot": F.col("mu").isNotNull(),
        "provider_healthy": ~flag("failed"),
    }
    flags = {
        "exposure_exceeded": (F.lit(weekly) >= rc.weekly) | (F.col("game_pct") >= rc.per_game) | (F.col("team_pct") >= rc.per_team) | (F.col("game_pct") >= rc.per_cluster),
        "aligned": F.when(F.col("edge").isNotNull(), F.abs("edge") < 0.005).otherwise(True),
        "components_disagree": flag("components_disagree"),
    }
    toward = F.when(F.col("selection").isin("HOME", "OVER"), F.col("move.toward_first")).otherwise(F.col("move.toward_second"))
    watch = {
        "better_price": (edge >= rc.min_edge * 0.6) & (edge < rc.min_edge),
        "injury_uncertain": flag("injury_uncertain"),
        "weather_uncertain": F.col("severity").isin("HIGH", "CRITICAL"),
        "near_threshold": F.abs(edge - rc.min_edge) < 0.005,
        "moving": toward,
        "awaiting_update": F.col("awaiting"),
    }
    decision = rules.decide(checks, F.coalesce("completeness", F.lit(0.0)), F.coalesce("ev", F.lit(-1.0)), edge, F.coalesce("sd", F.lit(99.0)), flags, watch, rc)
    fresh = F.coalesce(manual_age <= rc.max_price_age, false)
    rows = rows.withColumn("decision", rules.downgrade_without_manual_price(decision, fresh))
    rows = with_stake(
        rows, F.col("conservative_p"), F.col("american"), F.col("push_p"), F.lit(bankroll), rc, 0.85, F.col("completeness"), 0.9,
        F.col("game_pct"), F.col("team_pct"), F.col("game_pct"), weekly,
    )
    rows = rows.withColumn("decision", rules.pass_below_minimum(F.col("decision"), F.col("stake"))).withColumn("violation", _violation(clock))
    integrity = F.struct(F.lit("DATA INCOMPLETE").alias("status"), F.array(F.concat(F.lit("Point-in-time integrity violation: "), "violation")).alias("reasons"))
    rows = rows.withColumn("decision", F.when(F.col("violation").isNotNull(), integrity).otherwise(F.col("decision")))
    sound = F.col("violation").isNull()
    of = lambda c, default: F.when(sound, F.coalesce(c if isinstance(c, Column) else F.col(c), default)).otherwise(default)
    kept = lambda c: F.when(sound, c if isinstance(c, Column) else F.col(c))
    status, zero = F.col("decision.status"), F.lit(0.0)
    staked = lambda c: F.when(status == "BET", F.col(f"stake.{c}"))
    texts = lambda c, when=True: F.when(sound & when, F.concat_ws("; ", c)).otherwise("")
    supporting, opposing = _narrative(rc)
    return rows.select(
        "game_id",
        F.when(F.col("mu").isNotNull(), F.concat(F.lit("pred_"), F.col("game_id").cast("string"))).otherwise("missing").alias("prediction_id"),
        kept("manual_id").alias("manual_price_id"),
        status.alias("status"),
        F.concat_ws("; ", "decision.reasons").alias("reasons"),
        of("market", F.lit("SPREAD")).alias("market"),
        of("selection", F.lit("HOME")).alias("selection"),
        kept("backed_name").alias("team"),
        kept("line").alias("line"),
        of("american", F.lit(-110).cast("long")).alias("american"),
        *(of(c, zero).alias(c) for c in ("model_p", "conservative_p", "market_p", "break_even_p", "edge", "ev", "push_p")),
        of("fair_american", F.lit(0).cast("long")).alias("fair_american"),
        of(odds.confidence(F.col("completeness"), F.col("edge")), F.lit("LOW")).alias("confidence"),
        staked("pct").alias("stake_pct"),
        staked("amount").alias("stake_amount"),
        staked("bound").alias("stake_bound"),
        kept(odds.target_price(F.col("fair_american"))).alias("target_price"),
        kept(odds.invalidation_price(F.col("american"))).alias("invalidation_price"),
        texts(supporting).alias("supporting"),
        texts(opposing).alias("opposing"),
        texts(F.col("decision.reasons"), status == "PASS").alias("reasons_to_pass"),
        texts(_invalidation()).alias("invalidation"),
    )


def _invalidation() -> Column:
    """What would invalidate a recommendation."""
    target = F.when(F.col("market") == "TOTAL", "total").otherwise("spread")
    return F.array(
        F.lit("Starting quarterback status changes"),
        F.concat(F.lit("Line moves past "), target, F.lit(" target")),
        F.lit("Manual price confirmation older than 60 minutes at decision time"),
        F.lit("Any critical feed failure affecting this game"),
    )


def _narrative(rc: RiskControls) -> tuple[Column, Column]:
    """Texts of the supporting and opposing factors; none without a candidate."""
    percent = lambda c, digits: format_percent(c, digits)
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    priced, doubtful = F.col("market").isNotNull(), F.col("doubtful")
    lines = lambda *pairs: F.array_compact(F.array(*(F.when(priced & c, text) for c, text in pairs)))
    margin, line = F.format_string("%.1f", F.abs("mu")), plain_number(F.coalesce("market_line", F.lit(0.0)))
    supporting = lines(
        ((F.abs("mu") > 0.1) & (F.col("market") == "SPREAD"), join("Opponent-adjusted team strength favors ", F.col("backed_name"), " by ", margin, " points vs market ", line)),
        (F.col("edge") > 0.015, join("Market disagreement: conservative probability ", percent(F.col("conservative_p"), 1), " vs break-even ", percent(F.col("break_even_p"), 1))),
    )
    name = F.coalesce("player", F.lit("starter"))
    opposing = lines(
        (doubtful.isNotNull(), join("Replacement-player concern: ", name, " (", doubtful["position"], ") active probability ", percent(doubtful["active_probability"], 0))),
        (~F.col("severity").isin("LOW", "NONE"), join("Weather risk: wind ", plain_number(F.col("wind")), " mph, severity ", F.col("severity"))),
        (F.col("manual_id").isNull(), F.lit("Price is mock consensus, not a manually confirmed book price")),
        (F.col("game_open") > 0, join("Existing exposure on this game: ", percent(F.col("game_pct"), 2), f" of bankroll (cap {rc.per_game * 100:.2f}%)")),
        ((F.col("team_open") > 0) & F.col("backed_name").isNotNull(), join("Existing weekly exposure to ", F.col("backed_name"), ": ", percent(F.col("team_pct"), 2), f" of bankroll (cap {rc.per_team * 100:.2f}%)")),
        (F.lit(True), F.lit("Demo thresholds are not historically validated")),
    )
    return supporting, opposing
