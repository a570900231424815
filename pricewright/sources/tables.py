"""Base tables and the domain views over them.

The views map generic order, event and part tables to quotes, predictions, prices and
positions, so that every operator can run and be checked on them.  The clock is frozen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricewright.functions.distributions import margin_to_win_probability, weather_severity
from pricewright.functions.odds import break_even, settlement_delta
from pricewright.functions.times import FEED_THRESHOLDS, classify_freshness

NOW = "2024-01-31 00:00:00"
CUTOFF = "2024-01-16 00:00:00"
BANKROLL = 10_000_000.0
#: Which event types are markets of a game.
MARKET_OF_EVENT = (("click", "SPREAD"), ("view", "TOTAL"), ("purchase", "MONEYLINE"))
POSITIONS = ("QB", "LT", "C", "WR", "RB", "TE", "CB")
ROOFS = ("OUTDOOR", "RETRACTABLE_OPEN", "DOME", "RETRACTABLE_CLOSED")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def cutoff() -> Column:
    return F.lit(CUTOFF).cast("timestamp")


def hours_before_now(hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now()) - (hours * 3_600_000_000).cast("long"))


@dataclass(frozen=True)
class Tables:
    """Reads base tables of one folder; every property is a view."""

    spark: SparkSession
    folder: str
    schemas: dict[str, StructType] = field(default_factory=dict, compare=False)

    def base(self, name: str) -> DataFrame:
        """A base table; its schema is read from the files once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    @property
    def quotes(self) -> DataFrame:
        """Two-way prices per game and market with input order ``seq``; the first in that order is the opening."""
        return self.base("events").where(F.col("event_type").isin(*(kind for kind, _ in MARKET_OF_EVENT))).select(*_quote_columns())

    @property
    def game_events(self) -> DataFrame:
        """Quotes, injury reports and failures of games, told apart by ``kind``, from one scan.

        A subclass that changes one of these three views is honoured, at the price of a scan for each.
        """
        if any(getattr(type(self), view) is not getattr(Tables, view) for view in ("quotes", "injury_reports", "failures")):
            reports = self.injury_reports.select("game_id", "observed_at", F.col("report_id").alias("seq"), "practice_fri", "designation", F.lit("injury").alias("kind"))
            rows = self.quotes.withColumn("kind", F.lit("quote")).unionByName(reports, allowMissingColumns=True)
            return rows.unionByName(self.failures.select("game_id", F.lit("failure").alias("kind")), allowMissingColumns=True)
        kind = F.when(F.col("event_type") == "signup", "injury").when(F.col("event_type") == "error", "failure").otherwise("quote")
        telling = F.col("event_type").isin(*(kind for kind, _ in MARKET_OF_EVENT), "signup", "error") & ((F.col("event_type") != "error") | (F.col("value") > 200))
        return self.base("events").where(telling).select(kind.alias("kind"), *_quote_columns(), _practice_friday().alias("practice_fri"), _designation().alias("designation"))

    @property
    def feed_log(self) -> DataFrame:
        return self.base("events").select(F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("seq"))

    @property
    def projection(self) -> DataFrame:
        return self.base("part").select(
            F.col("p_partkey").alias("part_id"),
            ((F.col("p_size") - 25) / 3).alias("mu"),
            (10 + (F.col("p_retailprice") - 900) / 20).alias("sd"),
            (38 + F.col("p_size") / 3).alias("total"),
            ((80 + F.col("p_size") % 20) / 100).alias("completeness"),
        )

    @property
    def games(self) -> DataFrame:
        """Parts that are quoted."""
        quoted = self.base("events").where(F.col("event_type").isin(*(e for e, _ in MARKET_OF_EVENT))).select(F.col("user_id").alias("game_id")).distinct()
        roof = F.element_at(F.array(*map(F.lit, ROOFS)), (F.col("p_size") % 4 + 1).cast("int"))
        games = self.base("part").select(
            F.col("p_partkey").alias("game_id"),
            (F.col("p_partkey") % 25).cast("int").alias("home_team"),
            ((F.col("p_partkey") + 7) % 25).cast("int").alias("away_team"),
            roof.alias("roof"),
            F.timestamp_micros(F.unix_micros(now()) + F.col("p_size").cast("long") * 3_600_000_000).alias("kickoff"),
        )
        return games.join(quoted, "game_id", "left_semi")

    @property
    def schedule(self) -> DataFrame:
        """Games with season and week."""
        rows = self.games
        key = F.col("game_id")
        return rows.withColumns({"season": (2023 + key % 2).cast("int"), "week": (F.floor(key / 2) % 18 + 1).cast("int")})

    @property
    def predictions(self) -> DataFrame:
        return self.projection.select(
            F.col("part_id").alias("game_id"),
            (F.col("part_id") % 5).cast("int").alias("model_id"),
            "mu",
            "sd",
            "total",
            (F.col("sd") * 0.75).alias("total_sd"),
            "completeness",
            margin_to_win_probability(F.col("mu")).alias("home_win"),
        )

    @property
    def models(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.base("region").select(
            key.alias("model_id"),
            F.lower("r_name").alias("name"),
            F.concat(F.lit("0."), key, F.lit(".0-demo")).alias("version"),
            F.when(key == 4, "RETIRED").otherwise("APPROVED_DEMO").alias("status"),
            hours_before_now((key + 30) * 24).alias("approved_at"),
        )

    @property
    def manual_prices(self) -> DataFrame:
        key = F.col("o_orderkey")
        market = F.when(key % 3 == 0, "SPREAD").when(key % 3 == 1, "TOTAL").otherwise("MONEYLINE")
        first = F.floor(key / 3) % 2 == 0
        selection = F.when(market == "TOTAL", F.when(first, "OVER").otherwise("UNDER")).otherwise(F.when(first, "HOME").otherwise("AWAY"))
        return self.base("orders").select(
            key.alias("seq"),
            F.col("o_custkey").alias("game_id"),
            market.alias("market"),
            selection.alias("selection"),
            order_american(key).alias("american"),
            F.timestamp_micros(F.unix_micros(now()) - (key % 240) * 60_000_000).alias("entered_at"),
            (F.col("o_orderstatus") != "P").alias("confirmed"),
        )

    @property
    def availability(self) -> DataFrame:
        number = F.col("l_linenumber")
        doubtful = 1 - F.col("l_discount") * 9
        return self.base("lineitem").select(
            (F.col("l_orderkey") * 10 + number).alias("seq"),
            F.col("l_partkey").alias("game_id"),
            F.col("l_suppkey").alias("player_id"),
            F.element_at(F.array(*map(F.lit, POSITIONS)), number).alias("position"),
            F.when(F.col("l_quantity") > 49, doubtful).otherwise(1.0).alias("active_probability"),
            (F.col("l_quantity") / 10).alias("impact"),
            hours_before_now(F.col("l_quantity")).alias("observed_at"),
        )

    @property
    def players(self) -> DataFrame:
        return self.base("supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player"), F.col("s_nationkey").alias("team_id"))

    @property
    def components(self) -> DataFrame:
        """Six weighted components of every prediction; one is a placeholder, one has no weight."""
        weights = enumerate((0.45, 0.11, 0.11, 0.11, 0.11, 0.0))
        c = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("weight")) for i, w in weights))).alias("c")
        return self.projection.select("part_id", "mu", c).select(
            F.col("part_id").alias("game_id"), F.col("c.weight").alias("weight"), (F.col("c.i") == 4).alias("placeholder"),
            (F.col("mu") + (F.col("part_id") * (F.col("c.i") + 1)) % 9).alias("margin"),
        )

    @property
    def feed_statuses(self) -> DataFrame:
        """One row per feed: the class of its latest record at the clock (MISSING without any)."""
        at = F.max(F.when(F.col("observed_at") <= now(), F.col("observed_at"))).alias("at")
        aging, stale = next((a, b) for feed, a, b in FEED_THRESHOLDS if feed == "injury")
        status = classify_freshness(F.col("at"), now(), aging, stale)
        return self.injury_reports.agg(at).select(F.lit("injury").alias("feed"), status.alias("status"))

    @property
    def incidents(self) -> DataFrame:
        """Provider incidents with the games they touch."""
        e = self.base("events").where(F.col("event_type") == "error")
        resolution = F.when(F.col("value") > 200, "FAILED").otherwise("OPEN")
        return e.select(F.col("event_id").alias("incident_id"), resolution.alias("resolution"), F.array("user_id", F.col("user_id") + 3).alias("impacted_game_ids"))

    @property
    def weather(self) -> DataFrame:
        wind = F.floor(F.abs("s_acctbal") / 400).cast("double")
        rain = (F.col("s_suppkey") % 10) / 10
        return self.base("supplier").select(
            F.col("s_suppkey").alias("game_id"),
            wind.alias("wind"),
            weather_severity(wind, rain).alias("severity"),
            hours_before_now(F.col("s_suppkey") % 48).alias("observed_at"),
            F.col("s_suppkey").alias("seq"),
        )

    @property
    def failures(self) -> DataFrame:
        """Games hit by a failed provider."""
        return self.base("events").where((F.col("event_type") == "error") & (F.col("value") > 200)).select(F.col("user_id").alias("game_id")).distinct()

    @property
    def injury_reports(self) -> DataFrame:
        return self.base("events").where(F.col("event_type") == "signup").select(
            F.col("event_id").alias("report_id"),
            F.col("user_id").alias("game_id"),
            (F.col("event_id") % 50).alias("team_id"),
            (F.col("event_id") % 100 + 1).alias("player_id"),
            F.element_at(F.array(*map(F.lit, POSITIONS)), (F.col("event_id") % 7 + 1).cast("int")).alias("position"),
            (F.col("value") / 500).alias("active_probability"),
            F.when(F.col("event_id") % 11 == 0, "sources differ").alias("conflict_warning"),
            F.when(F.col("event_id") % 2 == 0, "FULL").otherwise("LIMITED").alias("practice_wed"),
            F.when(F.col("event_id") % 3 == 0, "DNP").otherwise("FULL").alias("practice_thu"),
            _practice_friday().alias("practice_fri"),
            _designation().alias("designation"),
            F.col("ts").cast("timestamp").alias("observed_at"),
        )

    @property
    def forecasts(self) -> DataFrame:
        """Backtest records: one per order, in order of ``seq``."""
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        p = F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.col("o_totalprice") / 500000))
        american = order_american(key)
        edge = p - break_even(american)
        stake = F.when(edge > 0, order_stake()).otherwise(0.0)
        result = F.when(status == "P", "PUSH").when(status == "F", "WIN").otherwise("LOSS")
        rows = self.base("orders").join(self.base("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            key.alias("seq"),
            F.col("c_mktsegment").alias("segment"),
            p.alias("p"),
            (status == "F").cast("int").alias("outcome"),
            (status == "P").alias("push"),
            american.alias("american"),
            edge.alias("edge"),
            ((key % 21 - 10) / 10).alias("clv"),
            stake.cast("decimal(18,2)").alias("stake"),
            F.coalesce(settlement_delta(stake, american, result), F.lit(0.0)).cast("decimal(18,2)").alias("profit"),
            (key % 5 != 0).alias("within80"),
            F.when(edge >= 0.03, "BET").when(edge >= 0.01, "WATCH").when(key % 12 == 0, "DATA INCOMPLETE").otherwise("PASS").alias("status"),
            F.element_at(F.array(*map(F.lit, ("SPREAD", "TOTAL", "MONEYLINE"))), (key % 3 + 1).cast("int")).alias("market"),
            (key % 4 == 0).alias("indoor"),
            (american < 0).alias("favorite"),
            (key % 72).alias("hours_before"),
            ((80 + key % 20) / 100).alias("completeness"),
            (key % 18 + 1).alias("week"),
        )

    @property
    def positions(self) -> DataFrame:
        """Bets: one per order."""
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        american, stake = order_american(key), order_stake()
        result = F.when(status == "F", F.when(F.floor(key / 7) % 2 == 0, "WIN").otherwise("LOSS")).when(status == "P", "PUSH").otherwise("PENDING")
        customers = self.base("customer").select("c_custkey", "c_nationkey")
        nations = self.base("nation").select("n_nationkey", "n_regionkey")
        rows = self.base("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            key.alias("bet_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_custkey").alias("game_id"),
            F.element_at(F.array(*map(F.lit, ("SPREAD", "TOTAL", "MONEYLINE"))), (F.floor(key / 2) % 3 + 1).cast("int")).alias("market"),
            american.alias("american"),
            stake.cast("decimal(18,2)").alias("stake"),
            result.alias("result"),
            F.coalesce(settlement_delta(stake, american, result), F.lit(0.0)).cast("decimal(18,2)").alias("delta"),
            F.col("c_nationkey").alias("team"),
            F.col("n_regionkey").alias("cluster"),
            F.col("o_orderdate").cast("timestamp").alias("settled_at"),
        )

    @property
    def labels_eval(self) -> DataFrame:
        joined = self.base("labels").join(self.base("documents").select("doc_id", "n_chars"), "doc_id")
        return joined.select("doc_id", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 35000)).alias("p"), F.col("quality").alias("outcome"))


def _quote_columns() -> list[Column]:
    market = F.when(F.col("event_type") == MARKET_OF_EVENT[0][0], MARKET_OF_EVENT[0][1])
    for kind, name in MARKET_OF_EVENT[1:]:
        market = market.when(F.col("event_type") == kind, name)
    k = F.get_json_object("props", "$.k").cast("int")
    price = lambda x: F.when(x < 50, -(100 + x)).otherwise(50 + x)
    return [
        F.col("user_id").alias("game_id"),
        market.alias("market"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
        (F.floor(F.col("value") / 10 * 2 + 0.5) / 2 - 10).alias("line"),
        price(k).alias("home_american"),
        price(99 - k).alias("away_american"),
    ]


def _practice_friday() -> Column:
    return F.when(F.col("value") > 100, "NO_DATA").otherwise("FULL")


def _designation() -> Column:
    return F.when(F.col("event_id") % 2 == 0, "QUESTIONABLE").otherwise("OUT")


def order_american(key: Column) -> Column:
    return F.when(key % 2 == 0, -(100 + key % 60)).otherwise(100 + key % 60)


def order_stake() -> Column:
    return F.floor(F.col("o_totalprice") / 1000 * 100 + 0.5) / 100
