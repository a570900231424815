"""Hand-computed values of the column functions."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.functions import distributions as dist
from pricewright.functions import odds, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: odds.american_to_decimal(L(150)), 2.5),
        (lambda: odds.american_to_decimal(L(-200)), 1.5),
        (lambda: odds.american_to_decimal(L(-110)), 1 + 100 / 110),
        (lambda: odds.implied_probability(L(300)), 0.25),
        (lambda: odds.implied_probability(L(-150)), 0.6),
        (lambda: odds.fair_american(L(0.5)), 100),
        (lambda: odds.fair_american(L(0.6)), -150),
        (lambda: odds.fair_american(L(0.25)), 300),
        (lambda: odds.fair_american(L(2 / 3)), -200),
        (lambda: odds.decimal_to_american(L(2.5)), 150),
        (lambda: odds.decimal_to_american(L(1.5)), -200),
        (lambda: odds.decimal_to_american(L(2.0)), 100),
        (lambda: odds.expected_value(L(0.5), L(100), 0.1), 0.1),
        (lambda: odds.full_kelly(L(0.55), L(100)), 0.1),
        (lambda: odds.full_kelly(L(0.5), L(-110)), 0.0),
        (lambda: odds.fractional_kelly(L(0.55), L(100), 0.25), 0.025),
        (lambda: odds.closing_line_value(L(0.5), L(0.55)), 5.0),
        (lambda: odds.settlement_delta(L(110.0), L(-110), L("WIN")), 100.0),
        (lambda: odds.settlement_delta(L(50.0), L(150), L("LOSS")), -50.0),
        (lambda: odds.settlement_delta(L(50.0), L(150), L("PUSH")), 0.0),
        (lambda: odds.payout(L(100.0), L(150), L("WIN")), 250.0),
        (lambda: odds.round_cents(L(1.005)), 1.0),
        (lambda: odds.round_half_up(L(-2.5)), -2),
        (lambda: odds.break_even(L(100), 0.1), 0.45),
        (lambda: odds.second_price(L(-105)), -115),
        (lambda: odds.with_vig(L(0.5), 0.02), -108),
    ],
)
def test_odds(spark, column, expected):
    assert one(spark, column()) == pytest.approx(expected)


@pytest.mark.parametrize("bad", [0, 50, -99, float("nan")])
def test_invalid_odds_are_null(spark, bad):
    assert one(spark, odds.american_to_decimal(L(bad))) is None
    assert one(spark, odds.full_kelly(L(0.5), L(bad))) is None


def test_invalid_probabilities_are_null(spark):
    assert one(spark, odds.expected_value(L(0.7), L(100), 0.4)) is None
    assert one(spark, odds.expected_value(L(1.2), L(100))) is None
    assert one(spark, odds.fair_american(L(1.0))) is None
    assert one(spark, odds.fractional_kelly(L(0.6), L(100), 0.0)) is None


def test_no_vig(spark):
    assert one(spark, odds.no_vig_array(F.array(L(-110), L(-110)))) == [0.5, 0.5]
    assert one(spark, odds.no_vig_array(F.array(L(-110)))) is None
    assert one(spark, odds.overround(L(-110), L(-110))) == pytest.approx(220 / 210 - 1)


def test_distributions(spark):
    d = dist.margin_distribution(L(3.0), L(13.0))
    rows = one(spark, d)
    assert len(rows) == 90 and all(r["value"] != 0 for r in rows)
    assert sum(r["probability"] for r in rows) == pytest.approx(1)
    at = {r["value"]: r["probability"] for r in rows}
    assert at[3] > at[2] and at[3] > at[4]
    o = one(spark, dist.spread_outcomes(d, L(-3.0)))
    assert o["push"] == pytest.approx(at[3]) and o["cover"] + o["push"] + o["lose"] == pytest.approx(1)
    assert one(spark, dist.spread_outcomes(d, L(-3.5)))["push"] == 0
    assert len(one(spark, dist.total_distribution(L(45.0), L(10.0)))) == 81
    assert one(spark, dist.margin_to_win_probability(L(0.0))) == pytest.approx(0.5, abs=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.floats(-4, 4))
def test_erf(spark, x):
    assert one(spark, dist.erf(L(x))) == pytest.approx(math.erf(x), abs=2e-7)


def test_freshness(spark):
    now = L("2024-01-02 00:00:00").cast("timestamp")
    of = lambda minutes: one(spark, times.classify_freshness(times.minutes_before(now, minutes), now, 30, 120))
    assert [of(15), of(30), of(60), of(240), of(-5)] == ["CURRENT", "CURRENT", "AGING", "STALE", "CONFLICTING"]
    assert one(spark, times.classify_freshness(L(None).cast("timestamp"), now, 30, 120)) == "MISSING"
    assert one(spark, times.classify_freshness(now, now, 30, 120, True)) == "CONFLICTING"
    worst = lambda *s: spark.createDataFrame([(x,) for x in s], "s string").agg(times.worst_freshness(F.col("s")).alias("w")).first()["w"]
    assert worst("CURRENT", "AGING", "STALE") == "STALE" and worst() == "CURRENT"


def test_formats(spark):
    assert one(spark, text.format_line(L(None).cast("double"))) == "—"
    assert [one(spark, text.format_line(L(x))) for x in (0.0, 3.5, -7.0)] == ["PK", "+3.5", "-7"]
    assert one(spark, text.format_market_line(L("TOTAL"), L(45.5))) == "45.5"
    assert [one(spark, text.ordinal(L(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert one(spark, text.format_money(L(1234.5))) == "$1,234.50"
    assert one(spark, text.format_signed_percent(L(0.0215))).endswith("%")
    assert one(spark, text.format_odds(L(150))) == "+150"
    assert one(spark, text.roof_label(L("DOME"))) == "Dome"
    now = L("2024-01-10 00:00:00").cast("timestamp")
    ago = lambda m: one(spark, times.format_ago(times.minutes_before(now, m), now))
    assert [ago(0), ago(59), ago(61), ago(47 * 60), ago(72 * 60)] == ["just now", "59m ago", "1h 1m ago", "47h 0m ago", "3d ago"]
    assert one(spark, times.format_kickoff(L("2024-01-10 18:00:00").cast("timestamp"), "America/New_York")) == "Wed, Jan 10, 1:00 PM"


def test_labels_of_unknown_games_and_models(spark):
    df = spark.createDataFrame([("Sea", "Bay", 1, "m", "1.0", 4), (None, "Bay", 2, None, None, 4), (None, None, 3, None, None, None)], "a string, h string, g int, n string, v string, m int")
    labels = df.select(text.long_game_label(F.col("a"), F.col("h"), F.col("g")), text.model_label(F.col("n"), F.col("v"), F.col("m"))).collect()
    assert [tuple(r) for r in labels] == [("Sea at Bay", "m 1.0"), ("2", "4"), ("3", text.MISSING)]
