"""Behaviour of the operators on small hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricewright.operators import guards, ledger, lookups, metrics, rules, slate
from pricewright.operators import pointintime as pit
from pricewright.operators.staking import RiskControls, stake_input_errors, with_stake
from pricewright.plans.slate import evaluate
from pricewright.sources.tables import Tables
from tests.conftest import DATA

TS = "cast('2024-01-{:02d} 00:00:00' as timestamp)"


def at(day):
    return F.expr(TS.format(day))


@pytest.fixture(scope="module")
def observed(spark):
    rows = [("a", "1", 1, 1), ("a", "2", 3, 2), ("a", "1x", 3, 3), ("a", None, 3, 4), ("a", "9", 9, 5), ("b", "5", 9, 6), ("c", None, None, 7)]
    df = spark.createDataFrame(rows, "k string, id string, day int, seq long")
    return df.withColumn("observed_at", F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))).drop("day")


def test_latest_at_cutoff_breaks_ties_by_greatest_id(observed):
    rows = pit.latest_at_cutoff(observed, ["k"], at(3)).collect()
    assert [(r["k"], r["id"]) for r in rows] == [("a", "2")]


def test_latest_snapshot_breaks_ties_by_input_order(observed):
    assert pit.latest_snapshot(observed, ["k"], at(3)).first()["seq"] == 4
    assert {r["k"]: r["seq"] for r in pit.latest_snapshot(observed.dropna(subset=["observed_at"]), ["k"]).collect()} == {"a": 5, "b": 6}


def test_cutoff_is_inclusive_and_null_is_unusable(spark, observed):
    assert observed.where(pit.usable_at(F.col("observed_at"), at(3))).count() == 4
    row = spark.range(1).select(
        pit.model_usable(F.lit(None).cast("timestamp"), at(3)).alias("m"), pit.forecast_usable(at(3), at(4), at(3)).alias("f"),
        pit.forecast_usable(at(3), at(3), at(3)).alias("g"), pit.result_usable(at(2), at(3)).alias("r"),
    ).first()
    assert (row["m"], row["f"], row["g"], row["r"]) == (False, False, True, True)


def test_lookahead(observed):
    rows = pit.lookahead_by_key(observed, ["k"], at(3), "odds").collect()
    assert {r["k"]: r["violations"] for r in rows} == {"a": 1, "b": 1}
    with pytest.raises(Exception, match="observed after the cutoff"):
        pit.assert_no_lookahead(observed, at(3), "odds").collect()
    assert pit.assert_no_lookahead(observed.where("observed_at <= '2024-01-03'"), at(3), "odds").count() == 4


def test_asof_join_carries_the_last_row_forward(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "z", 9)], "probe long, k string, t int")
    right = spark.createDataFrame([("a", 2, 10, 1.0), ("a", 5, 11, 2.0), ("a", 5, 12, None), ("a", 6, 13, 4.0), ("b", 9, 14, 5.0)], "k string, u int, seq long, v double")
    rows = pit.asof_join(left, right, ["k"], "t", "u", "probe", "seq").collect()
    assert {r["probe"]: (r["r_seq"], r["r_v"]) for r in rows} == {1: (12, None), 2: (None, None), 3: (14, 5.0), 4: (None, None)}


def test_new_vintages_may_not_clash_with_each_other(spark):
    schema = "prediction_id string, game_id int, vintage string, model int"
    history = spark.createDataFrame([("p0", 1, "OPEN", 1)], schema)
    new = spark.createDataFrame([("p1", 2, "OPEN", 1), ("p1", 2, "OPEN", 1), ("p2", 2, "OPEN", 1), ("p3", 3, "OPEN", 1), ("p0", 3, "OPEN", 2), ("p4", 1, "OPEN", 1)], schema)
    conflicts = sorted((r["prediction_id"], r["conflict"]) for r in ledger.vintage_conflicts(history, new).collect())
    assert conflicts == [("p0", "prediction exists"), ("p1", "prediction exists"), ("p2", "vintage exists"), ("p4", "vintage exists")]
    assert sorted(r["prediction_id"] for r in ledger.append_vintages(history, new).collect()) == ["p0", "p1", "p3"]


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_running_values_over_ranges(spark, ranges):
    data = [(None if i % 5 == 0 else "ab"[i % 2], i, None if i % 7 == 0 else (i * 37) % 11 - 5) for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = {r["i"]: (r["s"], r["n"], r["m"]) for r in metrics.spread_running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "m": ("max", F.col("v"))}, ranges).collect()}
    for k, i, _ in data:
        before = [v for other, j, v in data if other == k and j <= i]
        known = [v for v in before if v is not None]
        assert got[i] == (sum(known) if known else None, len(before), max(known, default=None))


class WithLateQuote(Tables):
    """Two games have a quote after the clock."""

    @property
    def quotes(self):
        rows = super().quotes
        first = rows.groupBy("game_id").agg(F.min("seq").alias("seq")).orderBy("game_id").limit(2)
        moved = rows.join(first, ["game_id", "seq"], "left_semi").withColumn("observed_at", F.lit("2024-02-01 10:00:00").cast("timestamp"))
        return rows.join(first, ["game_id", "seq"], "left_anti").unionByName(moved)


def test_games_with_late_records_are_reset_and_the_others_priced(spark):
    usual = {r["game_id"]: r for r in evaluate(Tables(spark, f"{DATA}/sf0.001")).collect()}
    got = {r["game_id"]: r for r in evaluate(WithLateQuote(spark, f"{DATA}/sf0.001")).collect()}
    late = {g: r for g, r in got.items() if "integrity" in r["reasons"]}
    assert 1 <= len(late) <= 2 and set(got) == set(usual)
    for g, r in late.items():
        assert r["reasons"] == (
            f"Point-in-time integrity violation: odds snapshots for {g}: record observed at 2024-02-01T10:00:00.000Z "
            "is after prediction cutoff 2024-01-31T00:00:00.000Z. Future information must never enter a historical prediction."
        )
        assert (r["status"], r["market"], r["selection"], r["american"], r["edge"], r["ev"]) == ("DATA INCOMPLETE", "SPREAD", "HOME", -110, 0.0, 0.0)
        assert r["stake_pct"] is None and r["target_price"] is None and r["line"] is None and not r["supporting"] and not r["opposing"] and not r["invalidation"]
    assert all(got[g] == usual[g] for g in got if g not in late)


def test_exposure_is_told(spark):
    rows = evaluate(Tables(spark, f"{DATA}/sf0.001"), bankroll=1000.0).where("opposing LIKE '%Existing exposure on this game%'").collect()
    assert rows and all("Portfolio exposure would exceed a limit" in r["reasons"] or r["status"] == "DATA INCOMPLETE" for r in rows if "cap 1.00%" in r["opposing"] and r["status"] != "WATCH")


def test_invalid_stake_inputs_give_no_stake(spark):
    assert stake(spark, uncertainty=1.5) is None and stake(spark, quality=-0.1) is None and stake(spark) is not None


def test_opening_is_first_in_input_order(spark):
    df = spark.createDataFrame([("g", 2, True), ("g", 1, True), ("g", 0, False)], "k string, seq long, is_opening boolean").withColumn("observed_at", at(1))
    assert pit.opening_snapshot(df, ["k"]).first()["seq"] == 1


def stake(spark, p=0.56, **more):
    given = {"uncertainty": 1.0, "quality": 1.0, "calibration": 1.0} | more
    return with_stake(spark.range(1), F.lit(p), F.lit(-110), F.lit(0.0), F.lit(10000.0), RiskControls(), **given).first()["stake"]


def test_stake_is_the_tightest_cap_and_names_it(spark):
    s = stake(spark)
    assert (s["pct"], s["amount"], s["bound"]) == (0.005, 50.0, "Per-bet cap")
    s = stake(spark, game=0.008)
    assert (round(s["pct"], 9), s["bound"]) == (0.002, "Same-game cap")
    s = stake(spark, weekly=0.04)
    assert (s["pct"], s["bound"]) == (0.0, "Weekly open-stake cap")
    s = stake(spark, p=0.5)
    assert (s["pct"], s["bound"]) == (0.0, "No positive Kelly stake")
    assert stake(spark, p=1.5) is None


def test_first_of_equal_caps_wins(spark):
    assert stake(spark, game=0.005)["bound"] == "Per-bet cap"


def test_stake_input_errors(spark):
    row = spark.range(1).select(stake_input_errors(F.lit(1.2), F.lit(None).cast("double"), F.lit(0.0), F.lit(-1.0)).alias("e")).first()
    assert row["e"] == ["uncertaintyMultiplier", "dataQualityMultiplier", "bankroll"]


def decided(spark, checks=None, completeness=0.95, ev=0.04, edge=0.035, std=13.2, flags=None, watch=None, eligible=True):
    lit = lambda d: {k: F.lit(v) for k, v in (d or {}).items()}
    base = {name: True for name, _ in rules.CHECKS} | (checks or {})
    d = rules.decide(lit(base), F.lit(completeness), F.lit(ev), F.lit(edge), F.lit(std), lit(flags), lit(watch), RiskControls(), eligible)
    return spark.range(1).select(d.alias("d")).first()["d"]


def test_decision_precedence(spark):
    assert decided(spark)["status"] == "BET" and len(decided(spark)["reasons"]) == 7
    d = decided(spark, checks={"venue_consistent": False}, edge=0.0, watch={"moving": True})
    assert (d["status"], d["reasons"]) == ("DATA INCOMPLETE", ["Venue conflict"])
    d = decided(spark, completeness=0.8)
    assert d["reasons"] == ["Data-completeness score 0.80 below minimum 0.85"]
    d = decided(spark, edge=0.015)
    assert (d["status"], d["reasons"]) == ("PASS", ["Edge 1.5% below required threshold 2.0% (demo threshold)"])
    d = decided(spark, edge=0.015, watch={"better_price": True})
    assert d["status"] == "WATCH" and d["reasons"][0] == "Selection would qualify at a better price" and len(d["reasons"]) == 2
    assert decided(spark, edge=0.015, std=16.0, watch={"better_price": True})["status"] == "PASS"
    assert decided(spark, flags={"aligned": True}, watch={"moving": True})["status"] == "PASS"
    assert decided(spark, flags={"price_too_bad": True}, watch={"moving": True})["status"] == "WATCH"
    assert decided(spark, eligible=False)["reasons"] == [rules.INELIGIBLE]
    assert decided(spark, watch={"awaiting_update": True})["status"] == "WATCH"


def test_downgrades(spark):
    bet = F.struct(F.lit("BET").alias("status"), F.array(F.lit("x")).alias("reasons"))
    one = lambda c: spark.range(1).select(c.alias("d")).first()["d"]
    assert one(rules.downgrade_without_manual_price(bet, F.lit(False)))["status"] == "WATCH"
    assert one(rules.downgrade_without_manual_price(bet, F.lit(True)))["status"] == "BET"
    small = F.struct(F.lit(0.5).alias("amount"), F.lit("Same-game cap").alias("bound"))
    d = one(rules.pass_below_minimum(bet, small))
    assert d["status"] == "PASS" and d["reasons"][0].startswith("Remaining risk-limit room ($0.50)")


def test_metrics(spark):
    half = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, outcome int")
    row = half.agg(metrics.log_loss(F.col("p"), F.col("outcome")).alias("l"), metrics.brier(F.col("p"), F.col("outcome")).alias("b"), metrics.calibration_line(F.col("p"), F.col("outcome"))[0].alias("s")).first()
    assert row["l"] == pytest.approx(0.6931471805599453) and row["b"] == 0.25 and row["s"] is None
    empty = half.limit(0).agg(metrics.log_loss(F.col("p"), F.col("outcome")).alias("l")).first()
    assert empty["l"] is None
    edges = spark.createDataFrame([(0.57,), (0.6,), (0.3,), (1.0,), (0.0,), (1.01,), (None,)], "p double")
    assert [r["b"] for r in edges.select(metrics.bin_index(F.col("p"), 100).alias("b")).collect()] == [57, 60, 30, 99, 0, None, None]
    bins = metrics.calibration_bins(half).orderBy("bin").collect()
    assert len(bins) == 10 and bins[5]["n"] == 2 and bins[0]["observed"] is None and bins[0]["mean_predicted"] == pytest.approx(0.05)


def test_drawdown(spark):
    curve = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate((100, 120, 90, 110))], "k string, point int, balance double")
    assert metrics.max_drawdown(curve, ["k"]).first()["max_drawdown"] == pytest.approx(0.25)


def test_slices_show_empty_ones(spark):
    df = spark.createDataFrame([(0.6, 1, 0.05, 0.0, "BET")], "p double, outcome int, edge double, clv double, status string")
    rows = {(r["slice"], r["name"]): r["n"] for r in metrics.slice_tables(df).collect()}
    assert len(rows) == 7 and rows[("edge", "≥3%")] == 1 and rows[("status", "PASS")] == 0


def bets(spark):
    return spark.createDataFrame([(1, 100.0, 150, "PENDING"), (2, 50.0, -110, "WIN"), (3, 20.0, -110, "PENDING")], "bet_id int, stake double, american int, result string")


def test_settlement(spark):
    todo = spark.createDataFrame([(1, "WIN"), (2, "LOSS"), (9, "WIN"), (3, "MAYBE")], "bet_id int, new_result string")
    rows = {r["bet_id"]: r for r in ledger.settle(bets(spark), todo).collect()}
    assert float(rows[1]["delta"]) == 150.0 and float(rows[1]["payout"]) == 250.0
    assert [rows[i]["error"] for i in (2, 9, 3)] == ["already settled", "unknown bet", "invalid result"]


def test_a_bet_settles_once_in_a_batch(spark):
    schema = "bet_id int, new_result string, settled_at string, closing_american int"
    todo = spark.createDataFrame([(1, "WIN", "b", 120), (1, "WIN", "a", 120), (3, "LOSS", "a", None)], schema)
    rows = {(r["bet_id"], r["settled_at"]): r for r in ledger.settle(bets(spark), todo).collect()}
    assert rows[(1, "b")]["error"] == "already settled" and rows[(1, "b")]["delta"] is None
    assert float(rows[(1, "a")]["delta"]) == 150.0 and rows[(1, "a")]["clv"] == pytest.approx((100 / 220 - 100 / 250) * 100)
    assert rows[(3, "a")]["clv"] is None


def test_fold_takes_the_last_valid_result(spark):
    events = spark.createDataFrame(
        [(1, 1, "SETTLED", "WIN"), (1, 2, "CORRECTED", "WIN"), (1, 3, "CORRECTED", "PUSH"), (3, 1, "CORRECTED", "WIN")], "bet_id int, seq int, event_type string, result string"
    )
    rows = {r["bet_id"]: r for r in ledger.fold_results(bets(spark), events).collect()}
    assert (rows[1]["result"], rows[1]["corrections"], float(rows[1]["delta"])) == ("PUSH", 1, 0.0)
    assert rows[3]["result"] == "PENDING" and rows[2]["result"] == "PENDING"


def test_corrections_and_balance(spark):
    todo = spark.createDataFrame([(2, "PUSH"), (1, "WIN")], "bet_id int, new_result string")
    rows = {r["bet_id"]: r for r in ledger.corrections(bets(spark), todo).collect()}
    assert float(rows[2]["reversal"]) == -45.45 and float(rows[2]["applied"]) == 0.0 and rows[1]["error"] == "not settled"


def test_place_bets(spark):
    df = spark.createDataFrame(
        [("u", "g", "SPREAD", "HOME", -110, 50.0, "PAPER", 1), ("u", "g", "SPREAD", "HOME", -110, 0.0, "PAPER", 2), ("u", "g", "SPREAD", "HOME", -110, 5000.0, "PAPER", 3)],
        "user_id string, game_id string, market string, selection string, american int, stake double, mode string, seq int",
    ).withColumn("placed_at", at(1))
    good, events, audit, bad = ledger.place_bets(df, 1000.0)
    assert good.count() == 1 and events.first()["event_type"] == "PLACED" and audit.first()["action"] == "BET_PLACED"
    assert {tuple(r["errors"]) for r in bad.collect()} == {("Stake must be positive.",), ("Stake exceeds available bankroll.",)}


def test_vintages(spark):
    schema = "prediction_id string, game_id int, vintage string, model int"
    history = spark.createDataFrame([("p1", 1, "OPEN", 1)], schema)
    new = spark.createDataFrame([("p1", 2, "OPEN", 1), ("p2", 1, "OPEN", 1), ("p3", 1, "FINAL", 1)], schema)
    assert {r["prediction_id"]: r["conflict"] for r in ledger.vintage_conflicts(history, new).collect()} == {"p1": "prediction exists", "p2": "vintage exists"}
    assert {r["prediction_id"] for r in ledger.append_vintages(history, new).collect()} == {"p1", "p3"}


def test_guards(spark):
    df = spark.createDataFrame([("u", 1), ("v", 2), (None, 3)], "user_id string, bet_id int")
    assert guards.visible_to(df, "u").count() == 1 and guards.visible_to(df, "u", shared=True).count() == 2
    assert guards.visible_children(df.select("bet_id"), df, "v", "bet_id").first()["bet_id"] == 2
    changed = df.where("bet_id < 3").withColumn("user_id", F.when(F.col("bet_id") == 1, "w").otherwise(F.col("user_id")))
    assert {r["bet_id"]: r["mutation"] for r in guards.mutated_rows(df, changed, "bet_id").collect()} == {1: "updated", 3: "deleted"}
    report = {r["check"]: r["failures"] for r in guards.constraint_report(df, {"positive": F.col("bet_id") > 1, "null": F.col("user_id") != "x"}).collect()}
    assert report == {"positive": 1, "null": 0}
    row = spark.range(1).select(guards.real_mode_errors(F.lit(0.0), F.lit(None).cast("boolean")).alias("e")).first()
    assert len(row["e"]) == 2


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    dim = spark.createDataFrame([("a", "A")], "id string, name string")
    rows = {r["k"]: r["label"] for r in lookups.lookup(df, dim, "v", "id", {"name": "label"}, {"label": F.lit("—")}).collect()}
    assert rows == {1: "A", 2: "—"}
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, seq int")
    assert lookups.last_write_wins(twice, ["k"]).first()["v"] == "y"
    assert lookups.append_missing(df, spark.createDataFrame([(2, "n"), (3, "n"), (3, "m")], "k int, v string"), ["k"]).count() == 3


def test_components_disagree(spark):
    df = spark.createDataFrame([("a", 0.5, False, 1.0), ("a", 0.5, False, 8.0), ("b", 0.5, False, 1.0), ("b", 0.0, False, 9.0), ("b", 0.5, True, 99.0)], "k string, weight double, placeholder boolean, margin double")
    assert {r["k"]: r["components_disagree"] for r in slate.components_disagree(df, "k").collect()} == {"a": True, "b": False}
