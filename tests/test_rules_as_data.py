"""Policies, digests, the performance cube, folded drawdowns and cumulative mass against plain definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricewright.functions import distributions as dist
from pricewright.functions import times
from pricewright.operators import cube, digests, guards, metrics, policies
from pricewright.sources.tables import Tables
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def test_every_policy_for_owner_other_and_no_owner(spark):
    rows = spark.createDataFrame([("mine", "u", 1, True), ("mine open", "u", 1, False), ("theirs", "w", 2, True), ("none", None, 3, True)], "name string, owner string, bet_id int, confirmed_visible boolean")
    bets = spark.createDataFrame([(1, "u"), (2, "w"), (3, None)], "bet_id int, user_id string")
    both = {"mine", "mine open"}
    expected = {"own": both, "own or none": both | {"none"}, "own and confirmed": {"mine"}, "child": both, "signed in": both | {"theirs", "none"}}
    every = policies.policies()
    assert len({t for t, _ in every}) == 11 + 26 and policies.policy_table(spark).count() == len(every) == 27 + 26
    seen = {}
    for (table, command), policy in every.items():
        kind = (policy.rule, policy.column if policy.rule == "child" else "owner")
        if kind not in seen:  # the same rule on the same column gives the same plan
            more = {"bets": bets} if policy.rule == "child" else {"owner": "owner"}
            seen[kind] = {r["name"] for r in policies.allowed(rows, table, "u", command, **more).collect()}
            assert policies.allowed(rows, table, None, command, **more).count() == 0
        assert seen[kind] == expected[policy.rule], (table, command)
    for table in policies.SHARED[:2] + ("bets", "audit_log", "unknown"):
        assert policies.allowed(rows, table, "u", "delete", owner="owner").count() == 0
    assert {r["name"] for r in policies.refused(rows, "name", "bets", "u", "update", owner="owner").collect()} == {"theirs", "none"}
    with pytest.raises(ValueError):
        policies.allowed(rows, "bet_events", "u")


def test_the_owner_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "user_id").write.parquet(str(tmp_path / "t"))
    plan = policies.allowed(spark.read.parquet(str(tmp_path / "t")), "bets", 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan


def test_audit_reads_only_what_differs(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("w"))
    changed = df.where("k <> 17").withColumn("v", F.when(F.col("k").isin(40, 41), 99).otherwise(F.col("v"))).unionByName(df.limit(0))
    paths = {n: str(tmp_path / n) for n in ("a", "same", "b", "twice")}
    for name, rows in (("a", df), ("same", df.select("w", "v", "k").orderBy(F.rand(3))), ("b", changed), ("twice", df.unionByName(df.where("k = 5")))):
        digests.write_snapshot(rows, "k", paths[name])
    assert digests.differing_buckets(spark, paths["a"], paths["same"]) == []
    assert digests.audit(spark, paths["a"], paths["same"], "k").count() == 0
    buckets = digests.differing_buckets(spark, paths["a"], paths["b"])
    want = {r["b"] for r in df.where("k IN (17, 40, 41)").select(F.pmod(F.xxhash64("k"), F.lit(digests.BUCKETS)).alias("b")).collect()}
    assert set(buckets) == want
    got = sorted(map(tuple, digests.audit(spark, paths["a"], paths["b"], "k").collect()))
    assert got == sorted(map(tuple, guards.mutated_rows(df, changed, "k").collect())) == [(17, "deleted"), (40, "updated"), (41, "updated")]
    assert len(digests.differing_buckets(spark, paths["a"], paths["twice"])) == 1


def test_cells_of_parts_add_up_and_answer_filters(spark):
    rows = Tables(spark, FOLDER).forecasts.withColumn("p", F.when(F.col("seq") % 50 == 0, None).otherwise(F.col("p"))).cache()
    parts = cube.cells(rows.where("seq % 2 = 0")).unionByName(cube.cells(rows.where("seq % 2 = 1")))
    for given in ({}, {"week": 3}, {"tier": "≥3%", "venue": "OUTDOOR"}, {"market": "TOTAL", "horizon": "<24h", "data": "LOW"}):
        some = rows
        for facet, value in given.items():
            some = some.where(cube.facets()[facet] == str(value))
        got = cube.metrics_of(cube.merged(parts.where(cube.matching(**given)), [])).first().asDict()
        want = metrics.metric_bundle(some).first().asDict() | metrics.expected_calibration_error(some).first().asDict()
        assert got == pytest.approx(want, nan_ok=True), given
    with pytest.raises(ValueError):
        cube.matching(colour="red")


@pytest.mark.parametrize("ranges", [1, 5])
def test_folded_drawdown(spark, ranges):
    r = random.Random(4)
    data = [(r.choice("ab"), i, float(r.randint(-300, 300))) for i in range(120)] + [("up", i, 1.0) for i in range(5)] + [("down", 0, -2000.0)]
    df = spark.createDataFrame(data, "k string, i int, profit double")
    got = {x["k"]: x["max_drawdown"] for x in metrics.folded_drawdown(df, ["k"], ["i"], "profit", 1000.0, ranges).collect()}
    for key in ("a", "b", "up", "down"):
        balance = peak = 1000.0
        worst = 0.0
        for _, _, v in sorted((d for d in data if d[0] == key), key=lambda d: d[1]):
            balance += v
            peak = max(peak, balance)
            worst = max(worst, (peak - balance) / peak)
        assert got[key] == pytest.approx(worst)


def test_cumulative_mass_equals_sums(spark):
    rows = spark.createDataFrame([(0.3, 12.1), (-20.0, 5.0), (44.0, 3.0)], "mu double, sd double")
    lines = [-50.0, -45.5, -7.0, -3.5, 0.0, 0.5, 3.0, 44.0, 45.0, 60.0]
    d = dist.margin_distribution(F.col("mu"), F.col("sd"))
    for line in lines:
        x = F.lit(line)
        for new, old in ((dist.spread_outcomes_at, dist.spread_outcomes), (dist.total_outcomes_at, dist.total_outcomes)):
            for a, b in rows.select(new(dist.cumulative(d), x), old(d, x)).collect():
                assert tuple(a) == pytest.approx(tuple(b), abs=1e-12), line
    assert rows.select(dist.spread_outcomes_at(dist.cumulative(d), F.lit(None).cast("double")).alias("x")).where("x IS NOT NULL").count() == 0


def test_times_that_are_texts(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("soon",), (None,), ("2024-01-03 00:00:00",)], "at string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = [r[0] for r in df.select(times.classify_freshness(F.col("at"), now, 60, 2000)).collect()]
    assert got == ["AGING", "CONFLICTING", "MISSING", "CONFLICTING"]
    zones = spark.createDataFrame([("Europe/Berlin",), ("Nowhere",), (None,)], "zone string")
    assert [r[0] for r in zones.select(times.format_kickoff(now, F.col("zone"))).collect()] == ["Tue, Jan 2, 1:00 AM", "Tue, Jan 2, 12:00 AM", "Tue, Jan 2, 12:00 AM"]
