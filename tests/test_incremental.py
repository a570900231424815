"""Recommendations kept up to date batch by batch, against deciding everything again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.plans.catalog import PRICE_MINUTES
from pricewright.plans.slate import evaluate
from pricewright.sources.tables import Tables
from pricewright.streaming.incremental import FAILED, LoggedTables, Recommendations
from tests.conftest import DATA


def test_batches_equal_a_whole_evaluation(spark, tmp_path):
    t = Tables(spark, f"{DATA}/sf0.001")
    events = t.base("events")
    last = 10 * (events.agg(F.max("event_id")).first()[0] // 10)
    first, rest = events.where((F.col("event_id") < last - 60) & (F.col("event_type") != "error")), events.where(F.col("event_id") >= last - 60)
    kept = Recommendations(t, str(tmp_path / "kept"), PRICE_MINUTES)
    kept.take(first, 0)
    before = {r["game_id"]: (r["version"], r["status"]) for r in kept.current().collect()}
    open_ = sorted(g for g, (_, s) in before.items() if s in ("BET", "WATCH"))
    assert before and open_ and {v for v, _ in before.values()} == {0} and kept.pushed().count() == 0
    # One open game fails twice, and a few events arrive for one that is not open.
    other = next(g for g in sorted(before) if g not in open_)
    row = rest.limit(1)
    failing = row.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), *events.columns).withColumn("event_type", F.lit("error")).withColumn("value", F.lit(500.0))
    failing = failing.withColumn("user_id", F.lit(open_[0]).cast("long")).withColumn("event_id", (F.lit(last + 1000) + F.col("n")).cast("long")).select(*(F.col(c).cast(events.schema[c].dataType) for c in events.columns))
    batch = failing.unionByName(first.where(F.col("user_id") == other).limit(2).withColumn("event_id", (F.col("event_id") + last + 2000).cast("long")))
    for _ in range(2):  # the second run replaces what the first one left
        kept.take(batch, 1)
        got = kept.current()
        versions = {r["game_id"]: r["version"] for r in got.collect()}
        assert {g for g, v in versions.items() if v == 1} == {open_[0], other}
        assert [tuple(r) for r in kept.pushed().select("game_id", "version", "status", "reason").collect()] == [(open_[0], 0, before[open_[0]][1], FAILED)]
    whole = evaluate(LoggedTables(spark, t.folder, log=first.unionByName(batch)), price_minutes=PRICE_MINUTES)
    assert sorted(map(repr, got.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
