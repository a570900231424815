"""JSON state, and streams against the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.operators.guards import price_form_errors, split_valid
from pricewright.operators.pointintime import latest_snapshot
from pricewright.sources import state
from pricewright.sources.reference import teams
from pricewright.sources.tables import Tables
from pricewright.streaming import ledger as streams
from tests.conftest import DATA


def test_prices_round_trip(spark, tmp_path):
    path = f"{tmp_path}/prices"
    assert state.read_prices(spark, path).count() == 0
    rows = spark.createDataFrame(
        [("1", "g", "bet365", "SPREAD", "HOME", -3.5, -110.0, 5.0, True, None, 1), ("2", "g", "bet365", "SPREAD", "HOME", -3.25, -110.0, 5.0, False, None, 2)], state.PRICE_SCHEMA
    )
    bad = state.submit_prices(rows, path).collect()
    assert bad[0]["errors"] == ["line", "confirmed"]
    (tmp_path / "prices" / "broken.json").write_text("{oops\n")
    assert [r["id"] for r in state.read_prices(spark, path).collect()] == ["1"]


def test_state_defaults_export_reset(spark, tmp_path):
    df = spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "j string")
    rows = df.select(state.parsed_state(F.col("j"), "a int, b string", {"a": F.lit(0), "b": F.lit("x")}).alias("s")).collect()
    assert [(r["s"]["a"], r["s"]["b"]) for r in rows] == [(1, "x"), (0, "x"), (0, "x")]
    state.export_state({"t": df}, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/t").count() == 3
    state.reset_state({"t": df}, f"{tmp_path}/out")
    assert spark.read.schema("j string").json(f"{tmp_path}/out/t").count() == 0


def test_teams(spark):
    assert teams(spark).count() == 32 and teams(spark).select("abbreviation").distinct().count() == 32


def run(df, name, mode, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    quotes = Tables(spark, f"{DATA}/sf0.001").quotes
    quotes.repartition(3).write.parquet(f"{tmp_path}/q")
    stream = lambda: spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    got = run(streams.latest_quotes(stream()), "latest_q", "complete", spark).select("game_id", "market", "seq")
    want = latest_snapshot(quotes, ["game_id", "market"]).select("game_id", "market", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counted = run(streams.windowed_activity(stream(), "60 days"), "windowed", "complete", spark)
    assert counted.agg(F.sum("n")).first()[0] == quotes.count()
    twice = stream().union(stream())
    assert run(streams.deduplicated(twice, watermark="60 days"), "once", "append", spark).count() == quotes.count()


def test_append_is_idempotent_per_batch(spark, tmp_path):
    rows = spark.createDataFrame([("1", "g", "bet365", "SPREAD", "HOME", 1.0, -110.0, 5.0, True, None, 1), ("2", "", "x", "SPREAD", "HOME", 1.0, -110.0, 5.0, True, None, 2)], state.PRICE_SCHEMA)
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    streams.append_ledger(source, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: split_valid(price_form_errors(df))).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/accepted").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/rejected").first()["errors"] == ["game_id", "book"]


def test_invalidations_and_balances(spark, tmp_path):
    spark.createDataFrame([(1, "feed", 1.5), (1, "feed", 2.0)], "game_id int, reason string, delta double").withColumn("at", F.current_timestamp()).withColumn("user_id", F.col("game_id")).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    recs = spark.createDataFrame([(7, 1, "BET"), (8, 1, "PASS")], "rec_id int, game_id int, status string")
    hit = run(streams.invalidations(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), recs), "hits", "append", spark)
    assert {r["rec_id"] for r in hit.collect()} == {7}
    total = run(streams.balances(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")), "totals", "complete", spark).first()
    assert total["change"] == 3.5 and total["settled"] == 2


def test_nested_defaults(spark):
    texts = ['{"a": {"b": {"c": 5}}}', '{"a": {"d": 2}}', '{"a": null}', "{", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    defaults = {"a": {"b": {"c": F.lit(1)}, "d": F.lit(9)}}
    rows = df.select(state.parsed_state(F.col("j"), "a struct<b struct<c int>, d int>", defaults).alias("s")).select("s.a.b.c", "s.a.d").collect()
    assert [tuple(r) for r in rows] == [(5, 9), (1, 2), (1, 9), (1, 9), (1, 9)]
