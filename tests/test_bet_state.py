"""Bets and balances kept by streams, against the batch fold, over arrivals in any order."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pricewright.operators import ledger
from pricewright.plans import live
from pricewright.sources import scratch
from pricewright.sources.tables import Tables
from pricewright.streaming import bet_state
from tests.conftest import DATA

EVENTS = "bet_id long, seq int, event_type string, result string, user_id long, stake double, american long"


def events(seed=1, bets=60):
    """Bets with settlements and corrections of every kind, invalid ones among them."""
    r = random.Random(seed)
    out = []
    for b in range(bets):
        out.append((b, 1, "PLACED", None, b % 7, r.randint(1, 900) / 4, r.choice([-110, 150, -250, 101])))
        for seq in range(2, r.randint(2, 6)):
            kind = r.choice(["SETTLED", "VOIDED"]) if seq == 2 and r.random() < 0.8 else r.choice(["CORRECTED", "SETTLED"])
            out.append((b, seq, kind, r.choice([*ledger.SETTLED, "bad"]), None, None, None))
    return out


def wanted(spark, rows):
    df = spark.createDataFrame(rows, EVENTS)
    bets = df.where("event_type = 'PLACED'").select("bet_id", "user_id", "stake", "american", F.lit("PENDING").alias("result"))
    return ledger.fold_results(bets, df)


def test_streams_equal_the_batch_fold_over_restarts(spark, tmp_path):
    rows = events()
    arriving = rows + rows[::5]
    random.Random(2).shuffle(arriving)
    source, changes, balances = (str(tmp_path / n) for n in ("in", "changes", "balances"))
    parts = [arriving[:90], arriving[90:150], arriving[150:]]
    for part in parts:  # each round starts both streams again from their checkpoints
        spark.createDataFrame(part, EVENTS).repartition(2).write.mode("append").parquet(source)
        stream = bet_state.bet_changes(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source))
        bet_state.append_to(stream, changes, str(tmp_path / "c1")).awaitTermination()
        appended = spark.readStream.schema(stream.schema).parquet(changes)
        bet_state.update_in(bet_state.user_balances(appended), balances, str(tmp_path / "c2")).awaitTermination()
    got = bet_state.current_bets(spark, changes, stream.schema)
    want = wanted(spark, rows)
    columns = ["bet_id", "user_id", "result", "corrections", "delta", "payout"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    log = spark.read.schema(stream.schema).parquet(changes)
    assert log.groupBy("bet_id", "seq").count().where("count > 1").count() == 0 and log.count() == len(rows)
    total = bet_state.current_balances(spark, balances, 100.0).select("user_id", "balance")
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, ledger.balances(want, ["user_id"], 100.0).collect()))


def test_many_bets_share_a_row_of_state(spark, tmp_path):
    """A call of the state function costs milliseconds, so there must not be one for every bet."""
    bets = spark.range(3000).select(F.col("id").alias("bet_id"), F.lit(1).alias("seq"), F.lit("PLACED").alias("event_type"), F.lit(None).cast("string").alias("result"), (F.col("id") % 7).alias("user_id"), F.lit(1.0).alias("stake"), F.lit(100).cast("long").alias("american"))
    bets.write.parquet(str(tmp_path / "in"))
    stream = bet_state.bet_changes(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    query = bet_state.append_to(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select("bet_id", "seq", "user_id").distinct().count() == 3000


def test_streams_of_the_balance_query_take_parts_and_several_files(spark, tmp_path):
    """As ``ledger_stream_balances`` runs them: three batches of several files, no state for every bet, right balances."""
    t = Tables(spark, f"{DATA}/sf0.001")
    changes = live._bet_changes(t)
    folding = bet_state.append_to(changes, str(tmp_path / "changes"), str(tmp_path / "c1"))
    folding.awaitTermination()
    batches = [p for p in folding.recentProgress if p["numInputRows"]]
    assert len(batches) == live.BATCHES and sum(p["numInputRows"] for p in batches) == live.bet_events(t).count()
    assert batches[-1]["stateOperators"][0]["numRowsTotal"] <= 1024 < t.positions.count()
    appended = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "changes"))
    bet_state.update_in(bet_state.user_balances(appended), str(tmp_path / "balances"), str(tmp_path / "c2")).awaitTermination()
    bets = t.positions.select("bet_id", "user_id", F.col("stake").cast("double").alias("stake"), "american", F.lit("PENDING").alias("result"))
    want = ledger.balances(ledger.fold_results(bets, live.bet_events(t).where("copy = 0")), ["user_id"], 100.0)
    got = bet_state.current_balances(spark, str(tmp_path / "balances"), 100.0).select("user_id", "balance")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_equal_the_batch_fold_over_restarts(spark, tmp_path):
    rows = events(seed=3)
    arriving = rows + rows[::4]
    random.Random(4).shuffle(arriving)
    source, changes, checkpoint = (str(tmp_path / n) for n in ("in", "changes", "c"))
    for part in (arriving[:70], arriving[70:71], arriving[71:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = bet_state.bet_changes(spark.readStream.schema(EVENTS).parquet(source), parts=3)
        bet_state.append_to(stream, changes, checkpoint).awaitTermination()
    columns = ["bet_id", "user_id", "result", "corrections", "delta", "payout"]
    got, want = bet_state.current_bets(spark, changes, stream.schema), wanted(spark, rows)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    log = spark.read.schema(stream.schema).parquet(changes)
    assert log.select("bet_id", "seq").distinct().count() == log.count() == len(rows)
    spark.createDataFrame(arriving, EVENTS).write.mode("append").parquet(source)
    again = bet_state.append_to(bet_state.bet_changes(spark.readStream.schema(EVENTS).parquet(source), parts=4), changes, checkpoint)
    with pytest.raises(StreamingQueryException, match="deals bets to 3 parts"):
        again.awaitTermination()


@pytest.mark.parametrize("parts", [None, 1])
def test_large_and_missing_numbers_arrive_as_they_are(parts):
    fold = bet_state._folded(None) if parts is None else bet_state._folded_parts(parts)
    user = 2**53 + 1
    rows = [(9, 1, "PLACED", None, str(user), 10.0, "100"), (9, 2, "SETTLED", "WIN", None, float("nan"), None)]
    rows += [] if parts is None else [(8, 1, "PLACED", None, None, float("nan"), None)]
    batch = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
    got = [tuple(r)[:7] for out in fold((9,), iter([batch]), Memory()) for r in out.itertuples(index=False)]
    assert got[:2] == [(9, user, 1, "PLACED", 10.0, 100, "PENDING"), (9, user, 2, "SETTLED", 10.0, 100, "WIN")]
    assert got[2:] == ([] if parts is None else [(8, None, 1, "PLACED", None, None, "PENDING")])


@pytest.mark.parametrize("fold", [bet_state._folded(None), bet_state._folded_parts(2)])
def test_executors_need_no_copy_of_the_package(fold, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'pricewright' not in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(fold), env=env, cwd=tmp_path).returncode == 0


def test_arrivals_of_several_files_hold_every_row_once(spark):
    path = scratch.arrivals(spark.range(500), "some", 3, F.col("id"), files=2)
    rows = spark.read.schema("id long").parquet(path)
    assert len(rows.inputFiles()) == 6 and sorted(r.id for r in rows.collect()) == list(range(500))


class Memory:
    """A state without a store."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_a_gap_is_reported_and_filled_later():
    fold, state = bet_state._folded(500), Memory()
    names = [c.split()[0] for c in EVENTS.split(", ")]
    call = lambda rows: [tuple(r) for b in fold((9,), iter([pd.DataFrame(rows, columns=names)]), state) for r in b.itertuples(index=False)]
    late = (9, 3, "CORRECTED", "LOSS", None, None, None)
    assert [r[2] for r in call([(9, 1, "PLACED", None, 4, 10.0, 100), late])] == [1] and state.timeout == 500
    state.hasTimedOut = True
    gap = [tuple(r) for b in fold((9,), iter([]), state) for r in b.itertuples(index=False)]
    assert [(r[3], r[10]) for r in gap] == [("GAP", 2)]
    state.hasTimedOut, state.timeout = False, None
    done = call([(9, 2, "SETTLED", "WIN", None, None, None), (9, 2, "SETTLED", "LOSS", None, None, None), late])
    assert [(r[2], r[6], r[7], r[9]) for r in done] == [(2, "WIN", "PENDING", True), (3, "LOSS", "WIN", True)] and state.timeout is None


def test_rows_without_keys_are_left_out(spark, tmp_path):
    rows = [(None, 1, "PLACED", None, 1, 1.0, 100), (1, None, "PLACED", None, 1, 1.0, 100), (1, 2, "SETTLED", "WIN", None, None, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    stream = bet_state.bet_changes(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    bet_state.append_to(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 0


def test_clean_up_deletes_what_was_written(spark):
    rows = scratch.written(spark.range(5), "some")
    path = rows.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert rows.count() == 5 and scratch.folder(spark, "x") != scratch.folder(spark, "x")
    scratch.clean_up(spark)
    assert not os.path.exists(path)
