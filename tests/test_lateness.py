"""Late rows, clocks, sessions and the guard of updates, against plain loops over any order of arrival."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewright.operators import guards, lateness
from pricewright.operators.bitemporal import time_cuts
from pricewright.streaming import bet_state, update_guard
from pricewright.streaming.lateness import LateRows

START = datetime(2024, 1, 1)
ROWS = "id long, feed string, source_updated_at timestamp, observed_at timestamp, ingested_at timestamp"


def rows(seed, n=200):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(minutes=r.randint(0, 3000))
        out.append((i, "hot" if r.random() < 0.6 else r.choice(["a", "b", None]), at - timedelta(minutes=r.randint(-1, 5)), None if r.random() < 0.03 else at, at + timedelta(minutes=r.randint(0, 900))))
    return out


def wanted(data, minutes, shown=None):
    shown, late = dict(shown or {}), {}
    for i, feed, _, at, _ in sorted(data, key=lambda x: (x[4], x[0])):
        late[i] = at is not None and feed in shown and at < shown[feed] - timedelta(minutes=minutes)
        if at is not None:
            shown[feed] = max(at, shown.get(feed, at))
    return late, shown


@pytest.mark.parametrize("per_range", [10**9, 15])
def test_late_rows_are_split_alike_at_any_range(spark, per_range):
    data = rows(1)
    df = spark.createDataFrame(data, ROWS)
    none = spark.createDataFrame([], "feed string, mark timestamp")
    got = lateness.with_late(df, none, 120 * 60, cuts=time_cuts(df, "ingested_at", per_range))
    assert {r["id"]: r["late"] for r in got.collect()} == wanted(data, 120)[0]
    report = {r["feed"]: r for r in lateness.clock_report(got).collect()}
    assert sum(r["n"] for r in report.values()) == len(data)
    assert report["hot"]["n_clock_faults"] == sum(1 for d in data if d[1] == "hot" and ((d[3] and d[2] > d[3]) or d[2] > d[4]))


def test_the_stream_keeps_every_row(spark, tmp_path):
    data = sorted(rows(2), key=lambda x: x[4])
    parts = [data[:50], data[50:120], [], data[120:]]
    kept = LateRows(spark, str(tmp_path / "kept"), 120 * 60, rows_per_range=20)
    for n, part in enumerate(parts):
        for _ in range(2 if n == 1 else 1):  # a batch that runs again leaves no second copy
            kept.take(spark.createDataFrame(part, ROWS), n)
    late, shown = {}, {}
    for part in parts:
        some, shown = wanted(part, 120, shown)
        late |= some
    assert {r["id"] for r in kept.late().collect()} == {i for i, x in late.items() if x}
    assert {r["id"] for r in kept.accepted().collect()} == {i for i, x in late.items() if not x}
    assert {r["feed"]: r["mark"] for r in kept.marks(3).collect() if r["mark"]} == shown


def test_sessions(spark):
    data = rows(3)
    got = lateness.sessions(spark.createDataFrame(data, ROWS), 20 * 60)
    want = []
    for feed in {d[1] for d in data}:
        times = sorted(d[3] for d in data if d[1] == feed and d[3])
        for k, at in enumerate(times):
            if k and at - times[k - 1] <= timedelta(minutes=20):
                want[-1][2:] = [at, want[-1][3] + 1]
            else:
                want.append([feed, at, at, 1])
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(w) for w in want)))


def test_guard_of_updates_in_any_order(spark, tmp_path):
    old = spark.createDataFrame([(i, f"u{i}", 10.0, "PENDING" if i % 4 == 0 else "WIN") for i in range(40)], "bet_id long, user_id string, stake double, result string")
    at = lambda i: START + timedelta(minutes=i)
    new = [(i, f"u{i}" if i % 3 else "other", 10.0 + (i % 8 == 0), "LOSS" if i % 2 else "WIN", at(i * 3)) for i in range(40)]
    fixes = [(i, "CORRECTED" if i % 5 else "SETTLED", at(i * 3 - i % 9)) for i in range(40)] + [(7, "CORRECTED", at(20)), (9, "CORRECTED", at(29))]
    schemas = "bet_id long, user_id string, stake double, result string, updated_at timestamp", "bet_id long, event_type string, created_at timestamp"
    ends = (-1, None, None, None, at(10_000)), (-1, "CORRECTED", at(10_000))
    streams = []
    for k, (data, schema, end) in enumerate(zip((new, fixes), schemas, ends, strict=True)):
        mixed = list(data)
        random.Random(k).shuffle(mixed)
        for part in (mixed[:15], mixed[15:], [end]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{k}")))
    found = update_guard.update_violations(old, *streams, delay="1 day")
    bet_state.append_to(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    want = guards.update_violations(old, *(spark.createDataFrame(d, s) for d, s in zip((new, fixes), schemas, strict=True)))
    columns = ["bet_id", "violation", F.concat_ws(",", "changed")]
    assert want.count() > 10
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
