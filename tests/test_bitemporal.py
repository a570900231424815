"""Split as-of joins against plain comparisons."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewright.operators import bitemporal as bt
from pricewright.operators import pointintime as pit

START = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, id int, at timestamp, known timestamp, note string", "k string, seq int, at timestamp, known timestamp, note string"


def rows(seed, n=240):
    """One key holds half of all rows; times tie, some are missing, what is known later may be valid earlier."""
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.04 else START + timedelta(hours=r.randint(0, 80))
    key = lambda: "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None])
    return [(key(), i, when(), when(), f"n{i % 3}") for i in range(n)]


def wanted(left, right, both):
    out = []
    for k, i, at, known, note in left:
        fits = []
        for rk, seq, rat, rknown, rnote in right:
            if rk == k and None not in (at, rat) and rat <= at and (not both or (None not in (known, rknown) and rknown <= known)):
                fits.append(((rat, rknown, seq) if both else (rat, seq), seq, rnote))
        _, seq, rnote = max(fits, default=(None, None, None))
        out.append((k, i, at, known, note, seq, rnote))
    return sorted(map(repr, out))


@pytest.mark.parametrize("per_range", [10**9, 12, 1])
@pytest.mark.parametrize("both", [False, True])
def test_split_joins(spark, both, per_range):
    left, right = rows(per_range % 7), rows(per_range % 7 + 1)
    ldf, rdf = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    valid, known = (bt.time_cuts(rdf, c, per_range) for c in ("at", "known"))
    if both:
        got = bt.bitemporal_join(ldf, rdf, ["k"], "at", "known", "at", "known", "id", "seq", valid_cuts=valid, known_cuts=known)
    else:
        got = bt.asof_join_split(ldf, rdf, ["k"], "at", "at", ["seq"], cuts=valid)
    got = got.select("k", "id", "at", "known", "note", "r_seq", "r_note")
    assert sorted(repr(tuple(r)) for r in got.collect()) == wanted(left, right, both)


def test_split_join_equals_the_plain_one(spark):
    df = spark.createDataFrame([r for r in rows(5) if r[0] and r[2]], RIGHT)
    probes = spark.createDataFrame([r for r in rows(6) if r[0] and r[2]], LEFT)
    columns = ["k", "id", "r_seq"]
    plain = pit.asof_join(probes, df, ["k"], "at", "at", "id", "seq").select(columns)
    split = bt.asof_join_split(probes, df, ["k"], "at", "at", ["seq"], cuts=bt.time_cuts(df, "at", 20)).select(columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, split.collect()))


def test_empty_sides(spark):
    none_left, none_right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    some = spark.createDataFrame(rows(1)[:5], LEFT)
    assert bt.time_cuts(none_right, "at") == []
    join = lambda a, b: bt.bitemporal_join(a, b, ["k"], "at", "known", "at", "known", "id", "seq")
    assert join(none_left, none_right).count() == 0
    assert join(some, none_right).where("r_seq IS NULL").count() == 5


def test_a_hot_key_is_spread(spark):
    """A key with all rows: no range of a time line holds more than a small share of them."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("seq"), (F.lit(START) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"))
    cuts = bt.time_cuts(df, "at", 100)
    sizes = [r["count"] for r in df.groupBy(bt.range_of(F.col("at"), cuts)).count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 250
    assert bt.range_of(F.col("at"), []) is not None
