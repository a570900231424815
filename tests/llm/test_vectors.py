"""Vector searches against plain comparisons of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pricewright.llm import hard_negatives as hn
from pricewright.llm import mtree, vectors
from tests.llm import messy

SCHEMA = "vec_id long, embedding array<double>, label string"


def rows(seed=1, n=300, dim=6):
    """Clusters, many copies of one vector, ties, and every kind of row that takes no part."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centres[r.randrange(5)]
        x = [a + r.gauss(0, 0.3) for a in c] if i % 3 else [0.5] * dim
        out.append((i, x, f"l{r.randrange(4)}" if i % 5 else "l0"))
    out += [(n + 1, None, "l1"), (n + 2, [1.0, None] + [0.0] * (dim - 2), "l1"), (n + 3, [math.nan] * dim, "l1"), (n + 4, [math.inf] * dim, "l2"), (n + 5, [1e300] * dim, "l2")]
    out += [(None, [1.0] * dim, "l1"), (n + 6, [], "l1"), (n + 7, [0.25], "l2"), (n + 8, [1.0] * dim, None), (n + 9, [2.0**27, -(2.0**27)] + [3.0] * (dim - 2), "l3"), (n + 10, [0.0] * dim, "l3")]
    out += [out[2], out[2], (4, [9.0] * dim, "l2")]  # equal rows, and one id with two vectors
    return out


def taking_part(data, labelled):
    dim = max(len(x or []) for _, x, _ in data)
    out = set()
    for i, x, label in data:
        if i is None or x is None or any(v is None or not math.isfinite(v) for v in x) or (labelled and label is None):
            continue
        v = [math.floor(256 * c) for c in x]
        if sum(c * c for c in v) < 2**62:
            out.add((i, label if labelled else None, tuple(v), tuple(v + [0] * (dim - len(v)))))
    return out


def score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def first_of_each(points):
    queries = {}
    for i, label, given, v in sorted(points, key=lambda p: (p[0], p[1] or "", p[2])):
        queries.setdefault(i, (label, v))
    return queries


def expected_top(data, every, k):
    points = taking_part(data, False)
    out = []
    for q, (_, v) in first_of_each(points).items():
        if q % every == 0:
            best = sorted((-score(v, c), i) for i, _, _, c in points if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def expected_negatives(data, every):
    points = taking_part(data, True)
    out = []
    for a, (label, v) in first_of_each(points).items():
        if a % every:
            continue
        others = sorted((-score(v, c), i, x) for i, x, _, c in points if i != a)
        for p, i, _ in [o for o in others if o[2] == label][:5]:
            fits = [(-s, n) for s, n, x in others if x != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, k, n, -p, s) for k, (s, n) in enumerate(fits[:3], 1)]
    return sorted(out)


#: Several regions, blocks, pages and leaves even for few rows.
SMALL = vectors.Sizes(block=40, queries=16, group=80, page=4, leaf=4, at_once=2)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    data = rows(seed)
    df = messy.with_clashes(spark.createDataFrame(data, SCHEMA).repartition(3).drop("label"))
    assert got(mtree.top_k(df, lambda i: i % 10 == 0, sizes=SMALL)) == expected_top(data, 10, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumnRenamed("embedding", "vector")
    want = expected_negatives(data, 10)
    assert len(want) > 50
    assert got(hn.hard_negatives(df, lambda i: i % 10 == 0, vec_col="vector", sizes=SMALL)) == want


def test_whole_blocks_of_default_size(spark):
    data = rows(3, 120)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(mtree.top_k(df, lambda i: i % 7 == 0, k=3)) == expected_top(data, 7, 3)
    assert got(hn.hard_negatives(df, lambda i: i % 7 == 0)) == expected_negatives(data, 7)


def test_few_rows_and_none(spark):
    data = [(0, [1.0], "a"), (1, [2.0], "b"), (2, [1.5], "a")]
    assert got(mtree.top_k(spark.createDataFrame(data, SCHEMA), lambda i: i == 0)) == expected_top(data, 100, 5)
    for some in ([], data[:1]):
        df = spark.createDataFrame(some, SCHEMA)
        assert got(mtree.top_k(df, lambda i: i == 0)) == [] and got(hn.hard_negatives(df, lambda i: i == 0)) == []


def test_bounds_hold_at_every_page():
    """Angles below a page are within its radius, and stored distances are those to its routing vector."""
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(900, 8)) * 200).astype(np.int64)
    points = vectors.Points(x, np.arange(900), np.full(900, None))
    tree = mtree.Tree.of(points, 8)
    lifted = np.column_stack((x, np.sqrt(np.maximum(tree.longest**2 - points.length**2, 0)))) / tree.longest
    seen = []

    def below(number):
        page = tree.pages[number]
        if page.below is None:
            seen.extend(page.rows.tolist())
            return page.rows
        found = []
        for k, child in enumerate(page.below.tolist()):
            rows_ = below(child)
            angle = np.arccos(np.clip(lifted[rows_] @ lifted[page.rows[k]], -1, 1))
            assert angle.max() <= page.radius[k] + 1e-6
            found.append(rows_)
        return np.concatenate(found)

    below(0)
    assert sorted(seen) == list(range(900)) and max(len(p.rows) for p in tree.pages) <= 8


def test_dual_search_prunes_far_groups():
    """Anchors and candidates in separate directions: a leaf of anchors meets few leaves of candidates."""
    r = np.random.default_rng(6)
    directions = np.eye(8) * 1000
    x = np.floor(np.repeat(directions, 64, 0) + r.normal(size=(512, 8)) * 5).astype(np.int64)
    labels = np.full(512, "a", object)
    tree = hn.BallTree.of(vectors.Points(x, np.arange(512), labels), np.arange(512))
    needs = hn._Positives(tree, 5)
    search = hn._DualSearch(tree, tree, needs, 2)
    scored, plain = [], search.scores
    search.scores = lambda i, j: scored.append(len(j)) or plain(i, j)
    search.pair(0, np.zeros(1, np.int64))
    assert sum(scored) < 16 * 512 / 3  # of 16 leaves of anchors with 512 candidates each
    full = x @ x.T
    np.fill_diagonal(full, np.iinfo(np.int64).min)
    assert {int(i): sorted(b.tolist()) for i, b in zip(tree.points.ids, needs.best.score, strict=True)} == {i: sorted(full[i].tolist())[-5:] for i in range(512)}


def test_far_blocks_are_not_sent(spark, monkeypatch):
    """Clusters in separate directions, queries from one of them: after the nearest trees, only those that may matter are searched."""
    r = random.Random(8)
    data = [(i, [1000.0 * (k == i % 8) + r.gauss(0, 5) for k in range(8)], "a") for i in range(640)]
    sent, searched = [], vectors.searched

    def counted(pairs, *more):
        sent.append((pairs.count(), "more" in pairs.columns))
        return searched(pairs, *more)

    monkeypatch.setattr(vectors, "searched", counted)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(mtree.top_k(df, lambda i: i % 8 == 0, sizes=SMALL)) == expected_top(data, 8, 5)
    (near, _), (rest, with_floors) = sent
    assert with_floors and near >= 4 and rest < 8 * near, (near, rest)  # of 16 trees and more for each
