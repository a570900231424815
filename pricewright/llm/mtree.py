"""Exact search for the rows of greatest inner product with M-trees and best-first search.

The metric is the angle.  Each vector x gets one more coordinate, sqrt(M * M - |x| * |x|) with M the greatest
length in the tree, so that all have length M; a query q gets 0.  Then q . x = |q| M cos(angle), and the first by
angle are the first by inner product.  A page of the tree holds routing vectors with covering radius and
distance to the page's own routing vector, a leaf page holds vectors with that distance.  With the triangle
inequality the stored distances exclude entries without computing their own distance, covering radii exclude
pages; pages are read in order of the greatest score that may be below them, until none can matter.

An index is a table of blocks, a tree each.  It is made once and can be searched again and again.  Bounds carry
a slack for rounding; scores are whole numbers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm import vectors as vs
from pricewright.llm.scratch import bound_arrow_batches, staged

_SLACK = 1e-6
#: Rows of results that a task gathers before it hands them on.
_HELD = 200_000


@dataclass
class Page:
    """Entries of one page.  ``rows``: vectors, or routing vectors of the pages ``below``."""

    rows: np.ndarray
    to_own: np.ndarray  # angle to the routing vector of this page
    radius: np.ndarray
    below: np.ndarray | None


@dataclass
class Tree:
    points: vs.Points
    longest: float
    pages: list[Page]  # the first is the root

    @staticmethod
    def of(points: vs.Points, page: int = vs.Sizes.page) -> Tree:
        longest = float(points.length.max(initial=0)) or 1.0
        x = points.double(points.x.shape[1])
        lifted = np.column_stack((x, np.sqrt(np.maximum(longest**2 - points.length**2, 0)))) / longest
        tree = Tree(points, longest, [])
        tree._page(lifted, np.arange(len(x)), None, page)
        return tree

    def _page(self, lifted: np.ndarray, rows: np.ndarray, own: int | None, most: int) -> int:
        number = len(self.pages)
        self.pages.append(None)
        angle = lambda a, r: np.arccos(np.clip(lifted[a] @ lifted[r], -1, 1))
        to_own = lambda a: np.zeros(len(a)) if own is None else angle(a, own)
        if len(rows) <= most:
            self.pages[number] = Page(rows, to_own(rows), np.zeros(len(rows)), None)
            return number
        size = most
        while size * most < len(rows):
            size *= most
        parts = [rows]
        while len(parts) < most and len(parts[0]) > size:  # the largest part stands first
            second = vs.halves(lifted[parts[0]])
            parts = sorted([parts[0][~second], parts[0][second], *parts[1:]], key=len, reverse=True)
        heads = np.array([part[(lifted[part] @ lifted[part].mean(0)).argmax()] for part in parts])
        radius = np.array([angle(part, head).max() for part, head in zip(parts, heads, strict=True)])
        below = np.array([self._page(lifted, part, head, most) for part, head in zip(parts, heads, strict=True)])
        self.pages[number] = Page(heads, to_own(heads), radius, below)
        return number


def build_index(points: DataFrame, sizes: vs.Sizes = vs.Sizes()) -> DataFrame:  # noqa: B008  frozen
    """A written table of M-trees over ``points`` (id, label, v), one tree per block."""
    return vs.blocks(points, lambda table: ((labels, n, Tree.of(part, sizes.page)) for labels, n, part in _parts(table, sizes.block)), "mtree", sizes.group)


def _parts(table: pa.Table, most: int) -> Iterator[tuple[list[str], int, vs.Points]]:
    points = vs.points_of(table)
    x = points.double(points.x.shape[1])
    for rows in vs.cut(x, np.arange(len(x)), most):
        yield [], len(rows), vs.Points(points.x[rows], points.ids[rows], points.labels[rows])


def search_index(index: DataFrame, queries: DataFrame, k: int, sizes: vs.Sizes = vs.Sizes()) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score: for each query (id, label, v) the first ``k`` rows of another id, by score, ties to smaller ids.

    Each block of queries first searches the tree nearest to it.  The k-th scores found there are floors for the
    rest: trees whose greatest possible score is below all floors of the block are not even sent.
    """
    packed = vs.blocks(queries, lambda table: _parts(table, sizes.queries), "queries", sizes.group)
    nearest = F.row_number().over(Window.partitionBy("left_block").orderBy("apart", "right_block"))
    pairs = staged(vs.all_pairs(packed, index).select("left_block", "right_block", "top", nearest.alias("nth")), "pairs")
    schema = "block long, query_id long, vec_id long, score long"
    first = staged(vs.searched(pairs.where("nth = 1"), packed, index, lambda it: _searched(it, k), schema), "nearest")
    floor = F.when(F.count(F.lit(1)) >= k, F.min("score"))
    floors = first.groupBy(F.col("block").alias("left_block"), "query_id").agg(floor.alias("floor")).where("floor IS NOT NULL")
    floors = floors.groupBy("left_block").agg(F.collect_list(F.struct("query_id", "floor")).alias("more"), F.min("floor").alias("lowest"), F.count(F.lit(1)).alias("known"))
    whole = F.col("known") == F.col("rows")  # a block has a bounded number of queries
    floors = floors.join(packed.select(F.col("block").alias("left_block"), "rows"), "left_block").withColumn("lowest", F.when(whole, F.col("lowest")))
    rest = pairs.where("nth > 1").join(floors, "left_block", "left").where(F.col("lowest").isNull() | (F.col("top") >= F.col("lowest")))
    found = first.unionByName(vs.searched(rest, packed, index, lambda it: _searched(it, k), schema))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sizes: vs.Sizes = vs.Sizes()) -> DataFrame:  # noqa: B008
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query row with the other rows.

    ``query`` tells by the id which rows are queries.  Components count as floor(256 * x).  All rows are
    returned if there are fewer than ``k``; ties go to the smaller id.  Rows without an id and vectors that are
    null or hold a null or non-finite component take no part, nor do vectors whose scaled squared norm is 2**62 or more.
    Shorter vectors count as filled up with zeros, an empty one is all zeros.  Equal rows count once.  Of
    several vectors with one id each is a candidate; the smallest of them is the query.  No row is a candidate of a
    query with its own id.  An empty table gives an empty result; other columns are ignored.
    """
    bound_arrow_batches(df.sparkSession)
    rows = staged(vs.whole_numbers(df, id_col, vec_col), "vectors")
    queries = rows.where(query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("label", F.lit(None).cast("string")).select("id", "label", "v")
    index = build_index(vs.distinct_points(rows, k + 1), sizes)
    return search_index(index, queries, k, sizes)


def _searched(pairs: Iterator[tuple[int, vs.Points, Tree, list[dict] | None]], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray, vs.Best]] = {}
    size = 0
    for number, queries, tree, floors in pairs:
        if number not in held:
            if size > _HELD:
                yield from _results(held)
                held, size = {}, 0
            known = {f["query_id"]: f["floor"] for f in floors or []}
            floor = np.array([known.get(i, vs.LEAST) for i in queries.ids.tolist()], np.int64)
            held[number] = (queries.ids, floor, vs.Best.of(len(queries.ids), k))
            size += k * len(queries.ids)
        _, floor, best = held[number]
        search = _Search(tree, queries, floor)
        for row in range(len(queries.ids)):
            search.run(row, best)
    yield from _results(held)


def _results(held: dict[int, tuple[np.ndarray, np.ndarray, vs.Best]]) -> Iterator[pa.RecordBatch]:
    for number, (ids, _, best) in held.items():
        there = best.score != vs.LEAST
        owner = np.repeat(ids, there.sum(1))
        columns = (np.full(len(owner), number), owner, best.id[there], best.score[there])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "query_id", "vec_id", "score"])


class _Search:
    """Best-first search of one tree for several queries."""

    def __init__(self, tree: Tree, queries: vs.Points, floor: np.ndarray) -> None:
        self.tree, self.queries, self.floor = tree, queries, floor
        self.scores = vs.scorer(queries, tree.points)

    def run(self, row: int, best: vs.Best) -> None:
        tree, ids = self.tree, self.tree.points.ids
        own, full = self.queries.ids[row], float(self.queries.length[row]) * self.tree.longest
        if not full:  # all scores are 0: the smallest ids
            rows = np.flatnonzero(ids != own)
            rows = rows[np.argsort(ids[rows], kind="stable")[: best.id.shape[1]]]
            best.add(row, np.zeros(len(rows), np.int64), ids[rows])
            return
        most = lambda angle: full * np.cos(np.clip(angle - _SLACK, 0, np.pi)) + _SLACK * (1 + full)
        queue = [(-np.inf, 0, None)]  # greatest score that may be below, page, the query's angle to its routing vector
        while queue:
            bound, number, angle = heapq.heappop(queue)
            last = max(best.last[row], self.floor[row])
            if -bound < last:
                return
            page = tree.pages[number]
            rows, radius, below = page.rows, page.radius, page.below
            if angle is not None:
                near = np.flatnonzero(most(np.abs(angle - page.to_own) - radius) >= last)
                if not len(near):
                    continue
                rows, radius, below = rows[near], radius[near], None if below is None else below[near]
            score = self.scores(row, rows)
            if below is None:
                good = (score >= last) & (ids[rows] != own)
                if good.any():
                    best.add(row, score[good], ids[rows[good]])
                continue
            angles = np.arccos(np.clip(score / full, -1, 1))
            bounds = most(angles - radius)
            for k in np.flatnonzero(bounds >= last).tolist():
                heapq.heappush(queue, (-bounds[k], int(below[k]), angles[k]))
