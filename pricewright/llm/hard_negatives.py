"""Hard negatives by dual-tree search.

Anchors and candidates are packed into ball trees, in blocks of near vectors and, where a label has enough
rows, of one label.  For two balls with centres a and c and radii r and s, every inner product lies within
|a| s + |c| r + r s of a . c.  A pair of nodes whose interval holds no score that any of its anchors still needs is
dropped with all of them at once; the others are taken apart on both sides, and pairs of leaves are scored exactly.

Two searches follow each other.  The first one finds each anchor's positives, the highest scores of its own
label.  Every positive then asks for a band of scores below its own, and the second search finds the highest
scores of other labels in each band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm import vectors as vs
from pricewright.llm.scratch import bound_arrow_batches, staged

#: Rows of results that a task gathers before it hands them on.
_HELD = 200_000
_LEAST, _MOST = vs.LEAST, vs.MOST


@dataclass
class BallTree:
    """Nodes in preorder; node n holds the points ``first[n]:end[n]``, ``left`` is -1 at leaves."""

    points: vs.Points
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    names: list[str]
    label: np.ndarray
    positives: np.ndarray | None = None  # per point: score and id of each positive
    asks: tuple[int, int] = (vs.LEAST, vs.MOST)  # least and greatest score that any point looks for

    @staticmethod
    def of(points: vs.Points, rows: np.ndarray, positives: np.ndarray | None = None, leaf: int = vs.Sizes.leaf) -> BallTree:
        x = points.double(points.x.shape[1])
        nodes: list[list] = []
        order: list[np.ndarray] = []

        def node(part: np.ndarray, first: int) -> int:
            number = len(nodes)
            centre = x[part].mean(0) if len(part) else np.zeros(x.shape[1])
            radius = np.sqrt(((x[part] - centre) ** 2).sum(1).max(initial=0))
            nodes.append([first, first + len(part), -1, -1, centre, radius * (1 + 1e-9) + 1e-6])
            if len(part) > leaf:
                second = vs.halves(x[part])
                nodes[number][2] = node(part[~second], first)
                nodes[number][3] = node(part[second], first + int((~second).sum()))
            else:
                order.append(part)
            return number

        node(rows, 0)
        rows = np.concatenate(order)
        names, label = np.unique(points.labels[rows].astype(str), return_inverse=True)
        kept = vs.Points(points.x[rows], points.ids[rows], points.labels[rows])
        columns = [np.array(c) for c in zip(*nodes, strict=True)]
        return BallTree(kept, *columns, names.tolist(), label, None if positives is None else positives[rows])


def _label_parts(points: vs.Points, most: int) -> Iterator[np.ndarray]:
    """Rows in blocks: labels with enough rows for themselves, others together, each block near vectors."""
    x = points.double(points.x.shape[1])
    _, label, count = np.unique(points.labels.astype(str), return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    order = np.argsort(label, kind="stable")
    small: list[np.ndarray] = []
    for n, end in zip(count.tolist(), ends.tolist(), strict=True):
        rows = order[end - n : end]
        if 4 * n >= most:
            yield from vs.cut(x, rows, most)
            continue
        if small and sum(map(len, small)) + n > most:
            yield np.concatenate(small)
            small = []
        small.append(rows)
    if small:
        yield np.concatenate(small)


def _bands(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each positive asks for; none below 0."""
    asks = score >= 0
    p = np.where(asks, score, 0)
    return np.where(asks, -(-low * p // 100), _MOST), np.where(asks, high * p // 100, _LEAST)


def _trees(most: int, leaf: int, low: int = 0, high: int = 0) -> Callable[[pa.Table], Iterator[tuple[list[str], int, BallTree]]]:
    def pack(table: pa.Table) -> Iterator[tuple[list[str], int, BallTree]]:
        points = vs.points_of(table)
        positives = _positives(table["positives"], len(points.ids)) if "positives" in table.column_names else None
        for rows in _label_parts(points, most):
            tree = BallTree.of(points, rows, positives, leaf)
            if positives is not None:
                least, greatest = _bands(tree.positives[:, :, 0], low, high)
                tree.asks = (least.min(initial=_MOST), greatest.max(initial=_LEAST))
            yield tree.names, len(rows), tree

    return pack


def _positives(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """For each anchor score and id of its positives in order, filled up with the least score."""
    lists = column.to_pylist()
    out = np.full((n, max(map(len, lists), default=0), 2), _LEAST)
    for row, found in enumerate(lists):
        for k, p in enumerate(found):
            out[row, k] = p["score"], p["id"]
    return out


def hard_negatives(
    df: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    sizes: vs.Sizes = vs.Sizes(),  # noqa: B008  frozen
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` tells by the id which rows are anchors.  An anchor's positives are the first ``positives`` other
    rows of its label by score (all, if fewer), the negatives of a positive the first ``negatives`` rows of other
    labels with low * p <= 100 * n <= high * p for its score p (all, if fewer; none for p < 0).  Scores are inner
    products of the components floor(256 * x); ties go to the smaller id.

    Rows without id or label, and vectors that are null or hold a null or non-finite component, take no part, nor
    do vectors whose scaled squared norm is 2**62 or more.  Shorter vectors count as filled up with zeros.  Equal rows count
    once; of several vectors or labels with one id each is a candidate, and the smallest of them is the anchor.
    No row is a candidate of an anchor with its own id.  An empty table gives an empty result; other columns are ignored.
    """
    bound_arrow_batches(df.sparkSession)
    rows = staged(vs.whole_numbers(df, id_col, vec_col, label_col), "vectors")
    anchors = rows.where(anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*")
    candidates = vs.blocks(vs.distinct_points(rows, max(positives, negatives) + 1), _trees(sizes.block, sizes.leaf), "candidates", sizes.group)
    packed = vs.blocks(anchors, _trees(sizes.queries, sizes.leaf), "anchors", sizes.group)
    found = vs.searched(_same_label(packed, candidates), packed, candidates, lambda it: _search(it, lambda a: _Positives(a, positives), sizes.at_once), "anchor_id long, id long, score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))
    ranked = found.withColumn("slot", nth).where(F.col("slot") <= positives)
    listed = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "score", "id"))).alias("positives"))
    asking = staged(anchors.join(listed, anchors["id"] == listed["anchor_id"]).select("id", "label", "v", "positives"), "asking")
    packed = vs.blocks(asking, _trees(sizes.queries, sizes.leaf, low, high), "anchors", sizes.group)
    pure = (F.size("left_labels") == 1) & (F.col("left_labels") == F.col("right_labels"))
    # Blocks whose products all lie outside of what the anchors look for are not even sent.
    pairs = vs.all_pairs(packed, candidates).where(~pure & (F.col("top") >= F.col("least")) & (F.col("bottom") <= F.col("most")))
    found = vs.searched(pairs, packed, candidates, lambda it: _search(it, lambda a: _Bands(a, negatives, low, high), sizes.at_once), "anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _same_label(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks that have a label in common."""
    one = left.select(F.col("block").alias("left_block"), F.explode("labels").alias("label"))
    two = right.select(F.col("block").alias("right_block"), F.explode("labels").alias("label"))
    return one.join(two, "label").select("left_block", "right_block").distinct()


class _Needs:
    """What the anchors of a block still look for: scores from ``least`` to ``most``, by anchor."""

    def __init__(self, anchors: BallTree) -> None:
        n = len(anchors.points.ids)
        self.anchors, self.least, self.most = anchors, np.full(n, _LEAST), np.full(n, _MOST)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        raise NotImplementedError


class _Positives(_Needs):
    same = True

    def __init__(self, anchors: BallTree, k: int) -> None:
        super().__init__(anchors)
        self.best = vs.Best.of(len(self.least), k)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(row, scores, ids)
        self.least[row] = self.best.score[row, -1]

    def results(self) -> pa.RecordBatch:
        there = self.best.score != _LEAST
        return _batch(anchor_id=np.repeat(self.anchors.points.ids, there.sum(1)), id=self.best.id[there], score=self.best.score[there])


class _Bands(_Needs):
    """Slot s of anchor a is query a * slots + s."""

    same = False

    def __init__(self, anchors: BallTree, k: int, low: int, high: int) -> None:
        super().__init__(anchors)
        score = anchors.positives[:, :, 0]
        self.low, self.high = _bands(score, low, high)
        self.slots = score.shape[1]
        self.best = vs.Best.of(score.size, k)
        self.least, self.most = self.low.min(1, initial=_MOST), self.high.max(1, initial=_LEAST)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for slot in range(self.slots):
            query = row * self.slots + slot
            fits = (scores >= max(self.low[row, slot], self.best.score[query, -1])) & (scores <= self.high[row, slot])
            if fits.any():
                self.best.add(query, scores[fits], ids[fits])
        last = self.best.score[row * self.slots : (row + 1) * self.slots, -1]
        self.least[row] = np.maximum(self.low[row], last).min()

    def results(self) -> pa.RecordBatch:
        there = self.best.score != _LEAST
        query = np.repeat(np.arange(len(there)), there.sum(1))
        row, slot = query // max(self.slots, 1), query % max(self.slots, 1)
        positive = self.anchors.positives[row, slot]
        return _batch(anchor_id=self.anchors.points.ids[row], slot=slot.astype(np.int32), positive_id=positive[:, 1], positive_score=positive[:, 0], negative_id=self.best.id[there], negative_score=self.best.score[there])


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})


def _search(pairs: Iterator[tuple[int, BallTree, BallTree, None]], needs_of: Callable[[BallTree], _Needs], at_once: int) -> Iterator[pa.RecordBatch]:
    """Searches pair after pair; what a task has found for a block of anchors narrows its later searches."""
    held: dict[int, _Needs] = {}
    for number, anchors, candidates, _ in pairs:
        if number not in held:
            if sum(n.best.score.size for n in held.values()) > _HELD:
                yield from (n.results() for n in held.values())
                held = {}
            held[number] = needs_of(anchors)
        _DualSearch(anchors, candidates, held[number], at_once).pair(0, np.zeros(1, np.int64))
    yield from (n.results() for n in held.values())


class _DualSearch:
    def __init__(self, anchors: BallTree, candidates: BallTree, needs: _Needs, at_once: int = vs.Sizes.at_once) -> None:
        self.a, self.c, self.needs, self.at_once = anchors, candidates, needs, at_once
        self.scores = vs.scorer(anchors.points, candidates.points)
        dim = max(anchors.centre.shape[1], candidates.centre.shape[1])
        self.a_centre, self.c_centre = vs.widen(anchors.centre, dim), vs.widen(candidates.centre, dim)
        self.a_length, self.c_length = (np.sqrt((x * x).sum(1)) for x in (self.a_centre, self.c_centre))
        number = {name: k for k, name in enumerate(anchors.names)}
        self.c_label = np.array([number.get(name, -1) for name in candidates.names])[candidates.label]

    def pair(self, a: int, nodes: np.ndarray) -> None:
        """Anchors below node ``a`` with the candidates below ``nodes``."""
        rows = slice(self.a.first[a], self.a.end[a])
        leaf = self.a.left[a] < 0
        while len(nodes):
            middle = self.c_centre[nodes] @ self.a_centre[a]
            spread = self.a_length[a] * self.c.radius[nodes] + (self.c_length[nodes] + self.c.radius[nodes]) * self.a.radius[a]
            spread += 1e-9 * (np.abs(middle) + spread) + 1e-6
            top = middle + spread
            live = (top >= self.needs.least[rows].min(initial=_MOST)) & (middle - spread <= self.needs.most[rows].max(initial=_LEAST))
            nodes, top = nodes[live], top[live]
            inner = self.c.left[nodes] >= 0
            if leaf and not inner.any():
                self._leaves(rows, nodes[np.argsort(-top)], np.sort(top)[::-1])
                return
            nodes = np.concatenate((self.c.left[nodes[inner]], self.c.right[nodes[inner]], nodes[~inner]))
            if not leaf:
                self.pair(self.a.left[a], nodes)
                self.pair(self.a.right[a], nodes)
                return

    def _leaves(self, rows: slice, leaves: np.ndarray, top: np.ndarray) -> None:
        """Scores a leaf of anchors with leaves of candidates, highest bounds first."""
        needs, ids = self.needs, self.c.points.ids
        own, label = self.a.points.ids[rows], self.a.label[rows]
        for k in range(0, len(leaves), self.at_once):
            if top[k] < needs.least[rows].min(initial=_MOST):
                return
            at = np.concatenate([np.arange(self.c.first[n], self.c.end[n]) for n in leaves[k : k + self.at_once]])
            score = self.scores(rows, at)
            fits = (score >= needs.least[rows][:, None]) & (score <= needs.most[rows][:, None])
            fits &= ((self.c_label[at] == label[:, None]) == needs.same) & (ids[at] != own[:, None])
            for row in np.flatnonzero(fits.any(1)).tolist():
                needs.offer(rows.start + row, score[row, fits[row]], ids[at[fits[row]]])
