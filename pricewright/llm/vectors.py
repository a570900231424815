"""Whole-number vectors in blocks of bounded size, and the pairing of blocks.

A block holds near vectors, a bounded number of them (``Sizes``), as one row of a table.  Rows are first dealt to
regions around a bounded sample of pivots; a region with many rows is split by a hash of the id, so no
group is much larger than its size.  Searching a set of blocks against another one pairs block
numbers, never rows, and joins the packed blocks to the pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.scratch import staged

SCALE = 256
#: Pivots of the regions.
MAX_PIVOTS = 256
#: Share of the extent that a gap must have for a cut there.
WIDE_GAP = 0.2
#: Scores of vectors with a smaller squared norm fit in 64 bits.
MAX_SQUARED_NORM = float(2**62)
_EXACT_IN_DOUBLE = float(2**53)
#: ``least`` and ``most``: the scores that rows of the block look for, if they look for any in particular.
BLOCK = "block long, labels array<string>, rows int, centre array<double>, radius double, least long, most long, payload binary"
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, scale: int = SCALE) -> DataFrame:
    """id, label (null without ``label_col``) and v, each component x as floor(scale * x).

    Left out: rows without an id, vectors that are null or hold a null or non-finite component, vectors of
    a squared norm of 2**62 or more (their scores may not fit in 64 bits), with ``label_col`` also rows without a label.
    """
    label = F.lit(None) if label_col is None else F.col(label_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squared = F.aggregate("x", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale))
    there = F.col("id").isNotNull() & finite & (squared < MAX_SQUARED_NORM)
    there = there if label_col is None else there & F.col("label").isNotNull()
    return rows.where(there).select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct rows, and of equal vectors of one label those with the ``keep`` smallest ids.

    More of them can't be among the first ``keep`` - 1 of any search that breaks ties by id and leaves out one
    row.  Both steps reduce before they shuffle, so a vector in a third of all rows travels a few times per task.
    """
    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    return rows.distinct().withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    size = np.diff(offsets)
    out = np.zeros((len(column), int(size.max()) if len(size) else 0), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size) if len(size) else row
    out[row, at] = np.asarray(column.values)[offsets[0] : offsets[-1]] if len(size) else 0
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def widen(x: np.ndarray, dim: int) -> np.ndarray:
    """As doubles, with ``dim`` columns (those that are added hold zeros)."""
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x
    return x.astype(np.float64)


@dataclass(frozen=True)
class Sizes:
    """Rows of a block, of a block of queries, of the group that one task packs, entries of a page and rows of a leaf; leaves scored at once.

    More rows make more blocks, nothing is capped.
    """

    block: int = 4096
    queries: int = 1024
    group: int = 32_768
    page: int = 128
    leaf: int = 32
    at_once: int = 8


class Points:
    """Whole-number vectors (as rows) with their ids and labels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.x, self.ids, self.labels = narrow(x), ids, labels
        self.length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        self._double: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_double": None}

    def double(self, dim: int) -> np.ndarray:
        """The vectors as doubles, with ``dim`` columns at least."""
        if self._double is None or self._double.shape[1] < dim:
            self._double = widen(self.x, max(dim, self.x.shape[1]))
        return self._double


def points_of(table: pa.Table | pa.RecordBatch) -> Points:
    labels = table["label"].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table["label"].to_numpy()
    return Points(matrix(table["v"]), np.asarray(table["id"].to_numpy()), labels.astype(object))


def scorer(a: Points, b: Points) -> Callable[[object, object], np.ndarray]:
    """Exact inner products of some rows of ``a`` with some of ``b``, as 64-bit numbers.

    No sum on the way exceeds the product of the lengths, so doubles don't round where that is below 2**52.
    """
    most = float(a.length.max(initial=0)) * float(b.length.max(initial=0))
    dim = max(a.x.shape[1], b.x.shape[1])
    if most < _EXACT_IN_DOUBLE / 2:
        da, db = a.double(dim), b.double(dim)
        return lambda i, j: (da[i] @ db[j].T).astype(np.int64)
    ia, ib = (np.pad(p.x, ((0, 0), (0, dim - p.x.shape[1]))).astype(np.int64) for p in (a, b))
    return lambda i, j: ia[i] @ ib[j].T


def halves(x: np.ndarray) -> np.ndarray:
    """Which of the rows go to the second part, by their place between two rows that are far apart.

    Cut at a wide gap, if there is one that leaves an eighth on either side, else in the middle.
    """
    far = ((x - x.mean(0)) ** 2).sum(1).argmax()
    a = x[far]
    b = x[((x - a) ** 2).sum(1).argmax()]
    along = x @ (b - a)
    order, n = np.argsort(along, kind="stable"), len(x)
    gap = np.diff(along[order])[max(n // 8 - 1, 0) : n - n // 8]
    at = n // 2
    if len(gap) and gap.max() > WIDE_GAP * (along[order[-1]] - along[order[0]]):
        at = max(n // 8 - 1, 0) + int(gap.argmax()) + 1
    second = np.zeros(n, bool)
    second[order[at:]] = True
    return second


def cut(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in parts of near ones, at most ``most`` each."""
    if len(rows) <= most:
        return [rows]
    second = halves(x[rows])
    return cut(x, rows[~second], most) + cut(x, rows[second], most)


def blocks(points: DataFrame, pack: Callable[[pa.Table], Iterator[tuple[list[str], int, object]]], name: str, group_rows: int) -> DataFrame:
    """Packs ``points`` (id, label, v and more) into a written table of blocks.

    ``pack`` gets about ``group_rows`` near rows and gives, for each block, its labels, its number of rows and
    what to store.
    """
    n = points.count()
    wanted = max(1, min(MAX_PIVOTS, n // group_rows))
    pivots = matrix(points.orderBy(F.xxhash64("id", "v"), "id").limit(wanted).select("v").toArrow()["v"]).astype(np.float64) if wanted > 1 else np.zeros((1, 0))
    placed = points.mapInArrow(lambda it: _placed(it, pivots), _with(points, "region int")) if wanted > 1 else points.withColumn("region", F.lit(0))
    counted = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}  # as many as pivots at most
    parts = F.create_map(*(F.lit(int(x)) for r, c in sorted(counted.items()) for x in (r, -(-c // group_rows)))) if counted else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("id"), parts[F.col("region")].cast("long")).cast("int")
    grouped = placed.withColumn("part", part).groupBy("region", "part")
    return staged(grouped.applyInArrow(lambda key, t: _packed(key, t, pack), BLOCK), name)


def _with(df: DataFrame, more: str) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in df.dtypes) + ", " + more


def _placed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("v")).astype(np.float64)
        dim = max(x.shape[1], pivots.shape[1])
        x, p = widen(x, dim), widen(pivots, dim)
        region = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1) if len(x) else np.zeros(0)
        yield batch.append_column("region", pa.array(region.astype(np.int32)))


def _packed(key: tuple, table: pa.Table, pack) -> pa.Table:
    region, part = (k.as_py() for k in key)
    found = list(pack(table))
    numbers = [(region << 42) | (part << 12) | k for k in range(len(found))]
    balls = [_ball(f[2] if isinstance(f[2], Points) else f[2].points) for f in found]
    asks = [getattr(f[2], "asks", (LEAST, MOST)) for f in found]
    return pa.table({
        "block": pa.array(numbers, pa.int64()),
        "labels": pa.array([f[0] for f in found], pa.list_(pa.string())),
        "rows": pa.array([f[1] for f in found], pa.int32()),
        "centre": pa.array([b[0] for b in balls], pa.list_(pa.float64())),
        "radius": pa.array([b[1] for b in balls], pa.float64()),
        "least": pa.array([int(a[0]) for a in asks], pa.int64()),
        "most": pa.array([int(a[1]) for a in asks], pa.int64()),
        "payload": pa.array([pickle.dumps(f[2], 5) for f in found], pa.binary()),
    })


def _ball(points: Points) -> tuple[np.ndarray, float]:
    x = points.double(points.x.shape[1])
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max(initial=0)))


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of blocks: numbers, labels, what the left one looks for, the interval of all inner products, and the distance of the centres.

    Right blocks are dealt to as many slots as there are, left ones go to each slot; no payload is moved.
    """
    slots = max(1, right.count())
    columns = ("block", "labels", "centre", "radius")
    dealt = right.select(*(F.col(c).alias(f"right_{c}") for c in columns), F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")
    sent = left.select(*(F.col(c).alias(f"left_{c}") for c in columns), "least", "most", every)
    a, c, r, s = (F.col(x) for x in ("left_centre", "right_centre", "left_radius", "right_radius"))
    none = F.lit(0.0)
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p, none) * F.coalesce(q, none)), none, lambda t, z: t + z)
    pairs = sent.join(dealt, "slot").withColumns({"_ac": product(a, c), "_aa": product(a, a), "_cc": product(c, c)})
    spread = F.sqrt("_aa") * s + F.sqrt("_cc") * r + r * s
    spread = spread + 1e-9 * (F.abs("_ac") + spread) + 1e-3  # more than rounding can take
    return pairs.select(
        "left_block", "right_block", "left_labels", "right_labels", "least", "most",
        (F.col("_ac") - spread).alias("bottom"), (F.col("_ac") + spread).alias("top"), (F.col("_aa") - 2 * F.col("_ac") + F.col("_cc")).alias("apart"),
    )


def searched(pairs: DataFrame, left: DataFrame, right: DataFrame, search: Callable[[Iterator[tuple[int, object, object, object]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``search`` over the pairs of packed blocks of each task: left number, left, right, and what ``pairs`` has in ``more`` (else None)."""
    one = left.select(F.col("block").alias("left_block"), F.col("payload").alias("left_payload"))
    two = right.select(F.col("block").alias("right_block"), F.col("payload").alias("right_payload"))
    more = [c for c in pairs.columns if c == "more"]
    joined = pairs.select("left_block", "right_block", *more).join(one, "left_block").join(two, "right_block")
    return joined.mapInArrow(lambda it: search(_unpacked(it)), schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, object, object]]:
    """Payloads are pickles that ``_packed`` wrote; the last one on each side is kept, as neighbours often share it."""
    last: list[tuple[bytes, object]] = [(b"", None), (b"", None)]
    for batch in batches:
        more = batch.column("more") if "more" in batch.schema.names else None
        for k in range(batch.num_rows):
            for side, name in enumerate(("left_payload", "right_payload")):
                data = batch.column(name)[k].as_py()
                if data != last[side][0]:
                    last[side] = (data, pickle.loads(data))
            yield batch.column("left_block")[k].as_py(), last[0][1], last[1][1], None if more is None else more[k].as_py()


@dataclass
class Best:
    """For each of several queries its first ``k`` ids by falling score, then by id."""

    score: np.ndarray
    id: np.ndarray

    @staticmethod
    def of(n: int, k: int) -> Best:
        return Best(np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max))

    @property
    def last(self) -> np.ndarray:
        """The score to reach, least possible while there are fewer than k."""
        return self.score[:, -1]

    def add(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[row], score)), np.concatenate((self.id[row], ids))
        order = np.lexsort((i, ~s))[: self.score.shape[1]]  # ~s falls as s grows, without overflow
        self.score[row], self.id[row] = s[order], i[order]
