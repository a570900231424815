"""Periodic run detection by the branching tandem repeats of a suffix tree (Stoye and Gusfield).

A run is a maximal stretch of words with smallest period q, at least ``MIN_REPEATS`` periods and
``MIN_WORDS`` words long.  The words of a text are the letters of the tree.  At a node of depth D two
leaves i and i + D in different children are a tandem repeat of period D that branches, that is, cannot
be shifted right.  Only leaves outside each node's largest child are listed and looked up both ways, so
the lists hold at most n log n entries.  Each repeat is then shifted (rotated) left as far as it goes;
repeats that end up as one stretch are merged, the smallest period names the run.

A word of a run stands in it at least ``MIN_REPEATS`` times, so words that are rarer in their stretch of
text cut it, and the tree is built for what is left.  Many texts are handled at once as one forest: words
of different texts, or of different stretches, are different letters.  Words are compared by a 64-bit
hash; runs are then compared word by word as bytes, and if two different words met, the texts are done
again with numbers given to the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm import textwords as tw
from pricewright.llm.scratch import bound_arrow_batches

MIN_REPEATS, MIN_WORDS = 4, 6
#: The cutting of rare words is repeated while it takes this share of the words.
CUT_AGAIN = 0.1

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class Runs:
    """Runs of several texts, sorted by text, start and period; ``start`` counts the words of all texts."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_runs, the strongest run, all runs and the text without repeats.

    The strongest run (start, length, period, exponent_milli) has the greatest length / period; of equal
    ones the one that starts first, then the one of the smaller period.  A word is dropped if any run
    holds it after that run's first period.  ``runs`` lists start, length and period of every run; with
    ``keep_text`` there is also ``collapsed_text``.  ``runs_sha256`` and ``collapsed_sha256`` are digests of
    the two.

    Words stand between ASCII white space.  Null and empty texts have no words and no runs.  Ids are
    passed on as they are (null, repeated); every row is judged by itself, an empty table gives an empty
    result, other columns are ignored.  No row meets another one, so nothing is shuffled.
    """
    bound_arrow_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start long, length long, period long>>, "
        "runs_sha256 string, collapsed_sha256 string" + ", collapsed_text string" * keep_text
    )
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _collapsed(it, keep_text), schema)


def _collapsed(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tw.chunks(batch, "text"):
            data, offsets = tw.text_bytes(part.column("text"))
            words = tw.split_words(data, offsets, tw.SPACED)
            runs = runs_of(words)
            yield _rows(part.column("doc_id"), words, offsets, runs, keep_text)


def _rows(ids: pa.Array, words: tw.Words, offsets: np.ndarray, runs: Runs, keep_text: bool) -> pa.RecordBatch:
    n = len(offsets) - 1
    first = np.searchsorted(runs.text, np.arange(n + 1))
    start = runs.start - words.first[runs.text]
    gone = tw.covered(len(words.start), runs.start + runs.period, runs.start + runs.length)
    kept, begin, size = _joined(words, offsets, ~gone)
    best = np.full(n, -1)
    order = np.lexsort((runs.period, start, -(runs.length / runs.period), runs.text))
    has = first[1:] > first[:-1]
    best[has] = order[first[:-1][has]]
    taken = np.maximum(best, 0)
    pick = lambda c: pa.array(c[taken] if len(c) else np.zeros(n, np.int64), pa.int64(), mask=best < 0)
    listed = [f"{s},{length},{p}\n" for s, length, p in zip(start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True)]
    view = memoryview(kept)
    texts = [view[b : b + s] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
    columns = {
        "doc_id": ids,
        "n_words": pa.array(np.diff(words.first), pa.int64()),
        "n_runs": pa.array(np.diff(first), pa.int64()),
        "start": pick(start),
        "length": pick(runs.length),
        "period": pick(runs.period),
        "exponent_milli": pick(1000 * runs.length // np.maximum(runs.period, 1)),
        "runs": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, runs.length, runs.period)], fields=list(_RUN))),
        "runs_sha256": pa.array([hashlib.sha256("".join(listed[a:b]).encode()).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string()),
        "collapsed_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
    }
    if keep_text:
        columns["collapsed_text"] = pa.array([str(t, "utf-8") for t in texts], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _joined(words: tw.Words, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the kept words with one space between, and for each text where its part begins and how long it is."""
    start, end = words.start[kept], words.end[kept]
    text = words.text_of[kept]
    after = (end < offsets[text + 1]).astype(np.int64)  # takes along the separator, if the text has one there
    change = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(change, start, 1)
    np.add.at(change, end + after, -1)
    data = np.where(tw.SPACED[words.data] == 1, words.data, np.uint8(0x20))[np.cumsum(change[:-1], dtype=np.int8) > 0]
    n = len(offsets) - 1
    taken = np.bincount(text, end - start + after, n).astype(np.int64)
    count = np.bincount(text, minlength=n)
    size = np.bincount(text, end - start, n).astype(np.int64) + np.maximum(count - 1, 0)
    return data, np.cumsum(taken) - taken, size


def runs_of(words: tw.Words) -> Runs:
    """All runs of the texts, exact also where hashes of different words agree."""
    found = _runs(words, words.hashes())
    if not _same_words(words, found):
        numbers: dict[bytes, int] = {}
        data = words.data.tobytes()
        exact = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        found = _runs(words, np.array(exact, np.uint64))
    return found


def _same_words(words: tw.Words, runs: Runs) -> bool:
    """Whether each word of a run and the one a period later have the same bytes."""
    a = _ranges(runs.start, runs.length - runs.period)
    b = a + np.repeat(runs.period, runs.length - runs.period)
    pairs = np.unique(np.column_stack((a, b)), axis=0) if len(a) > 2 * len(words.start) else np.column_stack((a, b))
    a, b = pairs[:, 0], pairs[:, 1]
    size = words.end - words.start
    if (size[a] != size[b]).any():
        return False
    return bool((words.data[_ranges(words.start[a], size[a])] == words.data[_ranges(words.start[b], size[b])]).all())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``size`` numbers, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _runs(words: tw.Words, letters: np.ndarray) -> Runs:
    at, stretch, letter = _frequent(words.text_of, letters)
    start, period, size = _tandem_runs(stretch, letter)
    keep = size >= np.maximum(MIN_WORDS, MIN_REPEATS * period)
    start, period, size = at[start[keep]], period[keep], size[keep]
    order = np.lexsort((period, start + size, start))  # of one stretch the smallest period comes first
    start, period, size = start[order], period[order], size[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (size[1:] != size[:-1])][: len(start)]
    start, period, size = start[new], period[new], size[new]
    order = np.lexsort((period, start))
    text = np.searchsorted(words.first, start[order], "right") - 1
    return Runs(text, start[order], size[order], period[order])


def _frequent(text: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that may stand in a run: their positions, stretches and letters.

    Cut at words that stand in their stretch fewer than MIN_REPEATS times; stretches shorter than MIN_WORDS go.
    """
    at, stretch = np.arange(len(text)), text
    _, letter = np.unique(letters, return_inverse=True)
    while len(at):
        _, letter, count = np.unique(stretch * (np.int64(letter.max()) + 1) + letter, return_inverse=True, return_counts=True)
        keep = count[letter] >= MIN_REPEATS
        before = len(at)
        at, stretch, letter = at[keep], stretch[keep], letter[keep]
        if not len(at):
            break
        stretch = np.cumsum(np.r_[False, (np.diff(at) != 1) | (np.diff(stretch) != 0)])
        long = np.bincount(stretch)[stretch] >= MIN_WORDS
        at, stretch, letter = at[long], stretch[long], letter[long]
        if before - len(at) < CUT_AGAIN * before:
            break
    return at, stretch, letter


def _tandem_runs(stretch: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, period and length of every maximal stretch that a branching tandem repeat leads to."""
    none = np.zeros(0, np.int64)
    n = len(letter)
    if not n:
        return none, none, none
    stretch = np.cumsum(np.r_[False, np.diff(stretch) != 0])
    end = np.cumsum(np.bincount(stretch))[stretch]
    order, classes = _suffixes(stretch, letter, end)
    common = np.zeros(n + 1, np.int64)
    common[1:n] = _common(order[:-1], order[1:], classes, end)
    i, depth = _branching(order, common, end)
    left = _common_before(i - 1, i + depth - 1, classes, np.cumsum(np.r_[0, np.bincount(stretch)])[stretch])
    return i - left, depth, left + 2 * depth


def _suffixes(stretch: np.ndarray, letter: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and for each k the classes of equal parts of 2**k letters.

    A part that would reach beyond its stretch is in a class of its own.
    """
    n = len(letter)
    order = np.lexsort((letter, stretch))
    new = np.r_[True, (letter[order][1:] != letter[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    classes, size = [rank.astype(np.int32)], 1
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_):
        at = order[open_]
        after = at + size
        inside = after < end[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        classes.append(rank.astype(np.int32))
        open_ = open_[~(new & np.r_[new[1:], True])]
        size *= 2
    return order, classes


def _common(x: np.ndarray, y: np.ndarray, classes: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Letters that the suffixes at x and y have in common."""
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(classes[0][x] == classes[0][y])
    for k in range(len(classes) - 1, -1, -1):
        a, b = x[live] + out[live], y[live] + out[live]
        inside = (a < end[x[live]]) & (b < end[y[live]])
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        out[live[inside & (classes[k][a] == classes[k][b])]] += 1 << k
    return out


def _common_before(x: np.ndarray, y: np.ndarray, classes: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
    """Letters that agree going left from x and y (x < y, in one stretch), those at x and y included."""
    out, low = np.zeros(len(x), np.int64), begin[y]
    for k in range(len(classes) - 1, -1, -1):
        a, b = x - out - (1 << k) + 1, y - out - (1 << k) + 1
        inside = a >= low
        same = classes[k][np.where(inside, a, 0)] == classes[k][np.where(inside, b, 0)]
        out[inside & same] += 1 << k
    return out


def _branching(order: np.ndarray, common: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the branching tandem repeats, by smaller-half traversal.

    Entry b of ``common`` stands between leaves b - 1 and b; the entries of one node share its first one
    as their number, 0 is the root.
    """
    n = len(order)
    node, before, after = _nodes(common.tolist())
    own = np.flatnonzero(node == np.arange(n + 1))[1:]  # without the root
    # A node's parent is that of the deeper one of the entries beside it; so is a leaf's.
    parent_of = lambda a, b: node[np.where(common[a] >= common[b], a, b)]
    leaf = np.arange(n)
    child_low, child_size = np.r_[before[own], leaf], np.r_[after[own] - before[own], np.ones(n, np.int64)]
    parent = np.r_[parent_of(before[own], after[own]), parent_of(leaf, leaf + 1)]
    few = after - before < np.where(common == 1, MIN_WORDS, MIN_REPEATS)  # a run's node has a leaf for each period
    below = np.flatnonzero((parent > 0) & ~few[parent])
    by_size = below[np.lexsort((child_size[below], parent[below]))]
    last = np.r_[parent[by_size][1:] != parent[by_size][:-1], True][: len(by_size)]
    small = by_size[~last]
    size = child_size[small]
    i = order[_ranges(child_low[small], size)]
    top = np.repeat(parent[small], size)
    depth, low, high = common[top], before[top], after[top]
    c_low, c_high = np.repeat(child_low[small], size), np.repeat(child_low[small] + size, size)
    place = np.empty(n, np.int64)
    place[order] = leaf
    starts, periods = [], []
    for j in (i + depth, i - depth):
        first, second = np.minimum(i, j), np.maximum(i, j)
        inside = (first >= 0) & (second < end[i]) & (second < n)
        inside[inside] &= end[first[inside]] == end[i[inside]]
        p = place[np.where(inside, j, 0)]
        found = inside & (p >= low) & (p < high) & ~((p >= c_low) & (p < c_high))
        starts.append(first[found])
        periods.append(depth[found])
    both = np.unique(np.column_stack((np.concatenate(starts), np.concatenate(periods))), axis=0)
    return both[:, 0], both[:, 1]


def _nodes(common: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry its node's number; for each node the smaller entries next to it on both sides."""
    n = len(common)
    node, before, after = [0] * n, [0] * n, [n - 1] * n
    stack, top = [0], 0
    for b in range(1, n):
        depth = common[b]
        while top > depth:
            after[node[stack.pop()]] = b
            top = common[stack[-1]]
        if top == depth:
            node[b] = node[stack[-1]]
            stack[-1] = b
        else:
            before[b] = stack[-1]
            node[b] = b
            stack.append(b)
            top = depth
    return np.array(node), np.array(before), np.array(after)
