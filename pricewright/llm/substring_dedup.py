"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash among its
``MINIMISER``-word parts; consecutive windows with one minimiser overlap almost entirely, so
they travel as one packed string to the minimiser's bucket.  There the windows are cut out
again, sorted and counted, and each window in a document other than the smallest one is
reported back to its document, which then drops the covered words.

Windows that a smaller document also holds are decided before the shuffle where the task has seen
that: within a chunk of texts, and for windows that repeated in a chunk (``_Hot``) within the
whole task.  They don't travel, so a passage in a third of all documents travels about once per task,
not once per document.  A bucket is counted piece by piece; of a window's occurrences only those in the
smallest document so far are held, so memory grows with distinct windows and not with copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm import textwords as tw
from pricewright.llm.scratch import bound_arrow_batches

WINDOW, MINIMISER = 13, 3
#: Buckets per shuffle partition, and packed bytes that a task gathers before it sends them.
BUCKETS_PER_PARTITION, FLUSH_BYTES = 4, 24 * 1024 * 1024
#: Repeated windows that a task remembers (the latest; those forgotten travel), and windows of a bucket counted at once.
HOT_WINDOWS, COUNTED_AT_ONCE = 500_000, 2_000_000

_NO_ID = 2**63 - 1
_ROWS = "bucket int, doc long, key long, packed binary"


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked).

    Words stand between ASCII white space.  A word goes if a window that covers it also starts
    in a document with a smaller id, judged on the input.  Ids are whole numbers; a null id
    counts as larger than all others, and equal ids never remove each other's words.  Null,
    empty and short texts have no windows and lose nothing.  Repeated rows give a row each; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(text_col).alias("key"),  # tells rows with one id apart
        F.col(text_col).cast("string").alias("text"),
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(64, partitions * BUCKETS_PER_PARTITION)
    packed = docs.select("doc", "key", "text").mapInArrow(lambda it: _packed(it, buckets), _ROWS)
    judged = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_judged, _ROWS)
    verdicts = judged.groupBy("doc", "key").agg(F.collect_list("packed").alias("runs"))
    joined = docs.join(verdicts, ["doc", "key"], "left").select("doc_id", "text", "runs")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.mapInArrow(lambda it: _applied(it, keep_text), schema)


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by bucket, and verdicts that the chunk alone can give (bucket -1)."""
    waiting: list[tuple[np.ndarray, ...]] = []
    strings: list[list[bytes]] = []
    size, hot = 0, _Hot()
    for batch in batches:
        for part in tw.chunks(batch, "text"):
            doc, key = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
            words = tw.split_words(*tw.text_bytes(part.column("text")), tw.SPACED)
            at = tw.starts_of_windows(words, WINDOW)
            if not len(at):
                continue
            h, text = words.hashes(), words.text_of[at]
            later = _repeated(tw.window_hashes(h, WINDOW)[at], tw.window_hashes(words.hashes(1), WINDOW, 1)[at], doc[text], hot)
            if later.any():
                yield _verdict_rows(doc[text[later]], key[text[later]], (at - words.first[text])[later])
            at, text = at[~later], text[~later]
            if not len(at):
                continue
            least = _sliding_min(tw.window_hashes(h, MINIMISER), WINDOW - MINIMISER + 1)[at]
            first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (least[1:] != least[:-1])])
            last = np.r_[first[1:], len(at)] - 1
            joined, offset = _one_space(words)
            view = memoryview(joined)
            begin, end = offset[at[first]], offset[at[last] + WINDOW] - 1
            strings.append([view[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            owner = text[first]
            start = (at[first] - words.first[owner]).astype(np.int32)
            waiting.append(((least[first] % np.uint64(buckets)).astype(np.int32), doc[owner], key[owner], start, (end - begin).astype(np.int32)))
            size += int((end - begin).sum())
            if size >= FLUSH_BYTES:
                yield _blobs(waiting, strings)
                waiting, strings, size = [], [], 0
    if waiting:
        yield _blobs(waiting, strings)


class _Hot:
    """Windows that repeated in some chunk of the task, each with the smallest document that held it."""

    def __init__(self) -> None:
        self.first, self.second, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smallest(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each window the smallest document known to hold it, or the largest number."""
        if not len(self.first):
            return np.full(len(first), _NO_ID, np.int64)
        at = np.searchsorted(self.first, first)
        at[at == len(self.first)] = 0
        known = (self.first[at] == first) & (self.second[at] == second)
        return np.where(known, self.doc[at], _NO_ID)

    def remember(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> None:
        first, second, doc = (np.r_[new, old][:HOT_WINDOWS] for new, old in ((first, self.first), (second, self.second), (doc, self.doc)))
        order = np.lexsort((doc, second, first))
        first, second, doc = first[order], second[order], doc[order]
        new = np.r_[True, first[1:] != first[:-1]]  # one window for each first hash is enough
        self.first, self.second, self.doc = first[new], second[new], doc[new]


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes, and where in it a new window begins."""
    order = np.argsort(first, kind="stable")
    if ((np.diff(first[order]) == 0) & (np.diff(second[order]) != 0)).any():
        order = np.lexsort((second, first))
    return order, np.r_[True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)]


def _repeated(first: np.ndarray, second: np.ndarray, doc: np.ndarray, hot: _Hot) -> np.ndarray:
    """Windows of a chunk that also start in a smaller document of the chunk, or of the task if hot."""
    order, new = _groups(first, second)
    ranked, heads = doc[order], np.flatnonzero(new)
    group = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(ranked, heads)
    several = np.maximum.reduceat(ranked, heads) > smallest
    at = order[heads]
    smallest = np.minimum(smallest, hot.smallest(first[at], second[at]))
    if several.any():
        hot.remember(first[at[several]], second[at[several]], smallest[several])
    out = np.zeros(len(first), bool)
    out[order] = ranked > smallest[group]
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _one_space(words: tw.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, a space behind each, and where each begins (one more for the end)."""
    offset = np.r_[0, np.cumsum(words.end - words.start + 1)]
    out = np.full(offset[-1], 0x20, np.uint8)
    is_word = np.ones(offset[-1], bool)
    is_word[offset[1:] - 1] = False
    out[is_word] = words.data[tw.SPACED[words.data].astype(bool)]
    return out, offset


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on, which packs better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind)[:, 0]


def _blobs(waiting: list[tuple[np.ndarray, ...]], strings: list[list[bytes]]) -> pa.RecordBatch:
    """One row per bucket with all its super-k-mers, packed and compressed."""
    bucket, doc, key, start, length = (np.concatenate(x) for x in zip(*waiting, strict=True))
    flat = [s for some in strings for s in some]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    codec, ids, blobs = _codec(), [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        numbers = [_planes(x[own]) for x in (doc, key, start, length)]
        raw = b"".join(numbers + [flat[i] for i in own.tolist()])
        ids.append(int(bucket[own[0]]))
        blobs.append(np.array([b - a, len(raw)], np.int64).tobytes() + codec.compress(raw, asbytes=True))
    none = pa.nulls(len(ids), pa.int64())
    return pa.record_batch([pa.array(ids, pa.int32()), none, none, pa.array(blobs, pa.binary())], names=["bucket", "doc", "key", "packed"])


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, text key and start of each super-k-mer; its length; all bytes."""
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    raw = _codec().decompress(memoryview(blob)[16:], size, asbytes=True)
    doc, key = _from_planes(raw, np.int64, n, 0), _from_planes(raw, np.int64, n, 8 * n)
    start, length = _from_planes(raw, np.int32, n, 16 * n), _from_planes(raw, np.int32, n, 20 * n)
    return doc, key, start, length, np.frombuffer(raw, np.uint8, offset=24 * n)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the windows of one bucket after the other; rows come sorted by bucket."""
    current, waiting, size, enough = None, [], 0, COUNTED_AT_ONCE
    for batch in batches:
        decided = pc.less(batch.column("bucket"), 0)
        yield batch.filter(decided)
        batch = batch.filter(pc.invert(decided))
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
            if waiting and (bucket != current or size >= enough):
                verdicts, held = _counted(waiting)
                yield from verdicts
                # A bucket goes on with what may still be the smallest document of its window.
                waiting = [held] if bucket == current else []
                size, enough = 0, max(COUNTED_AT_ONCE, len(held[0]) if bucket == current else 0)
            current = bucket
            waiting.append(_unpacked(blob.as_py()))
            size += len(waiting[-1][0])
    if waiting:
        yield from _counted(waiting)[0]


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Hash pair, document, text key and start of every window of a blob's super-k-mers."""
    doc, key, start, length, data = _opened(blob)
    words = tw.split_words(data, np.r_[0, np.cumsum(length)], tw.SPACED)
    at = tw.starts_of_windows(words, WINDOW)
    owner = words.text_of[at]
    return (
        tw.window_hashes(words.hashes(), WINDOW)[at], tw.window_hashes(words.hashes(1), WINDOW, 1)[at], doc[owner], key[owner],
        (start[owner] + at - words.first[owner]).astype(np.int32),
    )


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """Sorts windows; reports those that a smaller document also holds, and keeps the others.

    Windows are told apart by two sums over independent 64-bit hashes of their words.
    """
    every = [np.concatenate(x) for x in zip(*parts, strict=True)]
    first, second, doc, key, start = every
    if not len(first):
        return [], tuple(every)
    order, new = _groups(first, second)
    ranked = doc[order]
    smallest = np.minimum.reduceat(ranked, np.flatnonzero(new))
    is_later = ranked > smallest[np.cumsum(new) - 1]
    later, held = order[is_later], order[~is_later]
    return [_verdict_rows(doc[later], key[later], start[later])] if len(later) else [], tuple(x[held] for x in every)


def _verdict_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """For each document the removed windows as runs of (first start, number of windows)."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order].astype(np.int32)
    other = np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0)]
    run = np.flatnonzero(other | np.r_[True, np.diff(start) > 1])
    count = (start[np.r_[run[1:], len(start)] - 1] - start[run] + 1).astype(np.int32)
    pairs = np.stack([start[run], count], 1)
    heads = np.flatnonzero(other)
    edge = np.r_[np.searchsorted(run, heads), len(run)]
    blobs = [pairs[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    low = pa.array(-1 - (np.abs(doc[heads]) % 65536).astype(np.int32), pa.int32())  # any bucket below 0 passes through
    return pa.record_batch([low, pa.array(doc[heads]), pa.array(key[heads]), pa.array(blobs, pa.binary())], names=["bucket", "doc", "key", "packed"])


def _applied(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Drops the words covered by reported windows."""
    for batch in batches:
        for part in tw.chunks(batch, "text"):
            words = tw.split_words(*tw.text_bytes(part.column("text")), tw.SPACED)
            begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, blobs in enumerate(part.column("runs").to_pylist()):
                if blobs:
                    runs = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2).astype(np.int64)
                    # No run reaches beyond its own text, whatever it says.
                    last = words.first[i + 1]
                    begin.append(np.minimum(words.first[i] + runs[:, 0], last))
                    end.append(np.minimum(words.first[i] + runs[:, 0] + runs[:, 1] + WINDOW - 1, last))
            gone = tw.covered(len(words.start), np.concatenate(begin), np.concatenate(end))
            kept = tw.Words(words.data, words.start[~gone], words.end[~gone], np.r_[0, np.cumsum(~gone)][words.first])
            length = np.r_[0, np.cumsum(kept.end - kept.start + 1)]
            out = np.full(length[-1], 0x20, np.uint8)
            is_word = np.ones(length[-1], bool)
            is_word[length[1:] - 1] = False
            inside = tw.covered(len(words.data), kept.start, kept.end)
            out[is_word] = words.data[inside]
            view, edge = memoryview(out), length[kept.first]
            texts = [bytes(view[a : max(a, b - 1)]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            n = np.diff(words.first)
            columns = [
                part.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(n - np.diff(kept.first), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([t.decode() for t in texts], pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names=names)
