"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (an item with fewer words is one window).
Its set is its shingles.  Only exact containment counts, so one prefix token is necessary: the
window's rarest shingle, by counts over all documents; a window with a shingle that no
document holds is dropped.  Documents send where they hold a prefix token, with the words
around, to the join with the distinct windows.  The token's offset bounds where the window has to start and
end, and the window is verified there word by word, as text.

Nothing but two bit filters of a fixed size is broadcast.  They keep words that can't match off the
shuffle; a benchmark too large for them makes the shuffle larger, not the result different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm import textwords as tw
from pricewright.llm.scratch import bound_arrow_batches, staged

WINDOW, SHINGLE = 10, 3
#: The filters hold 2 to this power bits (1 MB).
FILTER_BITS = 23
#: Shingle counts that a task gathers before it sends them.
FLUSH_COUNTS = 1_000_000

_U = np.uint64


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the items with one.
    Null and empty texts have no words; items without words have no windows.  A null item_id
    marks words as hit but isn't counted or listed.  Repeated items count once, repeated rows
    give a row each; empty tables give no rows or no hits; other columns are ignored.
    """
    bound_arrow_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    found = staged(items.distinct().mapInArrow(_item_windows, "item_id string, words array<string>, tokens array<long>"), "itemwindows")
    windows = staged(found.groupBy("words").agg(F.first("tokens").alias("tokens")).withColumn("window", F.monotonically_increasing_id()), "windows")
    prefix = staged(_prefix_tokens(docs, windows), "prefix")
    rows = staged(_with_places(docs, prefix), "places")
    hits = staged(_verified(rows, prefix), "windowhits")
    words = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).select("row", _covered().alias("n_hit"))
    owners = found.select("item_id", "words").distinct().join(windows.select("words", "window"), "words").select("window", "item_id")
    listed = hits.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.drop("places").join(words, "row", "left").join(listed, "row", "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _split(part: pa.RecordBatch) -> tw.Words:
    return tw.split_words(*tw.text_bytes(part.column("text")), tw.ALNUM, lower=True)


def _strings(words: tw.Words, a: int, b: int) -> list[bytes]:
    data = words.data
    return [data[s:e].tobytes() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item's windows: their words, and the hash of the shingle at each place."""
    for batch in batches:
        for part in tw.chunks(batch, "text"):
            words, item, texts, tokens = _split(part), [], [], []
            h = words.hashes()
            for i, name in enumerate(part.column("item_id").to_pylist()):
                a, b = words.first[i : i + 2].tolist()
                size = min(WINDOW, b - a)
                if not size:
                    continue
                own, hashed = _strings(words, a, b), _tokens(h[a:b], min(SHINGLE, size))
                places = size - min(SHINGLE, size) + 1
                item += [name] * (b - a - size + 1)
                texts += [own[k : k + size] for k in range(b - a - size + 1)]
                tokens += [hashed[k : k + places].view(np.int64) for k in range(b - a - size + 1)]
            strings = pa.array(texts, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.record_batch([pa.array(item, pa.string()), strings, pa.array(tokens, pa.list_(pa.int64()))], names=["item_id", "words", "tokens"])


def _tokens(h: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of all shingles of a size; those of two sizes never agree but by chance."""
    return tw.window_hashes(h, shingle, shingle - 1)


def _filter(tokens: DataFrame) -> np.ndarray:
    """One bit for the low bits of every token of a column ``token``; at most 2**(FILTER_BITS - 6) rows come here."""
    bit = F.col("token").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit")
    words = tokens.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(max(1, 1 << (FILTER_BITS - 6)), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


class _Sent:
    """A broadcast filter with the shingle sizes to look for."""

    def __init__(self, df: DataFrame, tokens: DataFrame, sizes: list[int]) -> None:
        self.sizes, self.mask = sizes, (1 << FILTER_BITS) - 1
        self.bits = df.sparkSession.sparkContext.broadcast(_filter(tokens))

    def probe(self) -> np.ndarray:
        return np.unpackbits(self.bits.value.view(np.uint8), bitorder="little").view(bool)

    def found(self, words: tw.Words, h: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each shingle size the words where a shingle that passes starts, and its hash."""
        for size in self.sizes:
            hashed = _tokens(h, size)
            at = np.flatnonzero(probe[(hashed & _U(self.mask)).astype(np.int64)])
            at = at[words.left[at] >= size]
            yield at, hashed[at]


def _prefix_tokens(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """token, offset, window, words: of every window that can occur its rarest shingle, ties by place."""
    places = windows.select("window", F.posexplode("tokens").alias("offset", "token"))
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())  # at most SHINGLE
    sent = _Sent(docs, places.select("token"), sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, waiting, size = sent.probe(), [], 0

        def summed() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([*waiting, np.zeros(0, _U)]), return_counts=True)
            return pa.record_batch([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for part in tw.chunks(batch, "text"):
                words = _split(part)
                for _, hashed in sent.found(words, words.hashes(), probe):
                    waiting.append(hashed)
                    size += len(hashed)
                if size >= FLUSH_COUNTS:
                    yield summed()
                    waiting, size = [], 0
        yield summed()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = places.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = often.groupBy("window").agg(F.min(F.struct("n", "offset", "token")).alias("least")).where(F.col("least.n") > 0)
    return rarest.join(windows.select("window", "words"), "window").select("least.token", "least.offset", "window", "words")


def _with_places(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, doc_id, n_words, places: where a prefix token may stand, with the words around it."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in prefix.select(size).distinct().collect())  # at most SHINGLE
    sent = _Sent(docs, prefix.select("token"), sizes)
    around = [("token", pa.int64()), ("at", pa.int64()), ("back", pa.int64()), ("words", pa.list_(pa.binary()))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = sent.probe()
        for batch in batches:
            for part in tw.chunks(batch, "text"):
                words = _split(part)
                found = [[] for _ in range(part.num_rows)]
                text_of = words.text_of
                for at, hashed in sent.found(words, words.hashes(), probe):
                    for k, token in zip(at.tolist(), hashed.view(np.int64).tolist(), strict=True):
                        text = int(text_of[k])
                        first, last = int(words.first[text]), int(words.first[text + 1])
                        a = max(first, k - WINDOW + 1)
                        found[text].append((token, k - first, k - a, _strings(words, a, min(last, k + WINDOW))))
                flat = [p for some in found for p in some]
                fields = [pa.array([p[j] for p in flat], kind) for j, (_, kind) in enumerate(around)]
                fields[3] = fields[3].cast(pa.list_(pa.string()))
                edges = np.r_[0, np.cumsum([len(some) for some in found])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, [n for n, _ in around]))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), lists], names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, places array<struct<token:long,at:long,back:long,words:array<string>>>"
    return docs.mapInArrow(place, schema).withColumn("row", F.monotonically_increasing_id())


def _verified(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, window, start, end of every occurrence: bounded by offset and length, then compared as text."""
    places = rows.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.token", "p.at", "p.back", F.col("p.words").alias("around"))
    met = places.join(prefix, "token")
    start, length = F.col("at") - F.col("offset"), F.size("words")
    met = met.where((start >= 0) & (start + length <= F.col("n_words")))
    same = F.slice("around", (F.col("back") - F.col("offset") + 1).cast("int"), length) == F.col("words")
    return met.where(same).select("row", "window", start.alias("start"), (start + length).alias("end"))


def _covered():
    """Words in the union of the sorted spans."""
    begin = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        new = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + new).alias("n"))

    return F.aggregate("spans", begin, step, lambda acc: acc["n"])
