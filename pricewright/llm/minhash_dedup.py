"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

Documents with equal shingle sets are one node, which is posted under each (coordinate, value) of
its MinHash signature.  A pair that agrees on at least m coordinates must meet under one of
each node's rarest postings, if it posts only s - m + 1 of its s shared ones (prefix filter),
and a node that shares fewer than m values with anything cannot match.

Collisions are then counted in two steps.  Each node is first counted against the head of the
posting lists it shares most, which joins tight groups in linear work.  Merging skips posting
lists whose members are joined already; in the others, the members outside the largest joined
part are counted against all others, tile by tile.  Pairs with at least m agreeing coordinates
are confirmed on full sets.  Pairs never leave a task as rows: a node carries its partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm import textwords as tw
from pricewright.llm.components import connected_components
from pricewright.llm.scratch import bound_arrow_batches, staged

SHINGLE, PERCENT = 5, 85
#: Signature length, and the highest chance to miss a pair that is just similar enough.
COORDINATES, MISS = 64, 3e-6
#: Partners that are confirmed together with their head; documents and shingles of one side of a tile.
HEAD_PARTNERS, TILE_DOCUMENTS, TILE_SHINGLES = 64, 1024, 500_000
#: Bytes of a batch sent to Python, which the JVM holds several times outside its heap, and of text whose words are held at once.
BATCH_BYTES, CHUNK_BYTES = 2 * 1024 * 1024, 512 * 1024
#: Columns of shingles that are multiplied at once.
DENSE_SHINGLES = 1024
#: Parts into which the documents of one component are dealt when they learn its smallest id.
SALTS = 8

_U = np.uint64
_MULTIPLIERS = np.random.default_rng(64).integers(0, 2**63, 4 * COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_SIGNED = "doc long, k1 long, k2 long, n_shingles long, low long, high long, signature array<long>"
_PARTNERS = "grp long, i long, j long, node long, partners array<long>"
_TILE = ("grp", "i", "j")


def matches_for(percent: int) -> int:
    """Agreeing coordinates that make a candidate: the most for which a pair at ``percent`` percent is
    missed with a probability of at most MISS (of 64, 40 at 85 % and 35 at 80 %)."""
    p, missed = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed > MISS:
            return max(1, m)
    return COORDINATES


def shingle_sets(part: pa.RecordBatch, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of every text; too short a text is one shingle."""
    words = tw.split_words(*tw.text_bytes(part.column("text")), tw.SPACED, lower=True)
    h = words.hashes()
    every = tw.window_hashes(h, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = every[a : b - size + 1] if b - a >= size else tw.window_hashes(h[a:b], b - a) if b > a else every[:0]
        own = np.sort(own)
        yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets overlap in at least ``percent`` percent of
    their union.  ``component_id`` is the smallest id that links reach; that document is kept.
    Null and empty texts have no shingles and no links and are kept.  Ids are whole numbers and
    need not be unique: every row is judged by its own text.  A null id is larger than any other;
    where links reach null ids only, ``component_id`` is null and all those rows are kept.  An
    empty table gives an empty result; other columns are ignored.
    """
    bound_arrow_batches(df.sparkSession, BATCH_BYTES)
    text = F.col(text_col).cast("string")
    # An id and two hashes of the text name a row up to equal texts, which are one node anyway.
    keys = [F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    docs = df.select(*keys, text.alias("text"))
    signed = staged(docs.mapInArrow(_signed, _SIGNED), "signatures")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2")).alias("rep")
    sets = signed.where(F.col("n_shingles") > 0).groupBy("low", "high").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = staged(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = connected_components(_links(docs, nodes, percent))
    # Smallest id of each component, then of each set.
    known = nodes.select("low", "high", "node", "rep.none", "rep.doc").join(found, "node", "left")
    least = known.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("none", "doc")).alias("least"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    ids = known.join(least.select("component", "least", salts), ["component", "salt"], "left").select(
        "low", "high", F.when(F.col("least").isNotNull(), F.col("least.doc")).otherwise(F.col("doc")).alias("least_doc")
    )
    joined = signed.select("doc", "n_shingles", "low", "high").join(ids, ["low", "high"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc")).otherwise(F.col("least_doc"))
    kind = df.schema[id_col].dataType
    return joined.select(
        F.col("doc").cast(kind).alias("doc_id"), "n_shingles", component.cast(kind).alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept")
    )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, set digest and MinHash signature of every text."""
    for batch in batches:
        for part in tw.chunks(batch, "text", CHUNK_BYTES):
            size, low, high, signatures = [], [], [], []
            for own in shingle_sets(part):
                size.append(len(own))
                low.append(int(own.sum().view(np.int64)))
                high.append(int(tw.mix(own + _U(1)).sum().view(np.int64)))
                least = np.full(COORDINATES, 2**64 - 1, _U)
                for at in range(0, len(own), 2048):
                    np.minimum(least, (own[at : at + 2048, None] * _MULTIPLIERS[:COORDINATES]).min(axis=0), out=least)
                signatures.append(least.view(np.int64))
            flat = pa.array(np.concatenate([*signatures, np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * COORDINATES), flat)
            keys = [part.column(c) for c in ("doc", "k1", "k2")]
            yield pa.record_batch(
                [*keys, pa.array(size, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists],
                names=["doc", "k1", "k2", "n_shingles", "low", "high", "signature"],
            )


def _links(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links a, b between nodes whose components are those of all links."""
    matches = matches_for(percent)
    prefix = _prefix_postings(nodes, matches)
    heads = prefix.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    met = staged(prefix.join(heads.select("key", "head"), "key"), "met")
    texts = _texts(docs, nodes, met)
    signatures = nodes.select("node", "n_shingles", F.transform("signature", lambda v: F.hash(v)).alias("marks"))
    by_head = staged(_confirmed(_head_groups(met, signatures, matches, percent), texts, percent), "headlinks")
    joined = connected_components(by_head)
    counted = staged(_tiles(met, joined, signatures).mapInArrow(lambda it: _collided(it, matches, percent), _PARTNERS), "collided")
    return by_head.unionByName(staged(_confirmed(counted, texts, percent), "tilelinks"))


def _prefix_postings(nodes: DataFrame, matches: int) -> DataFrame:
    """node, n_shingles, coordinate, key: the rarest shared postings of nodes that share enough."""
    postings = nodes.select("node", "n_shingles", F.posexplode("signature").alias("coordinate", "value")).select(
        "node", "n_shingles", "coordinate", F.xxhash64("coordinate", "value").alias("key")
    )
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1)
    of_node = Window.partitionBy("node")
    rarest = of_node.orderBy("often", "key")
    ranked = postings.join(shared, "key").select("*", F.count(F.lit(1)).over(of_node).alias("s"), F.row_number().over(rarest).alias("rank"))
    enough = (F.col("s") >= matches) & (F.col("rank") <= F.col("s") - matches + 1)
    return staged(ranked.where(enough).select("node", "n_shingles", "coordinate", "key"), "prefix")


def _texts(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """node, text: one text of every node that meets another."""
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", *(F.col(f"rep.{c}").alias(f"r_{c}") for c in ("doc", "k1", "k2")))
    same = (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2")) & F.col("doc").eqNullSafe(F.col("r_doc"))
    # The nodes grow with the input, so they are never broadcast, at no size.
    return staged(docs.join(wanted.hint("merge"), same).select("node", "text"), "texts")


def _sides(n: str | Column, shingles: str | Column) -> Column:
    """Blocks that so many documents with so many shingles are dealt into."""
    n, shingles = (F.col(c) if isinstance(c, str) else c for c in (n, shingles))
    return F.greatest(F.ceil(n / TILE_DOCUMENTS), F.ceil(shingles / TILE_SHINGLES), F.lit(1))


def _head_groups(met: DataFrame, signatures: DataFrame, matches: int, percent: int) -> DataFrame:
    """Every node with the head it shares most postings with, if enough coordinates agree; heads
    repeat for every HEAD_PARTNERS partners."""
    shares = met.where(F.col("node") != F.col("head")).groupBy("node", "head").agg(F.count(F.lit(1)).alias("shared"))
    best = shares.groupBy("node").agg(F.max(F.struct("shared", (-F.col("head")).alias("order"))).alias("best"))
    pairs = best.select("node", (-F.col("best.order")).alias("head"))
    heads = signatures.toDF("head", "head_shingles", "head_marks")
    agreeing = F.size(F.filter(F.zip_with("marks", "head_marks", lambda x, y: x == y), lambda same: same))
    fits = 100 * F.least("n_shingles", "head_shingles") >= percent * F.greatest("n_shingles", "head_shingles")
    pairs = staged(pairs.join(signatures, "node").join(heads, "head").where((agreeing >= matches) & fits).select("node", "head", "n_shingles"), "headpairs")
    sizes = pairs.groupBy("head").agg(F.greatest(F.ceil(F.count(F.lit(1)) / HEAD_PARTNERS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).alias("salts"))
    salt = F.pmod(F.xxhash64("node"), F.col("salts"))
    partners = pairs.join(sizes, "head").select(F.col("head").alias("grp"), salt.alias("i"), F.lit(-1).cast("long").alias("j"), "node", F.array("head").alias("partners"))
    salts = sizes.select(F.col("head").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("i"))
    return partners.unionByName(salts.select("grp", "i", F.lit(-1).cast("long").alias("j"), F.col("grp").alias("node"), F.array().cast("array<long>").alias("partners")))


def _tiles(met: DataFrame, joined: DataFrame, signatures: DataFrame) -> DataFrame:
    """Members of posting lists that hold several components, dealt to tiles and sorted by tile.

    The largest component of a list isn't counted against itself: its blocks only meet those of the
    other members.  A list that fits into one tile is one.
    """
    member = met.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    lists = (
        parts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "component")).alias("top"))
        .where(F.col("parts") > 1)
    )
    one = (F.col("n") <= TILE_DOCUMENTS) & (F.col("w") <= TILE_SHINGLES)
    lists = lists.select(
        "key",
        F.when(~one, F.col("top.component")).alias("top"),
        F.when(one, 1).otherwise(_sides(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"))).alias("outside"),
        F.when(one, 0).otherwise(_sides("top.n", "top.w")).alias("inside"),
    )
    placed = member.join(lists, "key").withColumn("in_top", F.coalesce(F.col("component") == F.col("top"), F.lit(False)))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("in_top"), F.col("inside")).otherwise(F.col("outside")))
    placed = placed.withColumn("block", F.when(F.col("in_top"), F.col("outside") + block).otherwise(block))
    # Blocks 0 to outside - 1 meet all blocks, those of the largest component only the former.
    others = F.when(F.col("in_top"), F.col("outside")).otherwise(F.col("outside") + F.col("inside"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others.cast("long") - 1)))
    once = met.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, coordinate)")).alias("posted"))
    sides = signatures.join(once, "node")
    rows = dealt.join(sides.drop("n_shingles"), "node").select(
        F.col("key").alias("grp"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("second"), "node", "component", "n_shingles", "coordinate", "posted", "marks",
    )
    partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *_TILE).sortWithinPartitions(*_TILE)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a tile does, with the edges of their tiles; one tile is held over."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        edges = _edges(rows)
        kept = rows.slice(int(edges[-2]))
        if len(edges) > 2:
            yield rows.slice(0, int(edges[-2])), edges[:-1]
    if kept is not None:
        yield kept, np.array([0, kept.num_rows])


def _edges(rows: pa.RecordBatch) -> np.ndarray:
    keys = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in _TILE])
    return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])


def _collided(batches: Iterator[pa.RecordBatch], matches: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Counts agreeing coordinates of the pairs of every tile; nodes with the partners that match.

    Pairs of one component are skipped.  A pair that meets in several lists is counted in the one
    with the lowest coordinate.
    """
    for rows, edges in _whole_tiles(batches):
        column = lambda name: rows.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        node, component, size, coordinate = (column(c) for c in ("node", "component", "n_shingles", "coordinate"))
        second, posted, marks = column("second"), column("posted"), rows.column("marks").flatten().to_numpy().reshape(-1, COORDINATES)
        out: list[tuple[int, int, np.ndarray]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            left, right = np.flatnonzero(~second[a:b]) + a, np.flatnonzero(second[a:b]) + a
            crossed = len(right) > 0
            right = right if crossed else left
            same = component[left, None] == component[right]
            long, short = np.maximum(size[left, None], size[right]), np.minimum(size[left, None], size[right])
            x, y = np.nonzero(~same & (100 * short >= percent * long))
            if not crossed:
                x, y = x[x < y], y[x < y]
            found = []
            for at in range(0, len(x), 1 << 14):
                p, q = left[x[at : at + (1 << 14)]], right[y[at : at + (1 << 14)]]
                agree = marks[p] == marks[q]
                both = ((posted[p] & posted[q])[:, None] >> np.arange(COORDINATES)) & 1
                here = np.argmax(agree & (both > 0), axis=1) == coordinate[p]
                hit = here & (agree.sum(axis=1) >= matches)
                found.append((p[hit], q[hit]))
            p, q = (np.concatenate([f[k] for f in found]) if found else x for k in (0, 1))
            # A row for every node of a matching pair: the first of a pair carries the second.
            order = np.argsort(p, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(p[order]) != 0]) if len(p) else np.zeros(0, int)
            out += [(a, int(p[order[h]]), node[q[own]]) for h, own in zip(heads, np.split(order, heads[1:]), strict=False)]
            out += [(a, int(r), node[:0]) for r in np.setdiff1d(q, p)]
        if out:
            tile = pa.array([t for t, _, _ in out], pa.int64())
            keys = [rows.column(c).take(tile) for c in _TILE]
            lengths = np.r_[0, np.cumsum([len(p) for _, _, p in out])].astype(np.int32)
            partners = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([p for _, _, p in out])))
            yield pa.record_batch([*keys, pa.array(node[[r for _, r, _ in out]]), partners], names=[*_TILE, "node", "partners"])


def _confirmed(groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links a, b among the partners of the groups, by exact overlap of full sets."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.hint("merge").join(texts, "node").select(*_TILE, "node", "partners", "text")
    return rows.repartition(partitions, *_TILE).sortWithinPartitions(*_TILE).mapInArrow(lambda it: _linked(it, percent), "a long, b long")


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; the sets of one tile are held at a time."""
    current, sets, partners = None, {}, []
    for batch in batches:
        for part in tw.chunks(batch, "text", CHUNK_BYTES):
            keys = zip(*(part.column(c).to_pylist() for c in _TILE), strict=True)
            rows = zip(keys, part.column("node").to_pylist(), part.column("partners"), shingle_sets(part), strict=True)
            for key, node, others, own in rows:
                if key != current and partners:
                    yield _forest(sets, partners, percent)
                if key != current:
                    current, sets, partners = key, {}, []
                sets[node] = own
                if len(others):
                    partners.append((node, others.values.to_numpy()))
    if partners:
        yield _forest(sets, partners, percent)


def _forest(sets: dict[int, np.ndarray], partners: list[tuple[int, np.ndarray]], percent: int) -> pa.RecordBatch:
    """The links among the listed pairs; only a spanning forest of them if there are many."""
    ids = np.array(sorted(sets), np.int64)
    own = [sets[i] for i in ids.tolist()]
    a = np.searchsorted(ids, np.repeat([n for n, _ in partners], [len(p) for _, p in partners]))
    b = np.searchsorted(ids, np.concatenate([p for _, p in partners]))
    size = np.array([len(s) for s in own], np.int64)
    both = _overlaps(own, size)[a, b].astype(np.int64) if len(a) > 4 * len(ids) else None
    if both is None:
        both = np.array([_overlap(own[x], own[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    linked = 100 * both >= percent * (size[a] + size[b] - both)
    a, b = a[linked], b[linked]
    # A link between documents joined already adds nothing.
    root = list(range(len(ids)))
    tree = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[p] = q
            tree.append((x, y))
    x, y = (ids[[t[k] for t in tree]] if tree else ids[:0] for k in (0, 1))
    return pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _overlaps(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Common values of every pair of sets, as whole numbers."""
    n = len(sets)
    common = np.zeros((n, n), np.float32)  # whole numbers below 2**24 are exact
    shingle, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(column, minlength=len(shingle)) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[column] if len(shingle) else column
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for at in range(0, int(often.sum()), DENSE_SHINGLES):
        a, b = np.searchsorted(column, [at, at + DENSE_SHINGLES])
        dense = np.zeros((n, DENSE_SHINGLES), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        common += dense @ dense.T
    return common
