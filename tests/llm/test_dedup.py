"""Exact, near and substring deduplication, and decontamination, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pricewright.llm import decontaminate as de
from pricewright.llm import exact_dedup as ex
from pricewright.llm import minhash_dedup as mh
from pricewright.llm import substring_dedup as sd
from tests.llm.messy import ALNUM, SPACED, by_id, documents, lower, texts, with_clashes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact(spark):
    found = texts()
    got = by_id(ex.exact_dedup(documents(spark)))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in found]
    for i, t in enumerate(norm):
        same = [k for k, u in enumerate(norm) if u == t]
        assert got[i] == {"doc_id": i, "keep_id": min(same), "group_size": len(same), "kept": i == min(same), "text_sha256": sha(t)}


def test_exact_hot_group_and_ordinary_groups_agree(spark, monkeypatch):
    rows = ["hot"] * 400 + [f"t{i % 50}" for i in range(100)]
    df = documents(spark, rows, extra=False)
    split = by_id(ex.exact_dedup(df))
    monkeypatch.setattr(ex, "HOT_SHARE", 2.0)  # nothing is hot
    assert by_id(ex.exact_dedup(df)) == split
    assert split[399]["keep_id"] == 0 and split[450]["group_size"] == 2


def test_exact_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a"), (None, "n")], "doc_id long, text string")
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ex.exact_dedup(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True)], key=str)


@pytest.mark.parametrize("operator", [ex.exact_dedup, mh.near_dedup, sd.substring_dedup])
def test_empty_tables(spark, operator):
    assert operator(documents(spark).limit(0)).count() == 0


def shingles(text):
    w = SPACED.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(found, percent):
    sets = [shingles(t) for t in found]
    label = list(range(len(sets)))
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sets, label


@pytest.mark.parametrize("percent", [85, 80])
def test_near(spark, percent):
    found = texts()
    got = by_id(mh.near_dedup(documents(spark), percent=percent))
    sets, label = components(found, percent)
    for i in range(len(found)):
        assert got[i] == {"doc_id": i, "n_shingles": len(sets[i]), "component_id": label[i], "kept": label[i] == i}


def test_near_chains_through_blocks(spark, monkeypatch):
    """A large group of copies that each differ a little, in blocks far smaller than the group."""
    monkeypatch.setattr(mh, "TILE_DOCUMENTS", 8)
    monkeypatch.setattr(mh, "HEAD_PARTNERS", 4)
    words = [f"w{i}" for i in range(200)]
    rows = [" ".join([*words[:k], *(f"z{k}" for _ in range(1)), *words[k + 1 :]]) for k in range(0, 200, 3)]
    rows += [" ".join(words[:90] + [f"q{k}{i}" for i in range(110)]) for k in range(20)]
    got = by_id(mh.near_dedup(documents(spark, rows, extra=False)))
    sets, label = components(rows, 85)
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(label))


def test_near_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "other words"), (None, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_dedup(df).collect()), key=str)
    assert rows == sorted([(None, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=str)


def test_near_null_id_copy_leaves_other_null_ids_alone(spark):
    """A copy without an id neither drops another row without an id nor another row of its id."""
    a, y = "a b c d e f g h", "quite other words are in here"
    for other in (None, 5):
        df = spark.createDataFrame([(1, a), (other, a), (other, y), (other, a + "")], "doc_id long, text string")
        rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_dedup(df).collect()), key=str)
        assert rows == sorted([(1, 1, True), (other, 1, False), (other, 1, False), (other, other, True)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_templates_that_hardly_differ(spark, monkeypatch, seed):
    """Groups around the threshold: some pairs are links, some almost, in tiles of a few documents."""
    monkeypatch.setattr(mh, "TILE_DOCUMENTS", 5)
    monkeypatch.setattr(mh, "HEAD_PARTNERS", 3)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(60):
        own = list(words)
        for _ in range(r.choice([1, 1, 2, 3])):
            own[r.randrange(120)] = f"c{r.randrange(1000)}"
        rows.append(" ".join(own))
    got = by_id(mh.near_dedup(documents(spark, rows, extra=False)))
    _, label = components(rows, 85)
    assert 1 < len(set(label)) < 60
    assert {i: x["component_id"] for i, x in got.items()} == dict(enumerate(label))


def brute_substring(found, ids=None):
    ids = list(range(len(found))) if ids is None else ids
    words = [SPACED.findall(t or "") for t in found]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept), kept))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_substring(spark, partitions):
    found = texts()
    got = by_id(sd.substring_dedup(documents(spark).repartition(partitions), keep_text=True))
    for i, n, gone, digest, kept in brute_substring(found):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["kept_text"]) == (n, gone, digest, kept)


@pytest.mark.parametrize("hot", [0, 20, 500_000])
def test_substring_many_chunks_and_flushes(monkeypatch, hot):
    monkeypatch.setattr(sd, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(sd, "COUNTED_AT_ONCE", 50)
    monkeypatch.setattr(sd, "HOT_WINDOWS", hot)
    monkeypatch.setattr(sd.tw, "chunks", lambda batch, column, n=300, real=sd.tw.chunks: real(batch, column, n))
    found = texts(seed=3)
    rows = list(zip(range(len(found)), found, strict=True))
    import pyarrow as pa

    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([7] * len(rows)), pa.array([t for _, t in rows], pa.string())], names=["doc", "key", "text"])
    judged = [r for b in sd._judged(sorted_blobs(sd._packed(iter([batch]), 16))) for r in b.to_pylist()]
    runs = {}
    for r in judged:
        runs.setdefault(r["doc"], []).append(r["packed"])
    applied = pa.record_batch([batch.column("doc"), batch.column("text"), pa.array([runs.get(i) for i, _ in rows], pa.list_(pa.binary()))], names=["doc_id", "text", "runs"])
    got = {r["doc_id"]: r for b in sd._applied(iter([applied]), False) for r in b.to_pylist()}
    for i, n, gone, digest, _ in brute_substring(found):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, digest)


def sorted_blobs(batches):
    import pyarrow as pa

    return iter([b for b in pa.Table.from_batches(list(batches)).sort_by("bucket").combine_chunks().to_batches()])


def test_substring_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"v{i}" for i in range(20))
    df = spark.createDataFrame([(2, text), (2, text), (2, other), (None, text), (None, other), (1, other)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in sd.substring_dedup(df).collect()), key=str)
    assert rows == sorted([(2, 0), (2, 0), (2, 20), (None, 20), (None, 20), (1, 0)], key=str)


def test_substring_texts_of_one_id_whose_hashes_share_32_bits(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (None, f"18501 {text}"), (None, "135821 tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where("doc_id is null").select(F.xxhash64("text").bitwiseAND(2**32 - 1)).distinct().count() == 1
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.substring_dedup(df.coalesce(1)).collect())
    assert got == [(2, 0, sha("135821 tail")), (20, 0, sha(text)), (21, 20, sha("18501"))]


def test_near_holds_little_at_a_time():
    """Of a batch of 8 MB of text, and of a tile of 1,200 near texts, Python holds a bounded part."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def peak(rows):
        tracemalloc.start()
        sizes = sum(b.num_rows for b in rows())
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return sizes, most

    r = random.Random(2)
    text = [" ".join(str(r.randrange(10**6)) for _ in range(1200)) for _ in range(1000)]
    ids = pa.array(range(len(text)), pa.int64())
    part = pa.record_batch([ids, ids, ids, pa.array(text)], names=["doc", "k1", "k2", "text"])
    list(mh._signed(iter([part.slice(0, 1)])))
    rows, most = peak(lambda: mh._signed(iter([part])))
    assert rows == len(text) and most < 50, most

    n = 1200
    sets = {i: np.arange(i % 3, 300 + i % 3, dtype=np.uint64) for i in range(n)}
    partners = [(i, np.arange(i + 1, min(i + 10, n))) for i in range(n - 1)]
    rows, most = peak(lambda: [mh._forest(sets, partners, 85)])
    assert rows == n - 1 and most < 30, most


def test_near_and_the_language_stage_send_small_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        for stage in (lambda d: mh.near_dedup(d), lambda d: corpus_pipeline.identify_language(spark, d, "")):
            spark.conf.unset(name)
            stage(documents(spark, ["a b c d e f"] * 2, extra=False).withColumn("lang", F.lit("en")))
            assert int(spark.conf.get(name)) <= 2 * 1024 * 1024
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_substring_runs_stay_inside_their_text():
    import numpy as np
    import pyarrow as pa

    run = np.array([[1, 3]], np.int32).tobytes()
    part = pa.record_batch([pa.array([1, 2]), pa.array(["a b", "c d e"]), pa.array([[run], None], pa.list_(pa.binary()))], names=["doc_id", "text", "runs"])
    got = [(r["doc_id"], r["n_removed"]) for b in sd._applied(iter([part]), False) for r in b.to_pylist()]
    assert got == [(1, 1), (2, 0)]


def benchmark(spark):
    found = texts()
    items = [(10, found[30].upper()), (2, " ".join(found[80].split()[5:28])), (3, "one"), (3, "one"), (4, None), (5, "?!"), (None, "changed"), (7, "no such words here at all " * 3)]
    return items, with_clashes(spark.createDataFrame(items, "item_id long, text string"))


def brute_contamination(found, items):
    windows = []
    for item, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(10, len(w))
        windows += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for t in found:
        w, hit, owners = ALNUM.findall(lower(t or "")), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    owners |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit)))
    return out


@pytest.mark.parametrize("bits", [de.FILTER_BITS, 6])
def test_decontaminate(spark, monkeypatch, bits):
    """Also with a filter so small that it lets nearly everything pass."""
    monkeypatch.setattr(de, "FILTER_BITS", bits)
    monkeypatch.setattr(de, "FLUSH_COUNTS", 100)
    found = texts()
    items, table = benchmark(spark)
    got = by_id(de.decontaminate(documents(spark), table))
    for i, want in enumerate(brute_contamination(found, items)):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_decontaminate_empty_tables(spark):
    _, table = benchmark(spark)
    assert de.decontaminate(documents(spark).limit(0), table).count() == 0
    got = de.decontaminate(documents(spark), table.limit(0))
    assert got.where(F.col("n_hit") > 0).count() == 0 and got.count() == len(texts())
