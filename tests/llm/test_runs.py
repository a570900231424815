"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from pricewright.llm import periodic_runs as pr
from pricewright.llm import textwords as tw
from tests.llm import messy


def brute_force(w):
    """(start, length, period) of every run, by comparing the words with those each period later."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_texts(seed, count):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        w = [r.choice("abcdefgh"[: r.randint(1, 5)]) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            at, p = r.randrange(len(w) + 1), r.randint(1, 9)
            for i in range(at + p, min(len(w), at + p * r.randint(2, 8))):
                w[i] = w[i - p]
        out.append(w)
    return out


def found(texts):
    words = tw.split_words(*tw.text_bytes(pa.array(texts)), tw.SPACED)
    runs = pr.runs_of(words)
    got = [[] for _ in texts]
    for t, s, n, p in zip(runs.text, runs.start - words.first[runs.text], runs.length, runs.period, strict=True):
        got[t].append((int(s), int(n), int(p)))
    return got


def test_runs_equal_brute_force():
    texts = periodic_texts(3, 500)
    assert found([" ".join(w) for w in texts]) == [brute_force(w) for w in texts]


def test_runs_of_known_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases = ["", "x", "x x x x x", "x x x x x x", "a b a b a b a b", "a b a b a b a", " ".join(fibonacci[-1]), "a a a a a a b " * 5, None]
    assert found(cases) == [brute_force((c or "").split()) for c in cases]
    assert found(["x x x x x x"]) == [[(0, 6, 1)]]
    assert found(["a a a a a a b " * 5])[0][-1] == (28, 6, 1)


def test_long_texts_take_linear_steps():
    n = 400_000
    assert found(["x " * n, "a b c " * n]) == [[(0, n, 1)], [(0, 3 * n, 3)]]


def test_words_whose_hashes_agree_are_told_apart(monkeypatch):
    text = ["p q p q p q p q r p q p r", "p p q p p p p p p"]
    monkeypatch.setattr(tw.Words, "hashes", lambda self, salt=0: np.zeros(len(self.start), np.uint64))
    assert found(text) == [brute_force(t.split()) for t in text]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_whole_rows_and_awkward_tables(spark):
    texts = messy.texts() + [" ".join(w) for w in periodic_texts(4, 60)] + ["wörter und " * 9, "\n\tu v u v u v u v \x0b u"]
    docs = messy.documents(spark, texts)
    got = messy.by_id(pr.collapse_runs(docs, keep_text=True))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = messy.SPACED.findall(t or "")
        runs, row = brute_force(w), got[i]
        assert [tuple(x) for x in row["runs"]] == runs and row["n_runs"] == len(runs) and row["n_words"] == len(w)
        assert row["collapsed_text"] == collapsed(w, runs)
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


def test_empty_table_null_and_repeated_ids(spark):
    assert pr.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a a a a a a"), (7, None), (7, ""), (None, "a a a a a a")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_runs"]) for r in pr.collapse_runs(rows).collect())
    assert got == [(False, 0), (False, 0), (True, 1), (True, 1)]
    assert pr.collapse_runs(rows.select(rows.doc_id.cast("string").alias("doc_id"), "text")).schema["doc_id"].dataType.simpleString() == "string"
