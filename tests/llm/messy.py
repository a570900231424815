"""A small table with every awkward case, and plain-Python helpers to check results against."""

from __future__ import annotations

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: Columns whose names operators use for their own results or steps.
CLASHING = ("keep_id", "group_size", "size", "hash", "key", "doc", "words", "score", "shard", "version", "row", "component_id", "hits", "copies", "label", "suffix")


def lower(text):
    return text.translate(ASCII_LOWER)


def texts(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages, repeats, odd characters, empty and long ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    out = list(base)
    out += [base[3], base[3], base[4].replace(" ", "\n\t "), base[5].upper()]
    for i in range(10, 30):
        words = base[i].split()
        words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{base[i]} {passage} {base[i + 1]}" for i in range(30, 38)]
    out += [passage, "x " * 3000, ("lange wörter " * 4000), "", "   ", None, None, "!!! ... 123", "one", "\u00a0\u2003 a\u0000b", "Ünïcödé " * 20, passage + " " + passage]
    return out


def documents(spark, rows=None, extra=True):
    """doc_id, text, lang, source, n_chars and clashing columns; some ids, sources and languages are null."""
    found = texts() if rows is None else rows
    data = []
    for i, t in enumerate(found):
        lang = [None, "en", "fr"][i % 3]
        source = None if i % 11 == 0 else f"src{i % 4}" if i % 2 else "src0"
        data.append((i, t, lang, source, None if t is None else len(t)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return with_clashes(df) if extra else df


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def by_id(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}
