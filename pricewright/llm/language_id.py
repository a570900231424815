"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent 1- to 3-grams by rank, counted over all training
texts.  A text's own most frequent n-grams are compared with every profile: each adds the
distance of its two ranks, or the full profile length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from pricewright.llm import textwords as tw
from pricewright.llm.scratch import bound_arrow_batches, staged

#: N-grams kept of a language and of a text.
PROFILE_SIZE = 400
#: Most languages whose profiles are broadcast at once; more are compared block by block.
MAX_LANGUAGES = 2_000
#: Characters handled at once, so that very long texts need no more memory than that.
PIECE = 1 << 20

UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of a text as numbers, and how often each occurs.

    Letters are lower-cased; runs of anything else are one word boundary, coded 0.  An n-gram
    holds 21 bits for each character; 2- and 3-grams may begin or end at a boundary.
    """
    text = text.lower()
    found, counted = [], []
    carried = np.zeros(1, np.int64)  # the last two codes before the piece; a boundary before the text
    for at in range(0, max(len(text), 1), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.r_[carried, np.where(_letters()[code], code, 0), np.zeros(int(at + PIECE >= len(text)), np.int64)]
        old = len(carried)
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
        two = (code[old - 1 : -1] << 21) | code[old:]
        two = two[two != 0]
        last, middle = code[max(old, 2) :], code[max(old, 2) - 1 : -1]
        three = ((code[max(old, 2) - 2 : -2] << 42) | (middle << 21) | last)[middle != 0]
        one = code[old:]
        grams = np.concatenate([one[one != 0], -two, three])  # 2-grams below 0 stay apart from 3-grams
        grams.sort()
        edge = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
        found.append(grams[edge])
        counted.append(np.diff(np.r_[edge, len(grams)]))
        carried = code[-2:]
    if len(found) == 1:
        return found[0], counted[0]
    gram, where = np.unique(np.concatenate(found), return_inverse=True)
    return gram, np.bincount(where, weights=np.concatenate(counted)).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams in order, ties by number."""
    return grams[np.lexsort((grams, -counts))[:size]]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Profiles by language, from all rows with text and language; all of them come to the driver."""
    return _collected(ranked_profiles(df, text_col, lang_col, size))


def ranked_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """The same profiles as a written table: lang, gram, rank (from 1)."""
    bound_arrow_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0
        for batch in batches:
            for part in tw.chunks(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    grams = ngrams(text)
                    held.setdefault(lang, []).append(grams)
                    waiting += len(grams[0])
                if waiting > 4_000_000:
                    held = {lang: [_summed(some)] for lang, some in held.items()}
                    waiting = 0
        for lang, some in held.items():
            gram, n = _summed(some)
            yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return staged(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size), "profiles")


def _collected(ranked: DataFrame) -> dict[str, np.ndarray]:
    found = ranked.select("lang", "gram", "rank").toArrow().to_pandas().sort_values(["lang", "rank"])
    return {lang: own["gram"].to_numpy() for lang, own in found.groupby("lang")}


def _summed(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, where = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
    return gram, np.bincount(where, weights=np.concatenate([n for _, n in some])).astype(np.int64)


def identify(
    df: DataFrame,
    profiles: dict[str, np.ndarray],
    text_col: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
    letters: str | None = None,
) -> DataFrame:
    """Adds lang_pred and score (or other ``names``) to every row, from the text alone.

    ``score`` is 1 less the out-of-place distance as a part of the largest possible one.  Null
    texts and texts without a letter are ``und`` with score 0, as are all texts if there is no
    profile.  Of equally near languages the first in code-point order is chosen.  The result
    has the columns of ``df``, with the new ones in place of any of their names.  ``letters``
    names one more column: whether the text has a letter, which needs no profile.
    """
    bound_arrow_batches(df.sparkSession)
    languages = sorted(profiles)
    sent = df.sparkSession.sparkContext.broadcast([profiles[x] for x in languages])
    added = [*names, *([letters] if letters else [])]
    kept = df.drop(*added)
    text_at = kept.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max([PROFILE_SIZE, *map(len, sent.value)])
        gram, rank = _by_gram(sent.value, size)
        for batch in batches:
            lang, score, lettered = [], [], []
            for text in batch.column(text_at):
                best, near, some = _nearest(text.as_py(), gram, rank, size)
                lang.append(languages[best] if best >= 0 else UNDETERMINED)
                score.append(near)
                lettered.append(some)
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lettered, pa.bool_())][: len(added)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *added])

    fields = [StructField(n, t) for n, t in zip(added, (StringType(), DoubleType(), BooleanType()), strict=False)]
    schema = StructType([*kept.schema.fields, *fields])
    return kept.mapInArrow(predict, schema)


def identify_ranked(
    df: DataFrame,
    ranked: DataFrame,
    text_col: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
    letters: str | None = None,
    max_languages: int = MAX_LANGUAGES,
) -> DataFrame:
    """``identify`` with the profiles of ``ranked_profiles``, however many languages there are.

    Beyond ``max_languages`` every block of languages is compared with all texts; rows are told
    apart by a number given once, and each takes the best that any block found.
    """
    blocks = max(1, -(-ranked.where(F.col("rank") == 1).count() // max_languages))
    if blocks == 1:
        return identify(df, _collected(ranked), text_col, names, letters)
    kept = df.drop(*names, *([letters] if letters else []))
    row = "row"
    while row in kept.columns:
        row += "_"
    numbered = staged(kept.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("number"), F.col(text_col).alias("text"))
    found = None
    for b in range(blocks):
        own = _collected(ranked.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b))
        part = identify(texts, own, names=("language", "near"), letters="lettered").drop("text")
        # A block without profiles says und with score 0, which must not win over a language.
        part = staged(part.withColumn("none", F.lit(not own)), "block")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("number").agg(F.min(F.struct("none", (-F.col("near")).alias("far"), "language", "lettered")).alias("b"))
    added = [F.col("b.language").alias(names[0]), (-F.col("b.far")).alias(names[1])]
    added += [F.col("b.lettered").alias(letters)] if letters else []
    return numbered.join(best, F.col(row) == F.col("number")).select(*(F.col(f"`{c}`") for c in kept.columns), *added)


def _by_gram(profiles: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the profiles, sorted, and their rank in each one (absent: -1)."""
    gram = np.unique(np.concatenate([*profiles, np.zeros(0, np.int64)]))
    rank = np.full((len(gram), len(profiles)), -1, np.int64)
    for k, p in enumerate(profiles):
        rank[np.searchsorted(gram, p), k] = np.arange(len(p))
    return gram, rank


def _nearest(text: str | None, gram: np.ndarray, rank: np.ndarray, size: int) -> tuple[int, float, bool]:
    """Number of the nearest profile (none: -1), its score, and whether the text has a letter."""
    own = top(*ngrams(text or ""))
    if not len(own) or not rank.size:
        return -1, 0.0, len(own) > 0
    at = np.searchsorted(gram, own)
    at[at == len(gram)] = 0
    there = np.where((gram[at] == own)[:, None], rank[at], -1)
    apart = np.where(there >= 0, np.abs(there - np.arange(len(own))[:, None]), size)
    distance = np.minimum(apart, size).sum(axis=0)
    best = int(np.argmin(distance))
    return best, 1.0 - float(distance[best]) / (size * len(own)), True


def language_id(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the rows that aren't held out, predicts all."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    profiles = ranked_profiles(rows.where(~held_out(F.col("doc_id"))))
    predicted = identify_ranked(rows.select("doc_id", "text"), profiles)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
