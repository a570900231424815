"""Mixing sources to target weights by hash-threshold histograms (no sorting of documents).

Each source takes ``target / source size`` copies of its words: all documents are taken a
whole number of times, and those whose hash lies below a threshold once more.  The threshold
is found by histograms of words over hash buckets: the bucket where the budget runs out is
found and only that bucket is refined, level by level.  A smaller budget always takes a
subset of what a larger one takes, as one hash decides.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.scratch import staged

#: Hash bits resolved by each histogram, and the number of histograms.
LEVEL_BITS, LEVELS = 12, 4
#: Weights dealt to sources in code-point order, and the most copies of a document.
WEIGHTS, MAX_COPIES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of the id's MD5; of the text's where there is no id."""
    named = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("long")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (its source's), taken, source.

    ``size`` is the number of words (null text: 0).  Null sources form one source, last in
    order.  Targets share all words by weight and stop at MAX_COPIES times a source's size;
    the excess goes to the others by weight.  ``taken`` is a multiple of ``size``.  Equal ids
    hash alike, so repeated rows are taken alike; rows without an id are told apart by their
    texts.  A source without words takes nothing; an empty table gives an empty result.
    Other columns of ``df`` are ignored.
    """
    sizes = _sizes(df, id_col, text_col, source_col)
    plan = _plan(sizes)
    joined = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left")
    taken = (F.col("d.size") * _copies(F.col("d.hash"))).cast("long").alias("taken")
    return joined.select("d.doc_id", "d.size", "p.source_size", "p.target", taken, "d.source")


def mix_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: every row of ``df``, with all its columns, as often as the mix takes it.

    Takes what ``mix_sources`` tells, for the same input.  Rows without words are in no mix.  The
    thresholds, one row per source, are joined by source; documents are not shuffled for it as
    long as Spark finds that table small enough to broadcast.
    """
    plan = _plan(_sizes(df, id_col, text_col, source_col)).alias("p")
    own = lambda name: F.col(f"d.`{name}`")
    copies = F.when(own(text_col).rlike(WORD), _copies(document_hash(own(id_col), own(text_col)))).otherwise(0)
    repeat = next(name for n in count() if (name := f"repeat{n}") not in df.columns)
    rows = df.alias("d").join(plan, own(source_col).cast("string").eqNullSafe(F.col("p.source")))
    repeated = rows.select(*(own(c) for c in df.columns), F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(repeat))
    return repeated.drop(repeat)


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, hash of every row."""
    return staged(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            document_hash(F.col(id_col), F.col(text_col)).alias("hash"),
        ),
        "sizes",
    )


def _plan(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, copies, threshold: one row per source."""
    return staged(_with_thresholds(sizes, source_targets(sizes)), "mixplan")


def _copies(document: Column) -> Column:
    """How often the plan ``p`` takes a document with that hash."""
    return F.col("p.copies") + F.when(document < F.col("p.threshold"), 1).otherwise(0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source.

    Filling by weight up to the caps: in order of cap/weight, a source is capped if its cap
    is at most its share of what the sources before it leave over.  The windows run over the
    table of sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")
    )
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * MAX_COPIES)
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(after)
    # The level rises while sources are capped and falls after the first uncapped one, whose level holds for all.
    filled = sources.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max("level").over(whole)
    return filled.withColumn("final", final).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("final") * F.col("weight"))
        .alias("target"),
    )


def _with_thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds copies (whole repeats of every document) and threshold (one more below it)."""
    empty = F.col("source_size") == 0
    state = targets.select(
        "*",
        F.when(empty, 0).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).alias("copies"),
    ).select(
        "*",
        F.when(empty, 0.0).otherwise(F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
    )
    for level in range(1, LEVELS + 1):
        state = staged(_refined(sizes, state, level), f"hist{level}")
    # The boundary bucket left over is one hash value: it is taken if that comes nearer to the budget.
    step = F.when(F.col("last") - 2 * (F.col("budget") - F.col("below")) < 0, 1).otherwise(0)
    return state.select("source", "source_size", "target", "copies", (F.col("prefix") + step).alias("threshold"))


def _refined(sizes: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One histogram inside each source's boundary bucket; the bucket where the budget ends."""
    done, left = LEVEL_BITS * (level - 1), LEVEL_BITS * (LEVELS - level)
    state = state.drop("last")
    inside = sizes.alias("d").join(
        state.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source"))
        & (F.shiftright("d.hash", LEVEL_BITS * LEVELS - done) == F.col("s.prefix")),
    )
    histogram = inside.groupBy("d.source", F.shiftright("d.hash", left).alias("bucket")).agg(
        F.sum("d.size").alias("words")
    )
    run = Window.partitionBy("source").orderBy("bucket")
    running = histogram.withColumn("to", F.sum("words").over(run)).alias("h")
    # The boundary is the first bucket whose words, with all below it, exceed the budget.
    boundary = (
        running.join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        .where(F.col("s.below") + F.col("h.to") > F.col("s.budget"))
        .groupBy(F.col("h.source").alias("source"))
        .agg(F.min_by(F.struct("h.bucket", (F.col("h.to") - F.col("h.words")).alias("under"), "h.words"), "h.bucket").alias("b"))
        .alias("b")
    )
    fields = [F.col(f"s.{c}") for c in ("source", "source_size", "target", "copies", "budget")]
    return state.alias("s").join(boundary, F.col("s.source").eqNullSafe(F.col("b.source")), "left").select(
        *fields,
        F.coalesce(F.col("b.b.bucket"), F.shiftleft("s.prefix", LEVEL_BITS)).alias("prefix"),
        (F.col("s.below") + F.coalesce(F.col("b.b.under"), F.lit(0))).alias("below"),
        F.coalesce(F.col("b.b.words"), F.lit(0)).alias("last"),
    )
