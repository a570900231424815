"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A frequent-items summary (Misra-Gries family, Spark's ``approx_top_k``) proposes the digests
that occur most.  An exact recount keeps those that are really frequent; their winners are
few by construction and are broadcast, so that hot groups are decided on the map side.
All other digests go through an ordinary shuffle, where no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.scratch import staged

#: Digests are dealt into so many independent summaries, so no task merges all of them.
SUMMARIES = 64
#: Proposals taken from each summary, and counters that each one keeps.
PROPOSALS, COUNTERS = 128, 1024
#: A digest is hot if it holds at least this share of all rows.
HOT_SHARE = 1 / 4096


def normalised_text(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays (``kept``).  Null texts count
    as empty.  A null id is larger than any other: such a row stays only if all ids of its
    group are null.  Repeated rows with one id share a decision.  An empty table gives an
    empty result; other columns of ``df`` are ignored, whatever their names.
    """
    digests = staged(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(normalised_text(F.col(text_col)), 256)).alias("digest"),
        ).withColumn("short", F.xxhash64("digest")),
        "digests",
    )
    hot = _hot_groups(digests)
    marked = digests.join(F.broadcast(hot), "digest", "left")
    # Partial sums before the shuffle and a join of one row per digest: no task holds a whole group.
    plain = marked.where(F.col("group_size").isNull()).select("doc_id", "digest")
    groups = plain.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = plain.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    decided = marked.where(F.col("group_size").isNotNull()).select(*rest.columns)
    return decided.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _hot_groups(digests: DataFrame) -> DataFrame:
    """Exact size and winner of each hot digest: at most SUMMARIES * PROPOSALS rows."""
    proposed = (
        digests.groupBy(F.pmod("short", F.lit(SUMMARIES)).alias("summary"))
        .agg(F.expr(f"approx_top_k(short, {PROPOSALS}, {COUNTERS})").alias("top"))
        .select(F.explode("top").alias("top"))
        .select(F.col("top.item").alias("short"))
        .distinct()
    )
    rows = digests.count()
    return (
        digests.join(F.broadcast(proposed), "short", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where((F.col("group_size") > 1) & (F.col("group_size") >= rows * HOT_SHARE))
    )
