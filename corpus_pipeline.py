"""Corpus pipeline over ``documents``: five stages, each working on what the one before it kept."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import decontaminate, language_id, minhash_dedup, mixing, sharding
from pricewright.llm.scratch import bound_arrow_batches, staged

#: Near-duplicates: percent of the union that two shingle sets share at least.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a text or a letter in it; one that no profile can judge is kept."""
    bound_arrow_batches(spark, minhash_dedup.BATCH_BYTES)
    rows = docs.select("doc_id", "text", "lang")
    profiles = language_id.ranked_profiles(rows.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.identify_ranked(docs, profiles, names=("judged_language", "judged_score"), letters="judged_letters")
    return judged.where("judged_letters").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates, the one with the smallest id (null: largest).

    Rows are told apart by a number given once, so rows with one id, or with none, are judged each
    for itself.  Of rows with the smallest id the one with the smallest text hash stays.
    """
    row = next(c for c in _names("row_number") if c not in docs.columns)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = minhash_dedup.near_dedup(numbered, id_col=row, percent=NEAR_PERCENT).where(F.col("n_shingles") > 0)
    # Only ids are grouped and joined, and only of groups with several rows.
    member = judged.select(F.col("doc_id").alias("member"), F.col("component_id").alias("grp"))
    several = member.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select("grp")
    member = staged(member.join(several, "grp"), "members")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row)).alias("rank")
    ranked = staged(numbered.select(F.col(row).alias("member"), rank).join(member, "member"), "ranked")
    kept = ranked.groupBy("grp").agg(F.min("rank").alias("least"))
    dropped = ranked.join(kept, "grp").where(F.col("rank") != F.col("least")).select("member")
    return _without(numbered, F.col(row), dropped).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    The verdict hangs on the text alone, so it is carried over by the text's digest, never by the id.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    texts = docs.select(digest.alias("digest"), "text")
    dropped = decontaminate.decontaminate(texts, benchmark, id_col="digest").where("contaminated").select("doc_id")
    return _without(docs, digest, dropped)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights; every row by itself."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the corpus as shards of the target size; the result tells each row's shard."""
    return sharding.shard_documents(docs).drop("text")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_to_weights),
    ("sharding", shard),
]

#: SQL cannot express the trained language profiles and the physical shards.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"stage{n}")
    return docs


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key``, never null, is not in the one column of ``dropped``."""
    gone = next(c for c in _names("dropped") if c not in docs.columns)
    return docs.join(dropped.distinct().toDF(gone), key == F.col(gone), "left_anti")


def _names(stem: str) -> Iterator[str]:
    """Column names to choose from: ``stem``, then longer ones."""
    while True:
        yield stem
        stem += "_"
