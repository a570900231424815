"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.scratch import staged


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node in ``links`` (columns a, b).

    Each round takes the smallest label among neighbours and then the label's own label, so
    long chains shorten by half; rounds are written out, so lineage stays short.  Nothing is
    gathered but the number of changed labels.
    """
    pairs = links.where(F.col("a") != F.col("b"))
    both = staged(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        lower = staged(lower, "lower")
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        jumped = staged(
            lower.join(own, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("component"), F.col("component").alias("was")),
            "labels",
        )
        labels = jumped.select("node", "component")
        if not jumped.where(F.col("component") != F.col("was")).limit(1).count():
            return labels
