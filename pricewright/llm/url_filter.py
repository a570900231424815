"""URL filter: gradient-boosted trees on lexical features, below an explicit rule list.

URLs that a rule decides are the labelled ones.  Suffix statistics are counted over all URLs; a
labelled URL that the trees learn from gets its suffix's rate from the other folds, so that it
never meets its own label as a feature.  The trees are fitted on a bounded sample of the URLs of
either label and judge the URLs without a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.scratch import staged

#: Most distinct labelled URLs that the trees are fitted on: half of each verdict, more if the other
#: has fewer; of more, those with the smallest URL hashes.
MAX_TRAINING_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Folds of labelled URLs, by URL hash.
FOLDS = 5
#: Fixed values.  Rules of the query: host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy",
    "parameters", "hyphens", "suffix_share", "suffix_block_rate",
)


def with_parts(df: DataFrame, url: Column) -> DataFrame:
    """Adds host and path, both empty where the URL is null or has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, parts, n), F.lit(""))
    return df.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def with_rule(df: DataFrame, rules: tuple) -> DataFrame:
    """Adds rule and rule_verdict: of the rules that fit host and path the longest, else null."""
    none = F.lit(None).cast("string")
    fitting = [
        (
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            host + path,
            verdict,
        )
        for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    pick = lambda i: reduce(lambda out, r: F.when(r[0], F.lit(r[i])).otherwise(out), reversed(fitting), none)
    return df.withColumn("rule", pick(1)).withColumn("rule_verdict", pick(2))


def with_lexical_features(df: DataFrame, url: Column) -> DataFrame:
    """Adds the features that need nothing but the URL, and its suffix (the host's last label)."""
    text = F.coalesce(url, F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    letters = F.split(text, "")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return (
        df.withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("url_length", F.length(text).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", F.regexp_count("path", F.lit("/[^/]")).cast("double"))
        .withColumn("labels", F.regexp_count("host", F.lit(r"[^.]+")).cast("double"))
        .withColumn("digit_ratio", count("[0-9]") / length)
        .withColumn("entropy", F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))
        .withColumn("parameters", count("[?&][^=&#]+="))
        .withColumn("hyphens", count("[-_%]"))
    )


def fold_of(url: Column) -> Column:
    """Fold of a URL, equal URLs in one."""
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def suffix_statistics(df: DataFrame) -> DataFrame:
    """Of every suffix its share of all URLs, and the smoothed rates of blocked among labelled URLs:
    of all (suffix_block_rate), and of all but each fold (other_folds)."""
    total, fold = df.count(), fold_of(F.col("url"))
    rate = lambda among: (F.count_if(among & (F.col("label") == 1)) + 1.0) / (F.count_if(among & F.col("label").isNotNull()) + 2.0)
    return df.groupBy("suffix").agg(
        (F.count(F.lit(1)) / F.lit(max(total, 1))).alias("suffix_share"),
        rate(F.lit(True)).alias("suffix_block_rate"),
        F.array(*(rate(fold != k) for k in range(FOLDS))).alias("other_folds"),
    )


def with_suffix_statistics(df: DataFrame, statistics: DataFrame, learning: bool = False) -> DataFrame:
    """Adds suffix_share and suffix_block_rate, for rows to learn from the rate outside their fold.

    A suffix without statistics has share 0 and rate 0.5.
    """
    rate = F.element_at("other_folds", fold_of(F.col("url")) + 1) if learning else F.col("suffix_block_rate")
    chosen = statistics.select("suffix", "other_folds", "suffix_block_rate", F.col("suffix_share").alias("share"))
    joined = df.join(chosen, "suffix", "left").withColumn("rate", rate)
    return joined.select(*df.columns, F.coalesce("share", F.lit(0.0)).alias("suffix_share"), F.coalesce("rate", F.lit(0.5)).alias("suffix_block_rate"))


def fit_url_trees(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> GBTClassificationModel | None:
    """Trees for rows with FEATURES and label (1 block, 0 allow); None without both labels.

    At most ``max_rows`` distinct URLs are used: up to half of each label, and what one label
    leaves over goes to the other.  That sample is one partition, so that fits repeat.  Both
    labels get equal weight.
    """
    order = [F.xxhash64("url"), F.col("url"), *map(F.col, FEATURES)]
    distinct = labelled.select("label", "url", *FEATURES).distinct()
    first = [distinct.where(F.col("label") == label).orderBy(*order).limit(max_rows) for label in (0, 1)]
    sample = staged(first[0].unionByName(first[1]), "urlfirst")
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(found) < 2:
        return None
    half = max(1, max_rows // 2)
    sizes = {label: min(found[label], max(half, max_rows - found[1 - label])) for label in (0, 1)}
    parts = [sample.where(F.col("label") == label).orderBy(*order).limit(sizes[label]) for label in (0, 1)]
    sample = parts[0].unionByName(parts[1]).orderBy(*order, "label").select("label", *FEATURES).coalesce(1)
    sample = staged(sample, "urlsample").coalesce(1)
    weight = F.when(F.col("label") == 1, 1.0 / sizes[1]).otherwise(1.0 / sizes[0]) * sum(sizes.values()) / 2
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).withColumn("weight", weight)
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, maxBins=32, seed=7, weightCol="weight")
    return trees.fit(rows.withColumn("label", F.col("label").cast("double")))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per input row.

    ``verdict`` is the rule's where one fits, else the trees' (block if ``score``, their
    probability of block, is over 0.5).  Without labelled URLs of both verdicts there are no
    trees: such URLs get the only label known, or allow, with score 0 or 1.  Null URLs have
    empty parts and are judged like others; repeated rows give a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    url = F.col("url")
    rows = with_rule(with_parts(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), url), rules)
    rows = with_lexical_features(rows, url).withColumn(
        "label", F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "block").cast("int"))
    )
    rows = staged(rows, "urls")
    statistics = staged(suffix_statistics(rows), "suffixes")
    model = fit_url_trees(with_suffix_statistics(rows.where(F.col("label").isNotNull()), statistics, learning=True))
    rows = with_suffix_statistics(rows, statistics)
    if model is None:
        only = rows.agg(F.max("label")).first()[0]
        scored = rows.withColumn("score", F.lit(float(only or 0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
