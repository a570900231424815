"""The operators of this subpackage bound to the synthetic tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    minhash_dedup,
    mixing,
    mtree,
    periodic_runs,
    sharding,
    substring_dedup,
    url_filter,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("places")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("score")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``documents`` with a periodic tail in a tenth of the texts, chosen and shaped by the crc32 of the id.

    Of such a text with n words each word from the a-th on repeats the words a to a + p.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.transform(F.array(words), planted)[0]  # so that the words are taken once
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.collapse_runs(docs).drop("n_words", "runs")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), lambda vec_id: vec_id % 50 == 0)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup,
        op2_shard,
        op3_decontaminate,
        op4_warc,
        op5_minhash_dedup,
        op6_exact_dedup,
        op7_language_id,
        op8_license_scan,
        op9_mix_sources,
        op10_url_filter,
        op11_periodic_runs,
        op12_hard_negatives,
        op13_exact_topk,
    )
    return {f.__name__: f for f in found}


_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

_OP6 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source
), levels AS (
  SELECT ((SELECT sum(source_size) FROM s)
          - (SELECT coalesce(sum(3 * b.source_size), 0) FROM s b WHERE b.source_size * a.w < a.source_size * b.w))::BIGINT::DOUBLE
         / (SELECT sum(b.w) FROM s b WHERE b.source_size * a.w >= a.source_size * b.w)::DOUBLE AS level
  FROM s a
), t AS (
  SELECT source, source_size,
         least((3 * source_size)::DOUBLE, (SELECT max(level) FROM levels) * w) AS target
  FROM s
), b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies FROM t
), r AS (
  SELECT d.*, b.source_size, b.target, b.copies,
         CASE WHEN b.source_size = 0 THEN 0 ELSE b.target - b.copies * b.source_size END AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto <= budget OR (upto - own <= budget AND own < 2 * (budget - (upto - own)))
                         THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


_OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS least FROM p
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM win WHERE least < doc_id)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS winner,
         translate(to_base(('0x' || substr(h, 1, 15))::BIGINT, 32, 12) || to_base(('0x' || substr(h, 16, 15))::BIGINT, 32, 12)
                   || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM q
"""


def _op8() -> str:
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    rows = [f"('{label}', TRUE, {text(key)}, {text(key)})" for label, key in license_scan.BASE_TEMPLATES]
    rows += [f"('{label}', FALSE, {text(key)}, {text(whole)})" for label, key, whole in license_scan.MORE_TEMPLATES]
    return _OP8.replace("TEMPLATES", ",\n  ".join(rows)).replace("MIN_SHARE", str(license_scan.MIN_SHARE))


_OP8 = r"""
WITH t(label, base, k, txt) AS (VALUES
  TEMPLATES
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), first AS (
  SELECT doc_id, x, i FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE x IN (SELECT k[1] FROM t)
), stands AS (
  SELECT doc_id, label, base, txt, w, i, i - (SELECT min(j) FROM unnest(range(1, len(txt) - len(k) + 2)) AS u(j) WHERE txt[j:j + len(k) - 1] = k) AS before
  FROM first JOIN d USING (doc_id) JOIN t ON x = k[1] AND w[i:i + len(k) - 1] = k
), place AS (
  SELECT doc_id, label, base, i - 1 AS start,
         len(list_filter(range(1, len(txt) + 1), lambda j: before + j >= 1 AND coalesce(w[greatest(before + j, 1)] = txt[j], FALSE))) / len(txt) AS share
  FROM stands
), kept AS (
  SELECT * FROM place WHERE share >= MIN_SHARE
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(share) AS score
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""


_OP11 = r"""
WITH t AS (
  SELECT doc_id, doc_id::VARCHAR AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT doc_id, w, len(w) AS n,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(8 * len(id)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(id, k // 8 + 1, 1))::BIGINT ELSE 0 END),
                         lambda x, byte: xor(xor(x, byte) >> 1, 3988292384 * (xor(x, byte) & 1))), 4294967295) AS h
  FROM t
), planted AS (
  SELECT doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c
), period AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planted
), d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM period
), word AS (
  SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d
), pair AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n
), part AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM part GROUP BY doc_id, q, island
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), best AS (
  SELECT doc_id, start, length, period FROM run
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_WHOLE = """
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

_OP12 = f"""
WITH e AS ({_WHOLE}), m AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM e WHERE label IS NOT NULL
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM m a JOIN m c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

_OP13 = f"""
WITH e AS ({_WHOLE}), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _OP1,
        "op3_decontaminate": _OP3,
        "op4_warc": _OP4,
        "op5_minhash_dedup": _OP5,
        "op6_exact_dedup": _OP6,
        "op8_license_scan": _op8(),
        "op9_mix_sources": _OP9,
        "op11_periodic_runs": _OP11,
        "op12_hard_negatives": _OP12,
        "op13_exact_topk": _OP13,
    }
