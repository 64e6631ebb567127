"""Queries of this folder, one per operator, over whole tables with production parameters; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import bpe, fingerprint, lines, mixing, neardup, quality, subtree, suffix, tokencount, topk
from linewright.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtree.word_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.read_pieces(tokenizer("piece_bpe_32k.model")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")
    place = F.col("position").asc_nulls_last()
    return mixed.repartitionByRange(place, "doc_id").sortWithinPartitions(place, "doc_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality")))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_near_duplicates, op3_bpe, op4_suffix_array, op5_suffix_tree, op6_line_dedup, op7_token_counts, op8_mixing, op9_fingerprints, op10_quality)}

OP1_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.no, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.no <> v.no
), r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '~') AS turn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 2.0::DOUBLE * sum(size) AS cap, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s
), rounds AS (
  SELECT 0 AS i, NULL::DOUBLE AS level, NULL::DOUBLE AS ws
  UNION ALL
  SELECT i + 1, 1.5 * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w WHERE weight * r.level / r.ws > cap), 0.0),
         (SELECT sum(weight) FROM w WHERE NOT coalesce(weight * r.level / r.ws > cap, false))
  FROM rounds r WHERE i < (SELECT count(*) + 1 FROM w) AND (i = 0 OR ws > 0)
), last AS (SELECT level, ws FROM rounds WHERE ws > 0 ORDER BY i DESC LIMIT 1
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, weight * level / ws) AS target, CASE place % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM w, last
), c AS (
  SELECT d.*, source_size, target, slope, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - before)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - before - source_size)) AS BIGINT) AS taken FROM c
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN before / target
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target)) - (1 - slope)) / (2 * slope) END, 9) END AS position
FROM k
"""

OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * k >= 85 * (u.n + v.n - k)
), r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)
), hit AS (SELECT doc_id, i FROM v JOIN (SELECT s, min(doc_id) AS first FROM v GROUP BY s) USING (s) WHERE doc_id > first
), gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""

ORACLE_SQL = {"op1_top_k": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op5_suffix_tree": OP5_SQL, "op8_mixing": OP8_SQL}
