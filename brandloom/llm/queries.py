"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brandloom.llm import attention_lm, centroids, divergence, exact_dedup, mixing, near_dup, packing, pieces, quality, resampling, substring_dedup, templates, token_files
from brandloom.llm.common import new_folder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), PIECES)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_tokens(spark, folder)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scores(table(spark, sf_dir, "documents"), PIECES)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1,
    "op2_html_templates": op2,
    "op3_sentencepiece": op3,
    "op4_token_files": op4,
    "op5_divergence": op5,
    "op6_ngram_jaccard": op6,
    "op7_mixing": op7,
    "op8_attention_lm": op8,
    "op9_quality_classifier": op9,
    "op10_exact_dedup": op10,
    "op11_packing": op11,
    "op12_centroids": op12,
    "op13_resampling": op13,
    "pipeline": pipeline,
}

# Centroids of each round as rows (c, m, x): cluster, component, value; vectors as rows (r, m, x).
_ROUND = """
a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, z.c, sum((v.x - z.x) * (v.x - z.x)) AS d FROM v JOIN z{k} z USING (m) GROUP BY v.r, z.c) GROUP BY r)"""
_MOVE = """,
z{n} AS MATERIALIZED (SELECT z.c, z.m, coalesce(s.x, z.x) AS x FROM z{k} z LEFT JOIN
  (SELECT a.c, v.m, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{k} a USING (r) GROUP BY a.c, v.m) s
  ON s.c = z.c AND s.m = z.m),"""
CENTROIDS_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, m, CAST(floor(1024 * CAST(embedding[m] AS DOUBLE)) AS BIGINT) AS x FROM e, range(1, 65) t(m)),
f AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) - 1 AS c
  FROM e QUALIFY c < 8),
z0 AS MATERIALIZED (SELECT f.c, v.m, v.x FROM f JOIN v USING (r)),""" + "".join(_ROUND.format(k=k) + (_MOVE.format(k=k, n=k + 1) if k < 10 else "") for k in range(11)) + """,
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY m)) AS centroid_sha256 FROM z10 GROUP BY c)
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM e JOIN a10 a USING (r) JOIN h ON h.c = a.c"""

ORACLES: dict[str, str] = {
    "op12_centroids": CENTROIDS_SQL,
    "op7_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM s),
f AS (  -- full sources come first by room for each unit of weight
  SELECT *, 2.0 * source_size / weight AS level,
         sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 2.0 * source_size AS full_before,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS weight_left
  FROM w),
l AS (SELECT arg_min((1.5 * (SELECT sum(source_size) FROM s) - full_before) / weight_left, full_before) AS level FROM f
      WHERE (1.5 * (SELECT sum(source_size) FROM s) - full_before) / weight_left <= level),
t AS (SELECT f.source, f.source_size, least(2.0 * f.source_size, f.weight * l.level)::DOUBLE AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
r AS (SELECT h.source, h.h, h.n, sum(h.n) OVER (PARTITION BY h.source ORDER BY h.h) AS upto, p.target - p.whole * p.source_size AS budget
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
c AS (SELECT source, min(h) AS low, arg_min(upto - budget < budget - upto + n, h) AS over_is_nearer FROM r WHERE upto > budget GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN d.h < c.low OR (d.h = c.low AND c.over_is_nearer) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
