"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rarebucket.llm import chat, graph_dedup, jaccard_join, langid, lm_score, media, mixing, nbsvm, packing, url_filter
from rarebucket.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed_words(table(spark, sf_dir, "documents"))
    return mixing.by_position(mix, "deal").select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op2_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return rows.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_score"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspected(media.media_column(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(chat.probe(spark))))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), added=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_graph_dedup": op2_graph_dedup,
    "op3_stupid_backoff": op3_stupid_backoff,
    "op4_webp": op4_webp,
    "op5_url_filter": op5_url_filter,
    "op6_chat": op6_chat,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nbsvm": op8_nbsvm,
    "op9_langid": op9_langid,
    "op10_packing": op10_packing,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS deal
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::BIGINT AS weight FROM s
), f AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(source_size) OVER o, 0)::BIGINT AS fullsize,
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS leftweight
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, 2 * source_size * leftweight <= weight * (1.5::DOUBLE * total - 2 * fullsize) AS over FROM f
), p AS (
  SELECT o.*, l.fullsize AS ff, l.leftweight AS ll
  FROM o LEFT JOIN (SELECT fullsize, leftweight FROM o WHERE NOT over ORDER BY source_size::DOUBLE / weight, rank LIMIT 1) l ON true
), t AS (
  SELECT source, source_size, rank,
         CASE WHEN over THEN 2.0::DOUBLE * source_size ELSE (1.5::DOUBLE * total - 2.0::DOUBLE * ff) * weight / ll END AS target
  FROM p
), c AS (
  SELECT doc_id, size, source_size, rank, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY deal, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)))::BIGINT AS taken,
         before / target AS u
  FROM c
)
SELECT doc_id, size, source_size, target, taken,
       round(CASE WHEN taken > 0 THEN
         CASE rank % 3
           WHEN 0 THEN 2 * u / (1.5 + sqrt(greatest(0, 2.25::DOUBLE - 2 * u)))
           WHEN 1 THEN 2 * u / (0.5 + sqrt(0.25::DOUBLE + 2 * u))
           ELSE CASE WHEN u * 1.15::DOUBLE < 0.7 THEN u * 1.15::DOUBLE
                ELSE 0.7 + 2 * (u * 1.15::DOUBLE - 0.7) / (1 + sqrt(1 + 2 * (1 / 0.3::DOUBLE) * (u * 1.15::DOUBLE - 0.7))) END
         END END, 6) AS position
FROM k
"""

SQL["op6_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS body,
         CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15
              ELSE 19 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) END AS marks
  FROM c
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       (3 + sum(body + marks))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op3_stupid_backoff"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (
  SELECT r, unnest(w) AS c, unnest(range(len(w))) AS pos FROM d
), g AS (
  SELECT r, pos, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM i WINDOW o AS (PARTITION BY r ORDER BY pos)
), f AS (
  SELECT *, count(*) OVER (PARTITION BY c) AS f1,
         CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) END AS f2,
         CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) END AS f3,
         count(*) OVER () AS total
  FROM g
), h AS (
  SELECT *, lag(f1) OVER o AS p1, lag(f2) OVER o AS p2 FROM f WINDOW o AS (PARTITION BY r ORDER BY pos)
), s AS (
  SELECT r, CASE WHEN f3 >= 2 THEN ln(f3 / p2)
                 WHEN f2 >= 2 THEN ln(f2 / p1) + CASE WHEN a IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
                 ELSE ln(f1 / total) + ln(0.4::DOUBLE) * (CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END) END AS v
  FROM h
), t AS (
  SELECT r, sum(v) AS v FROM s GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log_score, round(coalesce(v / len(w), 0), 6) AS mean_score FROM d LEFT JOIN t ON d.r = t.r
"""
