"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, htmlpaths, kdtree, mixing, pieces, planes, preference, simhash, toxicity, units
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.nearest(table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = units.drop_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cut.select("doc_id", "text", F.size("removed").alias("n_removed"), spans.alias("removed_at"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preference.pairs_of(table(spark, sf_dir, "conversations"))
    return preference.formatted(chosen, rejected)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlpaths.extracted(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_BOUNDARIES = r"""regexp_replace(regexp_replace(replace(text, chr(1), chr(2)), '([.!?][ \t\r\n]+|\n)', '\1' || chr(1), 'g'), ' ([A-ZÀ-ÖØ-Þ])', ' ' || chr(1) || '\1', 'g')"""
_WORDS = r"regexp_extract_all(lower({0}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP5_SQL = rf"""
WITH parts AS (
  SELECT doc_id, unnest(string_split({_BOUNDARIES}, chr(1))) AS part, generate_subscripts(string_split({_BOUNDARIES}, chr(1)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, i, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, len({_WORDS.format("part")}) AS n
  FROM parts
), units AS (
  SELECT doc_id, s, s + length(part) AS e, sum(n) OVER d AS high, sum(n) OVER d - n AS low FROM placed WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), sized AS (
  SELECT doc_id, max(high) AS total, max(e) AS last FROM units GROUP BY doc_id
), reach AS (
  SELECT doc_id, s, low, min(low) OVER (PARTITION BY doc_id ORDER BY low RANGE BETWEEN {units.LEAST} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM units
), paragraphs AS (
  SELECT r.doc_id, r.s, r.low, coalesce(nxt, total) AS high FROM reach r JOIN sized USING (doc_id) WHERE coalesce(nxt, total) - r.low >= {units.LEAST}
  UNION
  SELECT u.doc_id, max(u.s), max(u.low), any_value(total) FROM units u JOIN sized USING (doc_id) WHERE low + {units.LEAST} <= total OR (total < {units.LEAST} AND low = 0) GROUP BY u.doc_id
), words AS (
  SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL
), keys AS (
  SELECT p.doc_id, p.s, u.e, array_to_string(w[low + 1 : p.high], ' ') AS k FROM paragraphs p JOIN words USING (doc_id) JOIN (SELECT doc_id, high, e FROM units) u ON u.doc_id = p.doc_id AND u.high = p.high
), first AS (
  SELECT k, min(doc_id) AS d FROM keys GROUP BY k HAVING count(*) > 1
), opened AS (
  SELECT f.k, d, min(s) AS s, arg_min(e, s) AS e FROM first f JOIN keys ON keys.k = f.k AND doc_id = d GROUP BY ALL
), gone AS (
  SELECT DISTINCT doc_id, keys.s, keys.e FROM keys JOIN opened o ON o.k = keys.k WHERE doc_id > d OR keys.s >= o.e
), met AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone
), islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM met
), spans AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island
), removed AS (
  SELECT doc_id, count(*) AS n, string_agg(s::BIGINT::VARCHAR || '-' || e::BIGINT::VARCHAR, ',' ORDER BY s) AS removed_at FROM spans GROUP BY doc_id
), left_over AS (
  SELECT p.doc_id, string_agg(part, '' ORDER BY i) AS kept FROM placed p LEFT JOIN spans g ON p.doc_id = g.doc_id AND p.s >= g.s AND p.s < g.e WHERE g.e IS NULL AND length(part) > 0 GROUP BY p.doc_id
)
SELECT d.doc_id, CASE WHEN n IS NULL THEN d.text ELSE coalesce(kept, '') END AS text, coalesce(n, 0)::INTEGER AS n_removed, coalesce(removed_at, '') AS removed_at
FROM documents d LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_sentencepiece, op2_toxicity, op3_exact_topk, op4_simhash_near_dedup, op5_substring_dedup, op6_stupid_backoff, op7_preference_format, op8_embedding_near_dedup, op9_html_consensus, op10_mixing, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": kdtree.SQL, "op5_substring_dedup": OP5_SQL, "op6_stupid_backoff": backoff.SQL, "op7_preference_format": preference.SQL}
