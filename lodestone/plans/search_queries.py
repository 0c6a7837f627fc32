"""Queries over documents, benchmark and embeddings: retrieval, fusion, evidence, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import dedup, evidence, retrieval
from .registry import query, table

TERMS = r"regexp_extract_all(lower({0}), '\p{{L}}{{2,}}')"
BM25 = rf"""
toks AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT doc_id, len({TERMS.format('text')}) AS dl FROM documents),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
qs AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, p.doc_id AS id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qs JOIN post p USING (term) JOIN dfs USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN stat GROUP BY ALL),
bm_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""
KNN = """
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings),
kn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, qv),
kn_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kn)"""
#: two ranked lists for each source, to fuse: documents by length and by id
LISTS = """
both_lists AS (
  SELECT source AS query_id, 'length' AS method, doc_id AS id, n_chars::DOUBLE AS score FROM documents
  UNION ALL SELECT source, 'recent', doc_id, (doc_id % 101)::DOUBLE FROM documents),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, id) AS rank FROM both_lists) WHERE rank <= 20)"""


def _queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _lists(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    one = lambda m, s: d.select(F.col("source").alias("query_id"), F.lit(m).alias("method"), F.col("doc_id").alias("id"), s.cast("double").alias("score"))
    w = Window.partitionBy("query_id", "method").orderBy(F.desc("score"), "id")
    return one("length", F.col("n_chars")).unionByName(one("recent", F.col("doc_id") % 101)).withColumn("rank", F.row_number().over(w)).where("rank <= 20")


@query(f"WITH {BM25} SELECT query_id, id, score, rank::INTEGER AS rank FROM bm_top WHERE rank <= 10")
def bm25_batch(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10)


@query(f"WITH {BM25} SELECT id, score, rank::INTEGER AS rank, concat_ws(' | ', source, 'Section: ' || lang) AS citation FROM bm_top JOIN documents d ON d.doc_id = id WHERE rank <= 10 AND query_id = (SELECT min(item_id) FROM benchmark)")
def bm25_topk(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    first = q.groupBy().agg(F.min_by("query", "query_id").alias("query"), F.min("query_id").alias("query_id"))
    top = retrieval.bm25(docs, first, 10)
    told = docs.select(F.col("doc_id").alias("id"), tx.citation(F.col("source"), F.col("lang"), F.lit(None)).alias("citation"))
    return told.join(F.broadcast(top), "id").select("id", "score", "rank", "citation")  # ten rows


@query(f"WITH {KNN} SELECT query_id, id, score, rank::INTEGER AS rank FROM kn_top WHERE rank <= 10")
def knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.dense(v.select("id", "v"), v.select(F.col("id").alias("query_id"), "v"), 10)


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.groupBy().agg(F.min_by("v", "id").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("id", F.round(vx.cosine(F.col("v"), F.col("q")), 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)  # one query row


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.35")
def similar_pairs(spark, sf_dir):
    return dedup.similar_pairs(_vectors(spark, sf_dir).select("id", "v"), 0.35)


@query(f"WITH {LISTS}, f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*)::INTEGER AS methods FROM lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 10")
def rrf_fuse(spark, sf_dir):
    return retrieval.reciprocal_rank(_lists(spark, sf_dir), k=10)


@query(f"""WITH {LISTS}, s AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM lists WINDOW w AS (PARTITION BY query_id, method)),
  f AS (SELECT query_id, id, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END * CASE method WHEN 'length' THEN 0.6 ELSE 0.4 END), 9) AS score FROM s GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 10""")
def linear_fuse(spark, sf_dir):
    return retrieval.linear_fusion(_lists(spark, sf_dir), {"length": 0.6, "recent": 0.4}, 10)


@query(f"WITH {LISTS}, f AS (SELECT query_id, id, (-(sum(rank) + (2 - count(*)) * 21))::DOUBLE AS score FROM lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 10")
def ranksum_fuse(spark, sf_dir):
    return retrieval.rank_sum(_lists(spark, sf_dir), 2, 20, 10)


@query(f"""WITH {LISTS}, a AS (SELECT query_id, list(DISTINCT id) AS ids FROM lists WHERE method = 'length' GROUP BY 1), b AS (SELECT query_id, list(DISTINCT id) AS ids FROM lists WHERE method = 'recent' GROUP BY 1)
  SELECT query_id, 'length' AS a, 'recent' AS b, len(list_intersect(a.ids, b.ids))::INTEGER AS shared, (len(a.ids) + len(b.ids) - len(list_intersect(a.ids, b.ids)))::INTEGER AS either,
  round(len(list_intersect(a.ids, b.ids))::DOUBLE / (len(a.ids) + len(b.ids) - len(list_intersect(a.ids, b.ids))), 9) AS jaccard, round(len(list_intersect(a.ids, b.ids))::DOUBLE / least(len(a.ids), len(b.ids)), 9) AS overlap_ratio FROM a JOIN b USING (query_id)""")
def overlap_analysis(spark, sf_dir):
    return retrieval.overlap(_lists(spark, sf_dir))


@query(f"WITH {LISTS} SELECT query_id, method, count(*) AS n, round(avg(score), 9) AS mean FROM lists GROUP BY ALL")
def fusion_stats(spark, sf_dir):
    return _lists(spark, sf_dir).groupBy("query_id", "method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


@query(f"""WITH {BM25}, v AS (SELECT query_id, count(*) AS n, var_pop(CASE WHEN rank BETWEEN 6 AND 10 THEN score END) AS var FROM bm_top WHERE rank <= 40 GROUP BY 1)
  SELECT item_id AS query_id, least(10 + CASE WHEN c THEN 10 ELSE 0 END + CASE WHEN t THEN 10 ELSE 0 END, 20)::INTEGER AS k, c AS compares, t AS flat_tail
  FROM (SELECT item_id, coalesce(n, 0) >= 10 AND coalesce(var, 1) < 0.01 AS t, regexp_matches(lower(text), 'compar|differen|versus|vs|both|either|contrast|similarities|distinction|between') AND (contains(lower(text), 'compare') OR contains(lower(text), 'comparison') OR contains(lower(text), 'difference') OR contains(lower(text), 'vs')
    OR contains(lower(text), 'versus') OR contains(lower(text), 'both') OR contains(lower(text), 'either') OR contains(lower(text), 'contrast') OR contains(lower(text), 'similarities') OR contains(lower(text), 'distinction') OR contains(lower(text), 'between')) AS c FROM benchmark LEFT JOIN v ON item_id = query_id)""")
def auto_k(spark, sf_dir):
    q = _queries(spark, sf_dir)
    return retrieval.adaptive_k(retrieval.bm25(table(spark, sf_dir, "documents"), q, 40), q, 10)


@query()
def prf_terms(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    found = retrieval.with_rows(docs.select(F.col("doc_id").alias("id"), "text"), retrieval.bm25(docs, q, 5))
    return retrieval.expansion_terms(found, q, lambda c: vx.hashed_terms(F.regexp_extract_all(F.lower(c), F.lit(".{2}"), 0), 64))


@query()
def diversity_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    top = retrieval.dense(v.select("id", "v"), v.select(F.col("id").alias("query_id"), "v"), 20)
    return retrieval.diverse(top.join(v.select("id", "v"), "id"), 0.3)


@query()
def hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("section"))
    return retrieval.hybrid(docs, _queries(spark, sf_dir), 10)


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def snapshot_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS x FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS y FROM documents WHERE doc_id % 10 <> 4)
  SELECT doc_id, CASE WHEN x IS NULL THEN 'missing_in_a' WHEN y IS NULL THEN 'missing_in_b' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE x IS NULL OR y IS NULL OR x <> y""")
def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 10 <> 4").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return retrieval.hash_diff(a, b)


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1'))")
def cache_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return retrieval.cache_misses(d, d.where(F.col("source").isin("src0", "src1")).select(F.sha2("text", 256).alias("hash")).distinct()).select("hash")


@query("WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source IN ('src0', 'src1')) SELECT count(*) AS n, count_if(sha256(text) IN (SELECT h FROM c)) AS hits, round(count_if(sha256(text) IN (SELECT h FROM c))::DOUBLE / count(*), 9) AS rate FROM documents")
def cache_hit_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("hash"))
    known = d.where(F.col("source").isin("src0", "src1")).select("hash").distinct().withColumn("hit", F.lit(1))
    return d.join(known, "hash", "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 9).alias("rate"))


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '\p{{L}}{{3,}}'))"
_SENT = r"string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))"
_OVER = "CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0 END"


@query(rf"""WITH s AS (SELECT doc_id, text, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) - 1 AS pos FROM documents),
  p AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS cur FROM s),
  q AS (SELECT doc_id, sentence, {_WORDS.format("sentence")} AS ws, CASE WHEN instr(substr(text, cur + 1), sentence) > 0 THEN cur + instr(substr(text, cur + 1), sentence) - 1 ELSE cur END AS start FROM p WHERE length(trim(sentence)) >= 20),
  b AS (SELECT item_id, {_WORDS.format("text")} AS cs FROM benchmark),
  x AS (SELECT item_id AS claim_id, doc_id, start, sentence, round({_OVER.format(a="cs", b="ws")}, 9) AS confidence FROM q, b),
  r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY confidence DESC, start) AS rank FROM x WHERE confidence > 0.6)
  SELECT claim_id, doc_id AS id, start::INTEGER AS start, (start + length(sentence))::INTEGER AS "end", sentence AS text, confidence, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def cited_spans(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return evidence.cited_everywhere(claims, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_SPANS = "spans AS (SELECT user_id AS id, (floor(epoch(ts))::BIGINT % 100000)::INTEGER AS start, (floor(epoch(ts))::BIGINT % 100000 + 5 + event_id % 900)::INTEGER AS \"end\", event_type AS text, round(value, 3) AS confidence, event_id FROM events)"


@query(f"""WITH {_SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT id, min(start) AS start, max("end") AS "end", max(confidence) AS confidence FROM i GROUP BY id, island""")
def merge_spans(spark, sf_dir):
    at = F.unix_timestamp("ts") % 100000
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), at.cast("int").alias("start"), (at + 5 + F.col("event_id") % 900).cast("int").alias("end"), F.col("event_type").alias("text"), F.round("value", 3).alias("confidence"))
    return evidence.merge_spans(spans).drop("text")


@query()
def claims_extract(spark, sf_dir):
    return evidence.claims(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), "text"))


@query(rf"""WITH o AS (SELECT item_id AS claim_id, doc_id AS id, {_OVER.format(a=_WORDS.format("b.text"), b=_WORDS.format("d.text"))} AS w FROM benchmark b, documents d),
  s AS (SELECT *, round(0.35 * w + 0.45 * w, 9) AS sure FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY (w >= 0.3 OR sure >= 0.6) DESC, sure DESC, id) AS rank FROM s)
  SELECT claim_id, coalesce(max(CASE WHEN w >= 0.3 OR sure >= 0.6 THEN sure END) >= 0.6, false) AS is_verified, coalesce(max(CASE WHEN w >= 0.3 OR sure >= 0.6 THEN sure END), 0.0) AS best,
  coalesce(string_agg(CASE WHEN w >= 0.3 OR sure >= 0.6 THEN id::VARCHAR END, ',' ORDER BY rank), '') AS citations, CASE WHEN bool_or(rank = 1 AND (w >= 0.3 OR sure >= 0.6)) THEN 'lexical' ELSE 'none' END AS method FROM r WHERE rank <= 3 GROUP BY claim_id""")
def claim_verify(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.lower("text").alias("claim"), F.lit("factual_pattern").alias("kind"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return evidence.verified_everywhere(claims, docs)


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query(r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}0-9_ \t\r\n]', '', 'g'), '[ \t\r\n]+', ' ', 'g'))")
def lexical_dedup(spark, sf_dir):
    return dedup.lexical_first(table(spark, sf_dir, "documents")).select("doc_id")


@query()
def semantic_dedup(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("label", "id", F.col("id").alias("pos"), "v")
    return dedup.leader_clusters(v, 0.3, ("label",))


@query("""WITH s AS (SELECT d.doc_id, source, round(5 * quality + CASE WHEN toxic = 1 THEN 0 ELSE 2 END + CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END + least(length(text) / 500.0::DOUBLE, 1.0) + CASE WHEN lang <> 'en' THEN 0.5 ELSE 0 END, 9) AS score FROM documents d JOIN labels USING (doc_id))
  SELECT source, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s) WHERE n = 1""")
def representative(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("focus", F.when(F.col("lang") == "en", "general").otherwise(F.col("lang")))
    score = dedup.representative_score(F.col("quality"), F.col("toxic") == 1, (F.col("n_chars") > 1000).cast("int"), F.col("text"), F.col("focus"))
    return dedup.representatives(rows, "source", score, "doc_id").select("source", "doc_id", "score")


@query(r"""SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL
  UNION ALL SELECT 'distinct', 'text', count(DISTINCT trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}0-9_ \t\r\n]', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) FROM documents""")
def diversity_report(spark, sf_dir):
    return dedup.diversity(table(spark, sf_dir, "documents"), "text", "lang", "source")


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS kept, count_if(n > 1) AS clusters, round((sum(n) - count(*))::DOUBLE / sum(n), 9) AS rate, round(avg(CASE WHEN n > 1 THEN n END), 9) AS mean_size FROM g""")
def dedup_stats(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("kept"), F.count_if(F.col("n") > 1).alias("clusters"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 9).alias("rate"), F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 9).alias("mean_size"))
