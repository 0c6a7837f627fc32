"""Lexical and dense retrieval over batches of queries, rank fusion, expansion, adaptive k, diversity.

A batch of queries is a table; nothing loops over queries on the driver. Ranked lists are
(query_id, id, score, rank) with rank from 1 and ties broken by id.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import saved
from ..functions import text as tx
from ..functions import vectors as vx
from . import blocks, lexical

K1, B, RRF = lexical.K1, lexical.B, 60
BROADCAST_TERMS = 1_000_000
COMPARISONS = ("compare", "comparison", "difference", "differences", "versus", "vs", "vs.", "both", "either", "contrast", "similarities", "distinction", "between")
STOPWORDS = "the is at which on are was were been be have has had do does did will would should could may might must can this that these those what when where who why how".split()


def ranked(scored: DataFrame, k: int | None = None, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def postings(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, term, tf, dl): one row for each distinct term of a document; dl counts all its terms."""
    return _counted(_exploded(docs, id_column))


def _exploded(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), tx.terms(F.col("text")).alias("ts")).select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))


def _counted(terms: DataFrame) -> DataFrame:
    return terms.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, avgdl) over all documents, also those without a term."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tx.terms(F.col("text")))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id") -> DataFrame:
    """Top k documents for each query (query_id, query) by BM25; repeated query terms count each time.

    Each task scores its documents for all queries and sends on the k best of each. Batches of more than a million
    terms are taken in parts, each with a scan of its own.
    """
    wanted, rows = query_terms(queries), lexical.texts(docs, id_column)
    parts = max(1, math.ceil(wanted.count() / BROADCAST_TERMS))
    own = lambda i: wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else wanted
    return ranked(functools.reduce(DataFrame.unionByName, [lexical.top(rows, own(i), k) for i in range(parts)]), k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query), written out once, as every step reads it."""
    return saved(queries.select("query_id", F.explode(tx.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))


def _of_batch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose term the batch has; the terms are broadcast below a million, else joined."""
    own = wanted.select("term").distinct()
    return rows.join(F.broadcast(own) if own.count() < BROADCAST_TERMS else own, "term", "left_semi")


def bm25_indexed(postings_: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """bm25() from a saved index: postings (id, term, tf, dl) and one row of statistics (n, avgdl)."""
    wanted = query_terms(queries)
    return score_postings(_of_batch(postings_, wanted), stats, wanted, k)


def terms_with_idf(postings_: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of an index."""
    df = postings_.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    return df.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def score_postings(p: DataFrame, stats: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, id, score, rank) of postings (id, term, tf, dl); weights and saturations are computed before
    the rows of the two sides multiply."""
    one = F.broadcast(stats)
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").crossJoin(one).select("query_id", "term", (F.col("qtf") * idf).alias("w"))
    asked = F.broadcast(asked) if wanted.count() < BROADCAST_TERMS else asked  # no more rows than the batch has terms
    held = p.crossJoin(one).select("id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("s"))
    scored = held.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("s")).alias("score"))
    return ranked(scored.withColumn("score", F.round("score", 9)), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top k of vectors (id, v) for each query (query_id, v) by cosine: an exact scan in blocks, k rows a query leaving each."""
    return ranked(blocks.top(vectors, queries, k), k)


def few(found: DataFrame) -> DataFrame:
    """A saved table of at most a million rows, to be broadcast, as hits of a batch of queries are; a larger one as it is."""
    return F.broadcast(found) if found.count() < BROADCAST_TERMS else found


def with_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found (id, ..) with the columns of rows (id, ..), of which only those found are moved."""
    return rows.join(few(saved(found)), "id")


def _hits(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks that were found, written out, so that what follows doesn't read all."""
    return saved(chunks.join(few(saved(found.select("id").distinct())), "id", "left_semi"))


def reciprocal_rank(lists: DataFrame, constant: int = RRF, k: int | None = None) -> DataFrame:
    """Fuse lists (query_id, method, id, rank) by the sum of 1 / (constant + rank)."""
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.count("*").cast("int").alias("methods"))
    return ranked(fused, k)


def linear_fusion(lists: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """Weighted sum of scores scaled to [0, 1] within each query and method; a constant list counts as 1."""
    w = Window.partitionBy("query_id", "method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(x)) for m, x in weights.items()], F.lit(0.0))
    fused = lists.withColumn("part", scaled * weight).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(fused, k)


def rank_sum(lists: DataFrame, methods: int, depth: int, k: int | None = None) -> DataFrame:
    """Sum of ranks, a missing rank counting depth + 1; the least sum is best, so the score is its negative."""
    fused = lists.groupBy("query_id", "id").agg((-(F.sum("rank") + (methods - F.count("*")) * (depth + 1))).cast("double").alias("score"))
    return ranked(fused, k)


def overlap(lists: DataFrame) -> DataFrame:
    """(query_id, a, b, shared, either, jaccard, overlap_ratio) for each pair of methods with a result."""
    sets = lists.groupBy("query_id", "method").agg(F.collect_set("id").alias("ids"))
    left, right = (sets.select("query_id", F.col("method").alias(m), F.col("ids").alias(f"{m}_ids")) for m in "ab")
    both = left.join(right, "query_id").where("a < b")
    shared, either = F.size(F.array_intersect("a_ids", "b_ids")), F.size(F.array_union("a_ids", "b_ids"))
    return both.select("query_id", "a", "b", shared.alias("shared"), either.alias("either"), F.round(shared / either, 9).alias("jaccard"), F.round(shared / F.least(F.size("a_ids"), F.size("b_ids")), 9).alias("overlap_ratio"))


def is_comparison(query: Column) -> Column:
    """Whether a comparison word occurs anywhere in the query, also within a word."""
    found, low = F.lit(False), F.lower(query)
    for word in COMPARISONS:
        found = found | low.contains(word)
    return found


def adaptive_k(fused: DataFrame, queries: DataFrame, k: int, increment: int = 10, most: float = 2.0, flat: float = 0.01) -> DataFrame:
    """(query_id, k, compares, flat_tail): k, raised for comparisons and for a flat tail of scores up to rank k."""
    stats = fused.groupBy("query_id").agg(F.count("*").alias("n"), F.var_pop(F.when(F.col("rank").between(k - 4, k), F.col("score"))).alias("var"))
    both = queries.join(stats, "query_id", "left")
    tail = (F.coalesce("n", F.lit(0)) >= k) & F.lit(k >= 5) & (F.coalesce("var", F.lit(1.0)) < flat)
    compares = is_comparison(F.col("query"))
    grown = F.lit(k) + F.when(compares, increment).otherwise(0) + F.when(tail, increment).otherwise(0)
    return both.select("query_id", F.least(grown, F.lit(int(most * k))).alias("k"), compares.alias("compares"), tail.alias("flat_tail"))


def expansion_terms(found: DataFrame, queries: DataFrame, encode, top: int = 3, count: int = 2, least: int = 4) -> DataFrame:
    """(query_id, term, score): the `count` terms of each query's top chunks closest to the query.

    found is (query_id, text, rank); encode maps a text column to a vector column.
    """
    words = F.split(F.regexp_replace(F.lower("text"), "[,.:]", " "), tx.BLANKS)
    terms = found.where(F.col("rank") <= top).select("query_id", F.explode(words).alias("term")).where((F.length("term") >= least) & F.col("term").rlike("^\\p{L}+$") & ~F.col("term").isin(STOPWORDS)).distinct()
    own = queries.select("query_id", F.explode(F.split(F.lower("query"), tx.BLANKS)).alias("term"))
    fresh = terms.join(own, ["query_id", "term"], "left_anti")
    scored = fresh.join(queries.select("query_id", encode(F.col("query")).alias("q")), "query_id").select("query_id", "term", F.round(vx.cosine(encode(F.col("term")), F.col("q")), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries with the expansion terms appended in order of rank."""
    added = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("extra"))
    return queries.join(added, "query_id", "left").withColumn("query", F.concat_ws(" ", "query", "extra")).drop("extra")


def apart(vectors: np.ndarray, threshold: float) -> list[int]:
    """Rows kept by a greedy pass in order: a row goes if its cosine with any row kept before reaches the threshold."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    near, kept = unit @ unit.T >= threshold, []
    for i in range(len(unit)):
        if not near[i, kept].any():
            kept.append(i)
    return kept


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _apart(vectors: pa.Array, threshold: pa.Array) -> pa.Array:
    return pa.array([apart(own.values.flatten().to_numpy().astype(np.float64).reshape(len(own), -1), t) for own, t in zip(vectors, threshold.to_pylist())], pa.list_(pa.int32()))


def diverse(found: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rows of found (query_id, id, score, rank, v) kept by a greedy pass in rank order.

    A row goes if its cosine with any row kept before reaches the threshold. A query's candidates, a small multiple of
    its k, are passed in one Arrow batch with those of other queries.
    """
    if threshold >= 1.0:
        return found.drop("v")
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("bigint").alias("id"), F.col("score").cast("double").alias("score"), "v")))
    grouped = found.groupBy("query_id").agg(items.alias("xs")).withColumn("kept", _apart(F.transform("xs", lambda x: x["v"]), F.lit(threshold)))
    return grouped.select("query_id", "xs", F.explode("kept").alias("i")).select("query_id", F.get("xs", F.col("i")).alias("x")).select("query_id", "x.id", "x.score", "x.rank")


def rerank(candidates: DataFrame, cross: Column, bi: Column, weight: float = 0.7) -> DataFrame:
    """candidates (query_id, id, ..) ranked by weight * cross + (1 - weight) * bi."""
    return ranked(candidates.withColumn("score", F.round(weight * F.coalesce(cross, F.lit(0.0)) + (1 - weight) * F.coalesce(bi, F.lit(0.0)), 9)))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has: the built-in pair scorer."""
    q = F.array_distinct(tx.terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.terms(text))) / F.size(q)).otherwise(0.0)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.85, pair_score=lexical_overlap, encode=lambda c: vx.hashed_terms(tx.terms(c))) -> DataFrame:
    """(query_id, id, score, rank, citation): dense and lexical top 2k fused, made diverse, cut to k.

    chunks is (id, text, source[, section, page]); rank follows the fused score, and pair_score is reported beside it.
    """
    near = dense(chunks.select("id", encode(F.col("text")).alias("v")), queries.select("query_id", encode(F.col("query")).alias("v")), 2 * k).withColumn("method", F.lit("dense"))
    words = bm25(chunks.withColumnRenamed("id", "doc_id"), queries, 2 * k).withColumn("method", F.lit("sparse"))
    fused = saved(reciprocal_rank(near.unionByName(words), k=2 * k))
    hits = _hits(chunks, fused)
    kept = diverse(fused.join(hits.select("id", encode(F.col("text")).alias("v")), "id"), threshold)
    w = Window.partitionBy("query_id").orderBy("rank")
    cut = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    null = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    told = hits.select("id", "text", tx.citation(F.col("source"), null("section"), null("page")).alias("citation"))
    return cut.join(told, "id").join(queries, "query_id").select("query_id", "id", "score", "rank", "citation", F.round(pair_score(F.col("query"), F.col("text")), 9).alias("pair_score"))


def snapshot(docs: DataFrame, model: str) -> DataFrame:
    """One row (model, doc_count, doc_hashes): sha256 of every document's text by its id."""
    hashed = docs.select(F.col("doc_id").cast("string").alias("k"), F.coalesce(F.sha2("text", 256), F.lit("ERROR: unreadable")).alias("h"))
    return hashed.agg(F.lit(model).alias("model"), F.count("*").alias("doc_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "h")))).alias("doc_hashes"))


def hash_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, change) between two tables (doc_id, hash): missing_in_a, missing_in_b or changed; the unchanged are left out."""
    both = a.select("doc_id", F.col("hash").alias("x")).join(b.select("doc_id", F.col("hash").alias("y")), "doc_id", "full")
    change = F.when(F.col("x").isNull(), "missing_in_a").when(F.col("y").isNull(), "missing_in_b").when(F.col("x") != F.col("y"), "changed")
    return both.select("doc_id", change.alias("change")).where("change IS NOT NULL")


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts of chunks whose sha256 the cache (hash, v) lacks."""
    return chunks.select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"]).join(cache, "hash", "left_anti")


def with_cache(chunks: DataFrame, cache: DataFrame, encode) -> DataFrame:
    """chunks with vectors: from the cache where it has them, else encoded once for each distinct text."""
    fresh = cache_misses(chunks, cache).select("hash", encode(F.col("text")).alias("v"))
    return chunks.withColumn("hash", F.sha2("text", 256)).join(cache.select("hash", "v").unionByName(fresh), "hash", "left")


@dataclass(frozen=True)
class SearchConfig:
    """How search() runs; replace() gives a changed copy."""

    k: int = 10
    dense_k: int = 20
    sparse_k: int = 20
    expand: bool = False
    expansions: int = 2
    rerank: bool = True
    auto_k: bool = True
    spans: bool = False
    fusion: str = "rrf"  # rrf, linear or rank_sum
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    diversity: float = 0.85

    @property
    def depth(self) -> int:
        """Candidates fused: three times k before a rerank, and no fewer than either list holds."""
        return max(self.k * (3 if self.rerank else 1), self.dense_k, self.sparse_k)


PRESETS = {
    "default": SearchConfig(),
    "research": SearchConfig(dense_k=25, sparse_k=25, expand=True, spans=True, diversity=0.8),
    "technical": SearchConfig(k=15, dense_k=30, sparse_k=20, expand=True, expansions=3, fusion="linear", dense_weight=0.7, sparse_weight=0.3),
}


def configured(preset: str = "default", **changes) -> SearchConfig:
    """A preset with some settings changed; unknown settings are ignored."""
    known = {f.name for f in fields(SearchConfig)}
    return replace(PRESETS[preset], **{k: v for k, v in changes.items() if k in known})


def bi_rerank(candidates: DataFrame, encode) -> DataFrame:
    """candidates (query_id, query, id, text, ..) ranked anew by the cosine of query and text under one encoder."""
    return ranked(candidates.withColumn("score", F.round(vx.cosine(encode(F.col("query")), encode(F.col("text"))), 9)))


def fused(lists: DataFrame, config: SearchConfig) -> DataFrame:
    """Lists (query_id, method 'dense' or 'sparse', id, score, rank) as one, by the configured method."""
    if config.fusion == "linear":
        return linear_fusion(lists, {"dense": config.dense_weight, "sparse": config.sparse_weight}, config.depth)
    if config.fusion == "rank_sum":
        return rank_sum(lists, 2, config.depth, config.depth)
    return reciprocal_rank(lists, k=config.depth)


def search(chunks: DataFrame, queries: DataFrame, config: SearchConfig = PRESETS["default"], pair_score=lexical_overlap, encode=vx.text_vector) -> DataFrame:
    """(query_id, id, score, rank, k, added_terms, text, citation, source, section, page, spans) for a table of queries (query_id, query).

    Expands queries from their best five lexical hits, fuses dense and lexical lists, makes them diverse, sets each
    query's k (raised for comparisons and flat tails), reranks by pair_score, cuts to k and, if asked, adds the cited
    spans. chunks is (id, text, source[, section, page]). Every step is one pass over the whole batch of queries.
    """
    asked = queries.select("query_id", "query")
    as_docs = chunks.withColumnRenamed("id", "doc_id")
    if config.expand:
        first = with_rows(chunks.select("id", "text"), bm25(as_docs, asked, 5))
        asked = saved(expanded(asked, expansion_terms(first, asked, encode, count=config.expansions)))
    near = dense(chunks.select("id", encode(F.col("text")).alias("v")), asked.select("query_id", encode(F.col("query")).alias("v")), config.depth).withColumn("method", F.lit("dense"))
    words = bm25(as_docs, asked, config.depth).withColumn("method", F.lit("sparse"))
    met = saved(fused(near.unionByName(words), config))
    hits = _hits(chunks, met)
    kept = saved(ranked(diverse(met.join(hits.select("id", encode(F.col("text")).alias("v")), "id"), config.diversity)))
    limit = adaptive_k(kept, queries, config.k) if config.auto_k else queries.select("query_id", F.lit(config.k).alias("k"))
    told = kept.join(hits, "id").join(queries, "query_id")
    scored = ranked(told.withColumn("score", F.round(pair_score(F.col("query"), F.col("text")), 9))) if config.rerank else told
    cut = scored.join(limit.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    grown = asked.select("query_id", F.size(F.split("query", tx.BLANKS)).alias("_n")).join(queries.select("query_id", F.size(F.split("query", tx.BLANKS)).alias("_m")), "query_id").select("query_id", (F.col("_n") - F.col("_m")).alias("added_terms"))
    out = saved(result_shape(cut.join(grown, "query_id"), "query_id", "id", "score", "rank", "k", "added_terms"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,confidence:double>>)")
    if not config.spans:
        return out.withColumn("spans", none)
    from . import evidence

    found = evidence.cited_spans(out.join(queries.select(F.col("query_id"), F.col("query").alias("claim")), "query_id").select(F.col("query_id").alias("claim_id"), "claim", "id", "text"))
    spans = found.groupBy(F.col("claim_id").alias("query_id"), "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "text", "confidence"))), lambda x: F.struct(x["start"], x["end"], x["text"], x["confidence"])).alias("spans"))
    return out.join(spans, ["query_id", "id"], "left").withColumn("spans", F.coalesce("spans", none))


def result_shape(hits: DataFrame, *keys: str) -> DataFrame:
    """keys and (text, citation, source, section, page): N/A where a section or page is unknown."""
    null = lambda c: F.col(c).cast("string") if c in hits.columns else F.lit(None).cast("string")
    known = lambda c: F.coalesce(F.when(null(c) != "", null(c)), F.lit("N/A")).alias(c)
    return hits.select(*keys, "text", tx.citation(F.col("source"), null("section"), null("page")).alias("citation"), "source", known("section"), known("page"))


def search_stats(log: DataFrame) -> DataFrame:
    """One row over a log of searches (seconds, words, added_terms, raised, hits, misses): totals, means and the cache's hit rate."""
    asked = F.sum("hits") + F.sum("misses")
    return log.agg(F.count("*").alias("searches"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg("words"), 6).alias("mean_words"), F.round(F.avg(F.when(F.col("added_terms") > 0, F.col("added_terms"))), 6).alias("mean_added_terms"), F.count_if("raised").alias("raised"), F.round(F.when(asked > 0, F.sum("hits") / asked), 6).alias("hit_rate"))


def filtered(chunks: DataFrame, quality: float | None = 0.3, newest: Column | None = None, days: int | None = None, types: tuple[str, ...] | None = None, sections: tuple[str, ...] | None = None) -> DataFrame:
    """chunks (quality, updated_at, doc_type, section) of at least that quality, at most so many days older than `newest`,
    of the allowed types and outside the excluded sections; a setting of None filters nothing."""
    keep = F.lit(True) if quality is None else F.coalesce(F.col("quality") >= quality, F.lit(False))
    if days is not None:
        keep = keep & (F.col("updated_at") >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))
    if types is not None:
        keep = keep & F.col("doc_type").isin(*types)
    if sections is not None:
        keep = keep & ~F.coalesce(F.col("section").isin(*sections), F.lit(False))
    return chunks.where(keep)


def paragraph_hits(docs: DataFrame, queries: DataFrame, encode, k: int = 3) -> DataFrame:
    """(query_id, doc_id, pos, text, score, rank): the k paragraphs, set apart by blank lines, nearest to each query."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "text")).withColumn("text", F.trim(F.regexp_replace("text", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""))).where("text <> ''")
    numbered = parts.withColumn("id", F.col("doc_id") * (1 << 24) + F.col("pos"))
    top = dense(numbered.select("id", encode(F.col("text")).alias("v")), queries.select("query_id", encode(F.col("query")).alias("v")), k)
    return with_rows(numbered, top).select("query_id", "doc_id", "pos", "text", "score", "rank")
