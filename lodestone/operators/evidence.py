"""Cited spans, span merging, claim extraction and verification of answers."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import saved
from ..functions import text as tx
from ..functions.memory import lean
from . import lexical

WORDS = "\\p{L}{3,}"
_STOP = re.compile(r"([.!?])[ \t\r\n]+")
NUMERIC = (
    "(?i)\\b[0-9]+\\.?[0-9]*[ \\t]*(percent|%|million|billion|thousand|years?|days?|hours?|kg|km|cm|m)\\b",
    "(?i)\\b[0-9]+\\.?[0-9]*[ \\t]*(increased|decreased|rose|fell|grew|declined)\\b",
    "(?i)\\b(approximately|roughly|about|over|under|more than|less than)[ \\t]+[0-9]+\\.?[0-9]*\\b",
)
FACTUAL = (
    "(?i)\\b[0-9]+\\.?[0-9]*[ \\t]*(percent|%|million|billion|thousand|years?|days?|hours?)\\b",
    "(?i)\\b(is|are|was|were|has|have|contains?|includes?)\\b",
    "(?i)\\b(according to|research shows|studies indicate|data suggests)\\b",
    "(?i)\\b(significantly|substantially|dramatically|markedly)\\b",
)
RELATION = "(?i)\\b(causes?|leads? to|results? in|due to|because of|associated with|correlated with|linked to|related to|compared to|in contrast to|versus|vs|higher than|lower than|greater than|less than)\\b"
ENTITY = "\\b\\p{Lu}\\p{Ll}+(?:[ \\t]+\\p{Lu}\\p{Ll}+)+\\b"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0))


def word_overlap(claim: Column, text: Column) -> Column:
    """Share of the claim's words of more than two letters that the text has."""
    words = word_set(claim)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, word_set(text))) / F.size(words)).otherwise(0.0)


def _placed(text: str | None) -> list[tuple[int, str, int, int]]:
    out, cursor = [], 0
    for pos, s in enumerate(_STOP.sub("\\1" + tx.MARK, text).split(tx.MARK) if text is not None else ()):
        found = text.find(s, cursor)
        start = found if found >= 0 else cursor
        out.append((pos, s, start, start + len(s)))
        cursor += len(s) + 1
    return out


#: texts cut, and sentences compared, at a time
TEXTS, SENTENCES = 64, 512


def sentence_offsets(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, sentence, start, end): sentences with their offsets, sought from a running sum of lengths and separators.

    Each text is read once where it lies, some at a time; only its sentences go on.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                parts = [(i, *p) for i, text in enumerate(some.column(len(keys)).to_pylist()) for p in _placed(text)]
                owner, pos, sentence, start, end = zip(*parts) if parts else [()] * 5
                kept = [some.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
                yield pa.record_batch([*kept, pa.array(pos, pa.int32()), pa.array(sentence, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [*keys, "pos", "sentence", "start", "end"])

    own = texts.select(*keys, "text")
    integer = lambda name: T.StructField(name, T.IntegerType())
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], integer("pos"), T.StructField("sentence", T.StringType()), integer("start"), integer("end")]))


def cited_spans(pairs: DataFrame, similarity=word_overlap, threshold: float = 0.6, top: int = 3, least: int = 20) -> DataFrame:
    """(claim_id, id, start, end, text, confidence, rank) for pairs (claim_id, claim, id, text)."""
    parts = sentence_offsets(pairs, "claim_id", "claim", "id").where(F.length(F.trim("sentence")) >= least)
    scored = parts.withColumn("confidence", F.round(similarity(F.col("claim"), F.col("sentence")), 9)).where(F.col("confidence") > threshold)
    w = Window.partitionBy("claim_id", "id").orderBy(F.desc("confidence"), "start")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("claim_id", "id", "start", "end", F.col("sentence").alias("text"), "confidence", "rank")


def cited_everywhere(claims: DataFrame, texts: DataFrame, threshold: float = 0.6, top: int = 3, least: int = 20) -> DataFrame:
    """cited_spans() by word_overlap of every claim (claim_id, claim) with every text (id, text).

    Sentences are compared where they lie: their words are looked up among those of the claims and counted for each
    claim, so that only spans above the threshold leave a task. Claims of more than a million words are taken in parts.
    """
    parts = sentence_offsets(texts.select("id", "text"), "id").where(F.length(F.trim("sentence")) >= least)
    rows = parts.select("id", "start", "end", F.col("sentence").alias("text"), word_set(F.col("sentence")).alias("ws"))
    listed = saved(claims.select("claim_id", word_set(F.col("claim")).alias("ws")))
    n = max(1, math.ceil(listed.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0] / CLAIMED))
    own = lambda i: listed.where(F.pmod(F.xxhash64("claim_id"), F.lit(n)) == i) if n > 1 else listed
    met = functools.reduce(DataFrame.unionByName, [_met(rows, own(i), threshold) for i in range(n)])
    scored = met.withColumn("confidence", F.round(F.col("n") / F.col("size"), 9)).where(F.col("confidence") > threshold)
    w = Window.partitionBy("claim_id", "id").orderBy(F.desc("confidence"), "start")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("claim_id", "id", "start", "end", "text", "confidence", "rank")


#: words of claims held by a task
CLAIMED = 1_000_000


def _tallied(keys: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `many` and how often each occurs."""
    if len(keys) * 8 < many:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=many)
    some = np.flatnonzero(n)
    return some, n[some]


def _met(rows: DataFrame, claims: DataFrame, threshold: float) -> DataFrame:
    """(claim_id, id, start, end, text, n, size): sentences (id, start, end, text, ws) with n of a claim's words (claim_id, ws), about the threshold or above."""
    held = claims.toArrow().combine_chunks()
    kind = T.StructType([claims.schema["claim_id"], *rows.schema.fields[:4], T.StructField("n", T.LongType()), T.StructField("size", T.LongType())])
    words = pa.concat_arrays(held.column("ws").chunks).flatten() if held.num_rows else pa.array([], pa.string())
    if not len(words):
        return rows.sparkSession.createDataFrame([], kind)
    claim_ids, sizes = held.column("claim_id").combine_chunks(), held.column("ws").combine_chunks().value_lengths().fill_null(0).to_numpy()
    claim_ids = claim_ids.chunk(0) if isinstance(claim_ids, pa.ChunkedArray) else claim_ids
    coded, asked, many = words.dictionary_encode(), np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    known, term = coded.dictionary, coded.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    begins, asked = np.searchsorted(term[order], np.arange(len(known) + 1)), asked[order]
    least = np.maximum(1, sizes * threshold - 1e-6)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENTENCES):
                some = batch.slice(at, SENTENCES)
                owner, word, _ = lexical.found(some.column("ws"), known)
                ends = np.cumsum(np.bincount(owner, begins[word + 1] - begins[word], minlength=some.num_rows))
                for first, last in lexical.shares(ends, many):
                    own = slice(*np.searchsorted(owner, [first, last]))
                    times, step = lexical.met(owner[own], word[own], begins)
                    key, n = _tallied(np.repeat(owner[own] - first, times) * many + asked[step], (last - first) * many)
                    near = n >= least[key % many]
                    if near.any():
                        claim, sentence = key[near] % many, pa.array(first + key[near] // many)
                        yield pa.record_batch([claim_ids.take(pa.array(claim)), *(some.column(c).take(sentence) for c in range(4)), pa.array(n[near]), pa.array(sizes[claim].astype(np.int64))], [f.name for f in kind])

    return rows.mapInArrow(run, kind)


def merge_spans(spans: DataFrame, key: str = "id", gap: int = 10) -> DataFrame:
    """Spans of a key that overlap or lie at most `gap` apart as one: greatest end and confidence, first text."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach + gap)).cast("int")
    islands = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("text", F.struct("start", "end")).alias("text"), F.max("confidence").alias("confidence")).drop("_island")


def highlight(text: Column, spans: Column, before: str = "**", after: str = "**") -> Column:
    """text with each span (array<struct<start,end,..>>) marked, from the last to the first."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    step = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(before), F.substring(t, s["start"] + 1, s["end"] - s["start"]), F.lit(after), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(ordered, text, step)


def valid_span(start: Column, end: Column, text: Column, whole: Column) -> Column:
    return (start >= 0) & (end > start) & (end <= F.length(whole)) & (F.substring(whole, start + 1, end - start) == text)


def claims(answers: DataFrame, entities=None) -> DataFrame:
    """(answer_id, sentence_no, sentence, claim, kind, confidence) for answers (answer_id, text).

    entities maps a sentence column to an array of entity strings; the default takes runs of capitalised words.
    """
    entities = entities or (lambda s: F.regexp_extract_all(s, F.lit(ENTITY), 0))
    base = answers.select("answer_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_no", "sentence")).where(F.length(F.trim("sentence")) >= 10)
    rows = lambda found, kind, sure: F.transform(found, lambda c: F.struct(c.alias("claim"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")))
    numeric = F.flatten(F.array(*[F.regexp_extract_all("sentence", F.lit(p), 0) for p in NUMERIC]))
    factual = F.flatten(F.array(*[F.regexp_extract_all("sentence", F.lit("(?is).{0,50}" + p.removeprefix("(?i)") + ".{0,50}"), 0) for p in FACTUAL]))
    whole = lambda test: F.when(test, F.array("sentence")).otherwise(F.expr("cast(array() as array<string>)"))
    all_ = F.concat(rows(numeric, "numeric", 0.8), rows(whole(F.size(entities(F.col("sentence"))) > 0), "entity", 0.7), rows(F.transform(factual, lambda x: F.trim(x)), "factual_pattern", 0.6), rows(whole(F.col("sentence").rlike(RELATION)), "relationship", 0.6))
    return base.select("answer_id", "sentence_no", "sentence", F.explode(all_).alias("c")).select("answer_id", "sentence_no", "sentence", "c.claim", "c.kind", "c.confidence")


def entity_overlap(entities: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: low.contains(F.lower(e)))) / F.size(entities)).otherwise(0.0)


def weighted(kind: Column, words: Column, meaning: Column, named: Column) -> Column:
    """Confidence in a claim from its three similarities, by kind."""
    return F.when(kind == "numeric", 0.4 * words + 0.3 * meaning + 0.3 * named).when(kind == "entity", 0.3 * words + 0.3 * meaning + 0.4 * named).otherwise(0.35 * words + 0.45 * meaning + 0.2 * named)


def verified(pairs: DataFrame, similarity=word_overlap, top: int = 3) -> DataFrame:
    """(claim_id, is_verified, best, citations, method) for pairs (claim_id, claim, kind, id, text).

    A chunk supports a claim at word overlap 0.3, similarity 0.7 or confidence 0.6; the claim is verified when
    its best supporting confidence is at least 0.6. citations are the ids of the best `top` supporters.
    """
    entities = F.regexp_extract_all("claim", F.lit(ENTITY), 0)
    scored = pairs.withColumn("words", word_overlap(F.col("claim"), F.col("text"))).withColumn("meaning", similarity(F.col("claim"), F.col("text"))).withColumn("named", entity_overlap(entities, F.col("text")))
    scored = scored.withColumn("sure", F.round(weighted(F.col("kind"), F.col("words"), F.col("meaning"), F.col("named")), 9))
    method = F.when((F.col("words") >= F.col("meaning")) & (F.col("words") >= F.col("named")), "lexical").when(F.col("meaning") >= F.col("named"), "semantic").otherwise("entity")
    backed = scored.withColumn("method", method).withColumn("backs", (F.col("words") >= 0.3) | (F.col("meaning") >= 0.7) | (F.col("sure") >= 0.6))
    w = Window.partitionBy("claim_id").orderBy(F.desc("backs"), F.desc("sure"), "id")
    first = backed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    hit = F.col("backs")
    return first.groupBy("claim_id").agg(
        F.coalesce(F.max(F.when(hit, F.col("sure"))) >= 0.6, F.lit(False)).alias("is_verified"),
        F.coalesce(F.max(F.when(hit, F.col("sure"))), F.lit(0.0)).alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("rank", "id")))), lambda x: x["id"].cast("string")), ",").alias("citations"),
        F.coalesce(F.max(F.when(hit & (F.col("rank") == 1), F.col("method"))), F.lit("none")).alias("method"),
    )


def verified_everywhere(claims: DataFrame, texts: DataFrame, top: int = 3) -> DataFrame:
    """verified() by words alone of every claim (claim_id, claim, kind) against every text (id, text), without their pairs.

    Claims name no entities here and similarity is the words' overlap, so a text that shares no word with a claim can't
    support it: texts' words that some claim has are joined to the claims' words and counted. A claim that
    shares no word with any text, or has none, is unsupported.
    """
    words = claims.select("claim_id", "kind", word_set(F.col("claim")).alias("ws")).select("claim_id", "kind", F.size("ws").alias("size"), F.explode_outer("ws").alias("word"))
    wanted = words.select("word").where("word IS NOT NULL").distinct()
    small = wanted.count() < 1_000_000
    held = texts.select("id", F.explode(word_set(F.col("text"))).alias("word")).join(F.broadcast(wanted) if small else wanted, "word", "left_semi")
    shared = held.join(words, "word").groupBy("claim_id", "kind", "size", "id").agg(F.count("*").alias("n"))
    overlap = F.col("n") / F.col("size")
    scored = shared.withColumn("words", overlap).withColumn("sure", F.round(weighted(F.col("kind"), overlap, overlap, F.lit(0.0)), 9))
    backed = scored.where((F.col("words") >= 0.3) | (F.col("sure") >= 0.6))
    w = Window.partitionBy("claim_id").orderBy(F.desc("sure"), "id")
    first = backed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    told = first.groupBy("claim_id").agg(F.max("sure").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("citations"))
    whole = claims.select("claim_id").join(told, "claim_id", "left")
    return whole.select("claim_id", F.coalesce(F.col("best") >= 0.6, F.lit(False)).alias("is_verified"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("citations", F.lit("")).alias("citations"), F.when(F.col("best").isNotNull(), "lexical").otherwise("none").alias("method"))


def supporting_sentence(claim: Column, text: Column) -> Column:
    """The first sentence that shares most words with the claim; without any, the first 200 characters."""
    scored = F.transform(tx.sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(word_set(s), word_set(claim))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["s"]).otherwise(F.concat(F.substring(text, 1, 200), F.lit("...")))


def report(checked: DataFrame) -> DataFrame:
    """(answer_id, n_claims, n_verified, score, status, regenerate, guidance) from (answer_id, kind, is_verified); 0.8 passes."""
    kinds = (("numeric", "Verify all numbers"), ("entity", "Verify named entities"), ("factual_pattern", "Support factual statements"), ("relationship", "Support stated relations"))
    advice = F.concat_ws("; ", *[F.when(F.max(F.when((F.col("kind") == k) & ~F.col("is_verified"), 1)) == 1, F.lit(t)) for k, t in kinds])
    n, good = F.count("*"), F.count_if("is_verified")
    return checked.groupBy("answer_id").agg(n.alias("n_claims"), good.alias("n_verified"), F.round(good / n, 9).alias("score"), F.when(good / n >= 0.8, "passed").otherwise("failed").alias("status"), (good / n < 0.8).alias("regenerate"), advice.alias("guidance"))


def answer_citations(answer: Column, source: Column) -> Column:
    """Distinct line references, then back-ticked snippets that the source holds as code:snippet."""
    refs = F.transform(F.regexp_extract_all(F.lower(answer), F.lit("\\blines?[ \\t]+([0-9]+(?:-[0-9]+)?)"), 1), lambda n: F.concat(F.lit("line "), n))
    code = F.filter(F.regexp_extract_all(answer, F.lit("`([^`]+)`"), 1), lambda c: source.contains(c))
    return F.array_distinct(F.concat(refs, F.transform(code, lambda c: F.concat(F.lit("code: "), c))))
