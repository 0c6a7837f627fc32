"""What leaves a task and what is held in one, on tables small enough to work out."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import blocks, retrieval


def vectors(spark, n=600, d=6):
    x = np.random.default_rng(3).standard_normal((n, d)).astype(np.float32)
    x[7], x[40:60] = 0, x[40]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    u = x.astype(float)
    size = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
    return rows, np.round(u @ u.T, 9)


def small_groups(monkeypatch):
    """Groups of some 100 vectors, as if they were too many for one task."""
    for name, value in (("FEW", 0), ("GROUP", 100 * 6 * 8), ("ROWS", 20)):
        monkeypatch.setattr(blocks, name, value, raising=False)
    monkeypatch.setattr(blocks, "BROADCAST", 0, raising=False)


def nearest(cos, k):
    return {(q, r): (int(i), cos[q, i]) for q in range(len(cos)) for r, i in enumerate(np.lexsort((np.arange(len(cos)), -cos[q]))[:k], 1)}


def test_many_queries_meet_vectors_in_many_tasks(spark, monkeypatch):
    small_groups(monkeypatch)
    rows, cos = vectors(spark)
    asked = rows.select(F.col("id").alias("query_id"), "v")
    met = blocks.top(rows, asked, 5).withColumn("p", F.spark_partition_id())
    told = met.groupBy("p").agg(F.countDistinct("query_id").alias("n")).collect()
    assert len(told) >= 12 and max(r["n"] for r in told) <= 300  # all met in one task
    assert met.count() <= 600 * 5 * 6  # k for each group of vectors, not for each block of them
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.dense(rows, asked, 5).collect()}
    assert got == nearest(cos, 5)


def test_few_queries_go_to_the_vectors(spark):
    rows, cos = vectors(spark)
    asked = rows.where("id < 50").select(F.col("id").alias("query_id"), "v")
    met = blocks.top(rows.repartition(3), asked, 5)
    assert met.rdd.getNumPartitions() == 3 and met.count() == 3 * 50 * 5
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.dense(rows, asked, 5).collect()}
    assert got == {k: v for k, v in nearest(cos, 5).items() if k[0] < 50}


def test_bm25_sends_on_k_texts_a_query_and_task(spark):
    from lodestone.operators import lexical

    words = "amber falcon lantern night river".split()
    docs = spark.createDataFrame([(i, " ".join(words[j] for j in range(5) if i >> j & 1) + " owl" * (i % 3)) for i in range(400)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(q, f"{words[q % 5]} {words[(q + 1) % 5]} owl owl") for q in range(30)], "query_id long, query string")
    rows = lexical.texts(docs, "doc_id")
    assert lexical.top(rows, retrieval.query_terms(asked), 3).count() == 2 * 30 * 3
    best = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.bm25(docs, asked, 3).collect()}
    every = retrieval.bm25_indexed(retrieval.postings(docs), retrieval.corpus_stats(docs), asked, 3)
    assert best == {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in every.collect()} and len(best) == 90


def test_bm25_of_repeated_ids_null_texts_and_parts_of_a_batch(spark, tmp_path, monkeypatch):
    import duckdb

    from lodestone.operators import lexical
    from lodestone.plans.search_queries import BM25

    docs = spark.createDataFrame([(1, "amber falcon amber"), (1, "falcon of night"), (2, "night falcon lantern"), (None, "amber"), (None, "amber"), (3, None), (4, ""), (5, "amber night night")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "amber falcon"), (2, "night night"), (2, "amber"), (3, "zzz"), (4, None)], "query_id long, query string")
    docs.write.parquet(f"{tmp_path}/documents")
    asked.selectExpr("query_id AS item_id", "query AS text").write.parquet(f"{tmp_path}/benchmark")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = sorted(db.execute(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm_top").fetchall())
    got = lambda: sorted(tuple(r) for r in retrieval.bm25(docs, asked).select("query_id", "id", "score", "rank").collect())
    assert got() == want and len(want) == 6
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 2)
    monkeypatch.setattr(lexical, "PRODUCTS", 1)
    assert got() == want


def test_letter_counts(spark):
    from lodestone.functions import text as tx
    from lodestone.functions import vectors as vx

    texts = ["Zebra abba", None, "", "éaİ", "q" * 3000, "b"] * 700
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = {r[0]: r[1] for r in rows.where("id % 7 < 6").select("id", tx.letter_counts(F.col("text"))).collect()}
    slow = rows.select("id", "text", *[F.regexp_count(F.lower("text"), F.lit(c)).cast("double").alias(c) for c in "abcdefghijklmnopqrstuvwxyz"]).collect()
    assert len(got) == 3600 and all(got[r["id"]] == (None if r["text"] is None else list(r)[2:]) for r in slow if r["id"] in got)
    hashed = {r[0]: r[1] for r in rows.select("id", vx.hashed_terms(F.split("text", ""), 8)).collect()}
    assert hashed[1] is None and sum(hashed[4]) >= 3000 and sum(hashed[5]) >= 1 and len(hashed[0]) == 8


def test_only_lengths_of_sentences_go_to_python(spark):
    from lodestone.functions import text as tx
    from lodestone.operators import chunking

    assert chunking.places([120, 120, 0, 400, 8, 8], 30, 40, 10) == [(0, 1), (1, 2), (2, 3), (2, 4), (4, 6)]
    assert chunking.places_paper([40] * 3, target=100, most=100, least=31) == []
    docs = spark.createDataFrame([(1, "One. Two words here! Three. " * 60), (2, None), (3, "")], "doc_id long, text string")
    for made in (chunking.pack(docs, tx.sentences(F.col("text")), 30, 40, 10), chunking.pack_paper(docs, tx.sentences(F.col("text"))), chunking.rag_chunks(docs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "run(transform(" in plan and "length(" in plan.split("run(transform(")[1][:120]
    s = ("One. Two words here! Three. " * 60).replace(". ", ".|").replace("! ", "!|").split("|")
    got = chunking.pack(docs, tx.sentences(F.col("text")), 30, 40, 10).where("doc_id = 1").orderBy("i").collect()
    assert [r["raw"] for r in got] == chunking.packed(s, 30, 40, 10) and len(got) > 5
    heads = spark.createDataFrame([(1, 1, "a", 1), (1, 3, "b", 3), (1, 5, "c", 2), (1, 9, "d", 2), (2, 1, "e", 2), (2, 2, "f", 1)], "doc_id long, pos int, line string, level int")
    found = chunking.hierarchy(heads)
    assert "level" in found._jdf.queryExecution().optimizedPlan().toString().split("_paths(transform(")[1][:120]
    assert sorted((r["line"], "/".join(r["path"])) for r in found.collect()) == [("a", "a"), ("b", "a/b"), ("c", "a/c"), ("d", "a/d"), ("e", "e"), ("f", "f")]


def test_cited_spans_leave_the_task_only_above_the_threshold(spark, monkeypatch):
    from lodestone.operators import evidence, lexical

    claims = spark.createDataFrame([(1, "Amber falcons circle above northern harbours"), (2, "copper lanterns glow"), (3, "of it"), (4, None)], "claim_id long, claim string")
    texts = spark.createDataFrame([(i, f"Copper lanterns glow over {w} rivers.  Amber falcons circle above {w} harbours! Nothing of use stands here.") for i, w in enumerate(("northern", "southern", "eastern") * 30)] + [(900, None)], "id long, text string")
    plan = evidence.cited_everywhere(claims, texts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # no sentences are joined to what was found
    want = sorted(map(tuple, evidence.cited_spans(claims.crossJoin(texts)).collect()))
    got = lambda: sorted(map(tuple, evidence.cited_everywhere(claims, texts).collect()))
    assert got() == want and len(want) == 180
    monkeypatch.setattr(evidence, "CLAIMED", 4)
    monkeypatch.setattr(lexical, "PRODUCTS", 1)
    assert got() == want


def symbols(spark, n=400):
    s = spark.range(n).select(F.concat(F.lit("src/"), F.col("id") % 5).alias("path"), F.concat(F.lit("f"), F.col("id")).alias("name"), F.lit("function").alias("type"), F.array(F.lit("strict")).alias("parameters"))
    return s.withColumn("source", F.concat(F.lit("def "), F.col("name"), F.lit("(a):\n    return a <= 1 and a == 0\n"))).withColumn("language", F.lit("python")).coalesce(1)


def test_questions_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    from lodestone.operators import generate

    monkeypatch.setattr(generate, "SORTED", 10, raising=False)
    for made, each in ((generate.questions(symbols(spark), F.lit(3)), 3), (generate.negatives(symbols(spark), 2), 2)):
        assert made.rdd.getNumPartitions() >= 40  # by rows, where it was by the session's shuffle partitions
        told = made.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in told) <= 40 * each and sum(r["count"] for r in told) == 400 * each
    twice = symbols(spark, 3).unionByName(symbols(spark, 3))  # a repeated symbol has no more questions
    assert generate.questions(twice, F.lit(3)).count() == 9


def test_bugs_are_put_in_once_and_in_many_tasks(spark, monkeypatch):
    from lodestone.operators import generate

    monkeypatch.setattr(generate, "INJECTED", 10, raising=False)
    made = generate.versions(symbols(spark))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("EvalPython") == 1
    assert made.rdd.getNumPartitions() >= 40 and made.groupBy("task").count().count() == 3 and made.count() == 1200
